"""Normalised Gaussian smoothing, filling of holes, erosion and feathering of rasters."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.functions.semantics import valid


def kernel(width: float, truncate: float = 4.0) -> list[tuple[int, float]]:
    """(offset, weight) of a Gaussian cut at ``truncate`` widths, adding to 1."""
    r = int(truncate * width + 0.5)
    k = [(i, math.exp(-0.5 * (i / width) ** 2)) for i in range(-r, r + 1)]
    total = sum(w for _, w in k)
    return [(i, w / total) for i, w in k]


def _smoothed(row: np.ndarray, col: np.ndarray, z: np.ndarray, k: list[tuple[int, float]], block: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of weighted value and of weight over a block, from cells numbered from the corner of its halo."""
    r = k[-1][0]
    n = block + 2 * r
    at = row * n + col
    s, m = np.bincount(at, z, n * n).reshape(n, n), np.bincount(at, minlength=n * n).reshape(n, n).astype(float)
    along = lambda a: sum(w * a[:, r - i : r - i + block] for i, w in k)
    return along(along(s).T).T, along(along(m).T).T


def _in_blocks(cells: DataFrame, r: int, block: int) -> DataFrame:
    """Cells with the blocks ``_i, _j`` they lie in or within ``r`` of; no block where row or column is null."""
    span = lambda a: F.explode_outer(F.sequence(F.floor((F.col(a) - r) / block).cast("bigint"), F.floor((F.col(a) + r) / block).cast("bigint")))
    return cells.withColumn("_i", span("row")).withColumn("_j", span("col"))


def smooth(cells: DataFrame, field: str, width: float, keys: list[str] | None = None, block: int = 256) -> DataFrame:
    """Normalised convolution, zero outside the raster: ``row, col, value, weight`` wherever a valid cell reaches.

    Separable; blocks of ``block`` cells with a halo of the kernel are handled as arrays.
    """
    keys, k = keys or [], kernel(width)
    r = k[-1][0]
    v = cells.where(valid(field) & F.col("row").isNotNull() & F.col("col").isNotNull()).select(*keys, "row", "col", F.col(field).cast("double").alias("_z"))

    def run(key, d: pd.DataFrame) -> pd.DataFrame:
        i0, j0 = int(key[-2]) * block, int(key[-1]) * block
        s, m = _smoothed(d.row.to_numpy() - i0 + r, d.col.to_numpy() - j0 + r, d["_z"].to_numpy(), k, block)
        i, j = np.nonzero(m > 0)
        return pd.DataFrame({**{n: [key[a]] * len(i) for a, n in enumerate(keys)}, "row": i + i0, "col": j + j0, "value": s[i, j] / m[i, j], "weight": m[i, j]})

    kinds = dict(cells.dtypes)
    return _in_blocks(v, r, block).groupBy(*keys, "_i", "_j").applyInPandas(run, ", ".join([*[f"`{n}` {kinds[n]}" for n in keys], "row bigint, col bigint, value double, weight double"]))


def fill_holes(cells: DataFrame, field: str, width: float, keys: list[str] | None = None, nodata: float = -9999.0, block: int = 256) -> DataFrame:
    """Invalid cells get the smoothed value of the valid ones around; those out of reach stay null.

    Cells go through one shuffle by block and come back filled; only rasters
    with further columns are joined to their smoothed values.
    """
    keys, k = keys or [], kernel(width)
    r = k[-1][0]
    c = cells.withColumn(field, F.when(valid(field) & (F.col(field) != nodata), F.col(field)))
    kinds, names = dict(c.dtypes), c.columns
    if set(names) - {*keys, "row", "col", field} or {kinds[n] for n in ("row", "col")} != {"bigint"} or kinds[field] != "double":
        s = smooth(c, field, width, keys, block).select(*keys, "row", "col", F.col("value").alias("_s"))
        return c.join(s, [*keys, "row", "col"], "left").withColumn(field, F.coalesce(field, "_s")).drop("_s")

    def run(key, d: pd.DataFrame) -> pd.DataFrame:
        if pd.isna(key[-2]) or pd.isna(key[-1]):
            return d[names]
        i, j, z = d.row.to_numpy() - int(key[-2]) * block, d.col.to_numpy() - int(key[-1]) * block, d[field].to_numpy(float)
        some = ~np.isnan(z)
        s, m = _smoothed(i[some] + r, j[some] + r, z[some], k, block)
        own = (i >= 0) & (i < block) & (j >= 0) & (j < block)
        d, i, j, z = d[own], i[own], j[own], z[own]
        with np.errstate(invalid="ignore"):
            z = np.where(np.isnan(z) & (m[i, j] > 0), s[i, j] / m[i, j], z)
        return d[names].assign(**{field: z})

    return _in_blocks(c, r, block).groupBy(*keys, "_i", "_j").applyInPandas(run, c.schema)


def edge_distance(cells: DataFrame, field: str, reach: int, block: int = 256) -> DataFrame:
    """``row, col, dist``: cells to the nearest invalid or absent cell, at most ``reach``.

    Blocks of ``block`` cells with a halo of ``reach`` are handled as arrays.
    """
    c = cells.where(valid(field)).select("row", "col")
    span = lambda a: F.sequence(F.floor((F.col(a) - reach) / block).cast("bigint"), F.floor((F.col(a) + reach) / block).cast("bigint"))
    b = c.withColumn("bi", F.explode(span("row"))).withColumn("bj", F.explode(span("col")))

    def run(key, d: pd.DataFrame) -> pd.DataFrame:
        i0, j0 = int(key[0]) * block - reach, int(key[1]) * block - reach
        n = block + 2 * reach
        m = np.zeros((n, n), bool)
        i, j = d.row.to_numpy() - i0, d.col.to_numpy() - j0
        m[i, j] = True
        best = np.full((n, n), float(reach))
        for di in range(-reach, reach + 1):
            for dj in range(-reach, reach + 1):
                r = math.hypot(di, dj)
                if 0 < r < reach:
                    gap = np.ones((n, n), bool)
                    a, z = slice(max(0, -di), n - max(0, di)), slice(max(0, -dj), n - max(0, dj))
                    p, q = slice(max(0, di), n + min(0, di)), slice(max(0, dj), n + min(0, dj))
                    gap[a, z] = ~m[p, q]
                    best = np.where(gap, np.minimum(best, r), best)
        own = (i >= reach) & (i < reach + block) & (j >= reach) & (j < reach + block)
        return pd.DataFrame({"row": d.row.to_numpy()[own], "col": d.col.to_numpy()[own], "dist": best[i[own], j[own]]})

    return b.groupBy("bi", "bj").applyInPandas(run, "row bigint, col bigint, dist double")


def blend(inputs: list[DataFrame], field: str, erode: float = 0.0, feather: float = 1.0) -> DataFrame:
    """Weighted mean of rasters on one grid; weights rise from 0 at an input's edge (after erosion) to 1 over ``feather`` cells."""
    reach = max(1, math.ceil(erode + feather))
    parts = None
    for g in inputs:
        d = g.where(valid(field)).join(edge_distance(g, field, reach), ["row", "col"])
        w = F.least(F.greatest((F.col("dist") - erode) / feather, F.lit(0.0)), F.lit(1.0))
        p = d.select("row", "col", F.col(field).alias("z"), w.alias("w")).where("w > 0")
        parts = p if parts is None else parts.unionByName(p)
    return parts.groupBy("row", "col").agg((F.sum(F.col("w") * F.col("z")) / F.sum("w")).alias(field))
