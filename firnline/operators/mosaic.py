"""Weighted mosaics: tapers as expressions, accumulation as one aggregation per cell."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.functions.semantics import valid
from firnline.operators.raster import GridMeta


def _dist(i: Column, n: int, d: float) -> Column:
    return F.abs(i - (n - 1) / 2) * d


def raised_cosine(i: Column, n: int, d: float, pad: float, feather: float) -> Column:
    """1 inside, a sine-shaped ramp over ``feather``, 0 within ``pad`` of the edge."""
    half, eps = (n - 1) * d / 2, 0.01 * d
    r = _dist(i, n, d)
    ramp = 0.5 + 0.5 * F.sin(-math.pi * (r - (half - pad - feather / 2)) / (feather + 2 * d))
    return F.when(r > half - pad + eps, 0.0).when(r < half - pad - feather - eps, 1.0).when(r <= half - pad, ramp).otherwise(0.0)


def gaussian(i: Column, n: int, d: float, pad: float, feather: float) -> Column:
    """1 inside, the Gaussian of the distance from the centre over ``feather``, 0 within ``pad``."""
    half = (n - 1) * d / 2
    r = _dist(i, n, d)
    return F.when(r >= half - pad, 0.0).when(r <= half - pad - feather, 1.0).otherwise(F.exp(-F.pow(r / (feather / 2), 2)))


def padded(i: Column, n: int, d: float, pad: float) -> Column:
    return F.when(_dist(i, n, d) >= (n - 1) * d / 2 - pad, 0.0).otherwise(1.0)


def weights(meta: GridMeta, pad: float = 0.0, feather: float = 0.0, mode: str = "raised cosine", row: str = "row", col: str = "col") -> Column:
    """Weight of a cell of a tile, as the product of its row and column tapers."""
    w = F.lit(1.0)
    shape = {"raised cosine": raised_cosine, "gaussian": gaussian}[mode]
    for c, n, d in ((row, meta.ny, meta.dy), (col, meta.nx, meta.dx)):
        if feather:
            w = w * shape(F.col(c), n, d, pad, feather)
        if pad:
            w = w * padded(F.col(c), n, d, pad)
    return w


def accumulate(cells: DataFrame, field: str, weight: str, keys: list[str], skip_invalid: bool = True) -> DataFrame:
    """Sums of weight and weighted value per cell.  Invalid values are left out, or make their cell invalid."""
    ok = valid(field) & (F.abs(field) != float("inf"))
    rows = cells.where(ok) if skip_invalid else cells
    v = F.when(ok, F.col(weight) * F.col(field))
    bad = F.max(F.when(ok, 0).otherwise(1)) == 1
    return rows.groupBy(*keys).agg(F.sum(weight).alias("sum_w"), F.when(bad, None).otherwise(F.sum(v)).alias("sum_wz"))


def finish(sums: DataFrame, field: str, fill: float | None = None) -> DataFrame:
    """Weighted mean; weight 0 gives ``fill``."""
    z = F.when(F.col("sum_w") != 0, F.col("sum_wz") / F.col("sum_w"))
    return sums.withColumn(field, z if fill is None else F.coalesce(z, F.lit(fill))).drop("sum_w", "sum_wz")


def replace(cells: DataFrame, field: str, seq: str, keys: list[str]) -> DataFrame:
    """Last tile (largest ``seq``) wins."""
    return cells.groupBy(*keys).agg(F.max_by(field, seq).alias(field))


def mosaic(tiles: DataFrame, field: str, meta: GridMeta, *, pad: float = 0.0, feather: float = 0.0, tile_row: str = "tile_row", tile_col: str = "tile_col", row: str = "row", col: str = "col", by_band: bool = False, fill: float | None = None) -> DataFrame:
    """Weighted mosaic of equally shaped tiles; ``tile_row``/``tile_col`` number the cells inside a tile."""
    w = weights(meta, pad, feather, row=tile_row, col=tile_col)
    keys = [row, col, "band"] if by_band else [row, col]
    return finish(accumulate(tiles.withColumn("_w", w), field, "_w", keys), field, fill)
