"""Raster values at many places of a point: points meet the raster as arrays, block by block.

Cells and points go through one shuffle by block of the raster, cells with a
halo that holds all shifts.  In a task the cells of a block come before its
points, which stream; so a block may have any number of points, and no row is
copied for a shift or a corner.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.functions.semantics import valid
from firnline.operators.raster import GridMeta

BLOCK = 256  # cells per side

Shifts = list[tuple[float, float]]


def corners(x: np.ndarray, y: np.ndarray, grid: np.ndarray, row0: int, col0: int, meta: GridMeta) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bilinear ``value`` of places in a part of the raster from (row0, col0); where it is defined; where the raster is."""
    c, r = (x - meta.x0) / meta.dx, (y - meta.y0) / meta.dy
    inside = (c >= 0) & (c <= meta.nx - 1) & (r >= 0) & (r <= meta.ny - 1)
    c, r = np.where(inside, c, col0), np.where(inside, r, row0)
    ci, ri = np.minimum(np.floor(c), max(0, meta.nx - 2)), np.minimum(np.floor(r), max(0, meta.ny - 2))
    u, v = c - ci, r - ri
    ci, ri = np.where(inside, ci - col0, 0).astype(np.int64), np.where(inside, ri - row0, 0).astype(np.int64)
    total, full = np.zeros(len(x)), inside.copy()
    for i, j in ((0, 0), (1, 0), (0, 1), (1, 1)):
        z = grid[ri + j, ci + i]
        w = (u if i else 1 - u) * (v if j else 1 - v)
        total += np.where(w > 0, w * z, 0.0)
        full &= (w <= 0) | ~np.isnan(z)
    return total, full, inside


def by_block(points: DataFrame, keep: list[str], cells: DataFrame, meta: GridMeta, field: str, shifts: Shifts, *, x: str = "x", y: str = "y", distinct: bool = False) -> tuple[DataFrame, tuple[int, int]]:
    """Cells and points of a block side by side, cells first; and the halo (rows, cols) that the shifts need.

    Columns ``__s`` (block, and 0 for cells or 1 for points), ``_x, _y`` (place,
    or column and row), ``__v`` (value) and those of ``keep``.  ``distinct``
    takes points that agree in place and all of ``keep`` once.
    """
    halo = tuple(math.ceil(max(abs(s[k]) for s in shifts) / abs(d)) + 2 for k, d in ((1, meta.dy), (0, meta.dx)))
    across = (meta.nx + 2 * halo[1]) // BLOCK + 3
    number = lambda i, j: ((i + halo[0] // BLOCK + 1) * across + j + halo[1] // BLOCK + 1) * 2
    part = lambda c: F.floor(c / BLOCK).cast("bigint")
    c, r = (F.col(x) - meta.x0) / meta.dx, (F.col(y) - meta.y0) / meta.dy
    near = (c >= -halo[1]) & (c <= meta.nx - 1 + halo[1]) & (r >= -halo[0]) & (r <= meta.ny - 1 + halo[0])
    p = points.where(near).select((number(part(F.floor(r)), part(F.floor(c))) + 1).alias("__s"), F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"), F.lit(None).cast("double").alias("__v"), *keep)
    span = lambda a, h: F.explode(F.sequence(part(F.col(a) - h), part(F.col(a) + h)))
    g = cells.where(valid(field) & F.col("row").between(0, meta.ny - 1) & F.col("col").between(0, meta.nx - 1)).select("row", "col", F.col(field).cast("double").alias("__v"))
    g = g.withColumn("_i", span("row", halo[0])).withColumn("_j", span("col", halo[1]))
    kinds = {f.name: f.dataType for f in p.schema.fields}
    g = g.select(number(F.col("_i"), F.col("_j")).alias("__s"), F.col("col").cast("double").alias("__x"), F.col("row").cast("double").alias("__y"), "__v", *[F.lit(None).cast(kinds[k]).alias(k) for k in keep])
    rows = p.unionByName(g).withColumn("__b", F.shiftright("__s", 1)).repartition("__b")
    if distinct:  # equal points lie in one block: no further shuffle
        rows = rows.groupBy("__b", *[k for k in rows.columns if k != "__b"]).agg(F.count("*").alias("__n")).drop("__n")
    return rows.drop("__b").sortWithinPartitions("__s"), halo


def stream(rows: DataFrame, halo: tuple[int, int], meta: GridMeta, shifts: Shifts, fold: Callable[[], tuple], schema: str) -> DataFrame:
    """Rows of ``by_block`` through ``each(batch, values, full, inside)`` and ``last()``, both made anew by ``fold()`` in a task.

    The three arrays have a row per shift; both functions return a record batch or None.
    """
    across = (meta.nx + 2 * halo[1]) // BLOCK + 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, last = fold()
        at, grid = None, None
        for batch in batches:
            s = batch.column("__s").to_numpy()
            ends = np.r_[np.flatnonzero(s[1:] != s[:-1]) + 1, len(s)] if len(s) else []
            a = 0
            for b in ends:
                block, some = int(s[a]) >> 1, batch.slice(a, int(b) - a)
                a = int(b)
                i, j = divmod(block, across)
                row0 = (i - halo[0] // BLOCK - 1) * BLOCK - halo[0]
                col0 = (j - halo[1] // BLOCK - 1) * BLOCK - halo[1]
                if block != at:
                    at, grid = block, np.full((BLOCK + 2 * halo[0] + 1, BLOCK + 2 * halo[1] + 1), np.nan)
                x, y = some.column("__x").to_numpy(), some.column("__y").to_numpy()
                if not int(s[a - 1]) & 1:
                    grid[y.astype(np.int64) - row0, x.astype(np.int64) - col0] = some.column("__v").to_numpy()
                    continue
                got = [corners(x + dx, y + dy, grid, row0, col0, meta) for dx, dy in shifts]
                if (out := each(some, *(np.array([g[k] for g in got]) for k in range(3)))) is not None and out.num_rows:
                    yield out
        if (out := last()) is not None:
            yield out

    return rows.mapInArrow(run, schema)
