"""Rasters as rows ``(row, col, band, <fields>)``; an absent row is an invalid cell.

Geometry (origin, spacing, size) lives in ``GridMeta`` and is never inferred
from the cells.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from firnline.common import broadcast_if_few
from firnline.functions.semantics import valid

LATTICE_LIMIT = 2_000_000_000  # most cells of a dense background


@dataclass(frozen=True)
class GridMeta:
    x0: float
    dx: float
    nx: int
    y0: float
    dy: float
    ny: int
    srs: str | int | None = None

    def x(self, c: Column) -> Column:
        return F.lit(self.x0) + c * self.dx

    def y(self, r: Column) -> Column:
        return F.lit(self.y0) + r * self.dy

    def bounds(self, pad: float = 0.0) -> tuple[float, float, float, float]:
        return self.x0 - pad, self.x0 + self.dx * (self.nx - 1) + pad, self.y0 - pad, self.y0 + self.dy * (self.ny - 1) + pad

    def union(self, *others: GridMeta) -> GridMeta:
        """Smallest grid of this spacing that holds all."""
        b = [m.bounds() for m in (self, *others)]
        x0, x1, y0, y1 = min(v[0] for v in b), max(v[1] for v in b), min(v[2] for v in b), max(v[3] for v in b)
        return GridMeta(x0, self.dx, round((x1 - x0) / self.dx) + 1, y0, self.dy, round((y1 - y0) / self.dy) + 1, self.srs)

    def ring(self, half_cell: bool = True) -> list[tuple[float, float]]:
        hx, hy = (self.dx / 2, self.dy / 2) if half_cell else (0, 0)
        x0, x1, y0, y1 = self.bounds()
        return [(x0 - hx, y0 - hy), (x0 - hx, y1 + hy), (x1 + hx, y1 + hy), (x1 + hx, y0 - hy), (x0 - hx, y0 - hy)]


def lattice(spark: SparkSession, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """All ``(row, col)`` of closed ranges, made in parallel."""
    ny, nx = rows[1] - rows[0] + 1, cols[1] - cols[0] + 1
    if ny * nx > LATTICE_LIMIT:
        raise ValueError("lattice too large")
    d = spark.range(ny * nx)
    return d.select((F.floor(F.col("id") / nx) + rows[0]).cast("bigint").alias("row"), (F.col("id") % nx + cols[0]).cast("bigint").alias("col"))


def points_to_grid(points: DataFrame, meta: GridMeta, field: str, seq: str, background: float | None = None) -> DataFrame:
    """Nearest cell of each point; the last point (largest ``seq``) wins; empty cells hold ``background``."""
    p = points.where(valid("x") & valid("y")).select(F.rint((F.col("y") - meta.y0) / meta.dy).cast("bigint").alias("row"), F.rint((F.col("x") - meta.x0) / meta.dx).cast("bigint").alias("col"), field, seq)
    p = p.where(F.col("row").between(0, meta.ny - 1) & F.col("col").between(0, meta.nx - 1)).groupBy("row", "col").agg(F.max_by(field, seq).alias(field))
    full = lattice(points.sparkSession, (0, meta.ny - 1), (0, meta.nx - 1)).join(p, ["row", "col"], "left")
    return full if background is None else full.withColumn(field, F.coalesce(field, F.lit(background)))


def as_points(cells: DataFrame, meta: GridMeta, fields: list[str], keep_all: bool = False) -> DataFrame:
    out = cells if keep_all else cells.where(valid(fields[0]) & (F.abs(fields[0]) != float("inf")))
    return out.withColumns({"x": meta.x(F.col("col")), "y": meta.y(F.col("row"))})


def crop(cells: DataFrame, **ranges: tuple | None) -> DataFrame:
    """Closed ranges of axis columns; None keeps all."""
    cond = [F.col(k).between(*v) for k, v in ranges.items() if v is not None]
    return cells.where(reduce(lambda a, b: a & b, cond)) if cond else cells


def take(cells: DataFrame, **picks: list[int]) -> DataFrame:
    """Only the listed rows, cols or bands."""
    return cells.where(reduce(lambda a, b: a & b, [F.col(k).isin(v) for k, v in picks.items()]))


def time_range(cells: DataFrame, t0: float, t1: float, t: str = "t") -> DataFrame:
    """Bands with times in the closed range, numbered anew from 0 in order of time; equal times stay separate bands."""
    rows = cells.where(F.col(t).between(t0, t1))
    number = rows.select(t, "band").distinct().withColumn("new_band", (F.row_number().over(W.orderBy(t, "band")) - 1).cast("bigint"))  # one row per band
    return rows.join(broadcast_if_few(number), [t, "band"]).drop("band").withColumnRenamed("new_band", "band")


def decimate(cells: DataFrame, skip: int) -> DataFrame:
    return cells.where((F.col("row") % skip == 0) & (F.col("col") % skip == 0)).withColumns({"row": (F.col("row") / skip).cast("bigint"), "col": (F.col("col") / skip).cast("bigint")})


def gradient(cells: DataFrame, field: str, dx: float, dy: float, keys: list[str] | None = None) -> DataFrame:
    """``<f>_x, <f>_y``: central differences, one-sided at the edges; a missing neighbour gives null.

    Two windows on (keys, row) and (keys, col); the lattice is taken as dense.
    """
    keys = keys or []

    def along(axis: str, by: str, d: float) -> Column:
        w = W.partitionBy(*keys, by).orderBy(axis)
        a, b = F.lag(F.struct(axis, field)).over(w), F.lead(F.struct(axis, field)).over(w)
        fa, fb = a[field], b[field]
        return F.when(a.isNull() & b.isNull(), None).when(a.isNull(), (fb - F.col(field)) / d).when(b.isNull(), (F.col(field) - fa) / d).otherwise((fb - fa) / (2 * d))

    return cells.withColumns({f"{field}_x": along("col", "row", dx), f"{field}_y": along("row", "col", dy)})


def normalise(c: Column, z0: tuple[float, float], z1: tuple[float, float], truncate: bool = True) -> Column:
    v = (c - z0[0]) / (z0[1] - z0[0]) * (z1[1] - z1[0]) + z1[0]
    return F.greatest(F.least(v, F.lit(float(max(z1)))), F.lit(float(min(z1)))) if truncate else v


def to_rgb(cells: DataFrame, field: str, z0: tuple[float, float], colours: list[tuple[float, float, float]]) -> DataFrame:
    """Colour-map lookup by the normalised value."""
    n = len(colours)
    at = F.least(F.floor(normalise(F.col(field), z0, (0.0, 1.0)) * n), F.lit(n - 1)).cast("int") + 1
    table = F.array(*[F.struct(F.lit(float(r)).alias("r"), F.lit(float(g)).alias("g"), F.lit(float(b)).alias("b")) for r, g, b in colours])
    c = F.element_at(table, at)
    return cells.withColumns({k: F.when(valid(field), c[k]) for k in "rgb"})


def alpha(field: str, nodata: list[float] | None = None) -> Column:
    """1 where valid, else 0."""
    bad = F.col(field).isNull() | F.isnan(field)
    return F.when(bad | (F.col(field).isin(nodata) if nodata else F.lit(False)), 0.0).otherwise(1.0)


def replace_invalid(c: Column, fill: float | None, new: float | None) -> Column:
    bad = c.isNull() | F.isnan(c)
    if fill is not None:
        bad = bad | (c == fill)
    return F.when(bad, F.lit(new).cast("double")).otherwise(c)


def time_difference(cells: DataFrame, field: str, band: str, b0: int, b1: int, t0: float, t1: float, keys: tuple[str, str] = ("row", "col")) -> DataFrame:
    """Rate between two bands; cells missing in either have none.  One aggregation instead of a self-join."""
    at = lambda b: F.max(F.when(F.col(band) == b, F.col(field)))
    d = cells.where(F.col(band).isin(b0, b1)).groupBy(*keys).agg(at(b0).alias("_a"), at(b1).alias("_b"))
    return d.where("_a is not null and _b is not null").select(*keys, ((F.col("_b") - F.col("_a")) / (t1 - t0)).alias(f"{field}_rate"))


def concat_time(grids: list[tuple[DataFrame, int]], time: str = "t") -> DataFrame:
    """Bands of several rasters in order of time (then of input): new ``band`` numbers from 0; equal times stay separate."""
    tagged = [g.withColumn("_seq", F.lit(n)) for g, n in grids]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    bands = every.select(time, "_seq", "band").distinct()  # one row per band
    number = bands.withColumn("new_band", (F.row_number().over(W.orderBy(time, "_seq", "band")) - 1).cast("bigint"))
    return every.join(broadcast_if_few(number), [time, "_seq", "band"]).drop("_seq", "band").withColumnRenamed("new_band", "band")


def overlaps(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column], pad: float = 0.0) -> Column:
    """Closed boxes (x0, x1, y0, y1) that touch when widened by ``pad``."""
    return (a[0] - pad <= b[1]) & (b[0] <= a[1] + pad) & (a[2] - pad <= b[3]) & (b[2] <= a[3] + pad)


def in_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd rule over the edges of a ring, as one expression."""
    hits = F.lit(0)
    for (x0, y0), (x1, y1) in zip(ring[:-1], ring[1:]):
        if y0 != y1:
            cross = ((F.lit(y0) > y) != (F.lit(y1) > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
            hits = hits + F.when(cross, 1).otherwise(0)
    return hits % 2 == 1


def rasterize(cells: DataFrame, meta: GridMeta, ring: list[tuple[float, float]], field: str, burn: float) -> DataFrame:
    """Burn a value into the cells whose centre lies in the ring."""
    inside = in_polygon(meta.x(F.col("col")), meta.y(F.col("row")), ring)
    return cells.withColumn(field, F.when(inside, F.lit(burn)).otherwise(F.col(field) if field in cells.columns else F.lit(None).cast("double")))
