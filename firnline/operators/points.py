"""Point sets: projection, subsetting, union, summary.

Null and NaN both mean a missing value; results hold null, never NaN.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.functions.semantics import nan_to_null, valid


def from_columns(spark: SparkSession, columns: dict[str, list], fields: list[str] | None = None) -> DataFrame:
    """Points from equally long lists; a field without list is null."""
    import pandas as pd

    fields = fields or list(columns)
    size = len(next(iter(columns.values()))) if columns else 0
    frame = pd.DataFrame({f: columns.get(f, [None] * size) for f in fields})
    return complete_fields(spark.createDataFrame(frame[[f for f in fields if f in columns]]), fields).select(*fields)


def assign(df: DataFrame, **fields: Column | float | int | str) -> DataFrame:
    """Add or replace columns; plain values become constants."""
    return df.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in fields.items()})


def complete_fields(df: DataFrame, fields: list[str], kind: str = "double") -> DataFrame:
    """Add the fields that are not there as nulls."""
    return df.withColumns({f: F.lit(None).cast(kind) for f in fields if f not in df.columns}) if set(fields) - set(df.columns) else df


def box(x: tuple[float, float], y: tuple[float, float], xcol: str = "x", ycol: str = "y") -> Column:
    """Closed box; false for missing coordinates."""
    return F.coalesce(F.col(xcol).between(*x) & F.col(ycol).between(*y) & valid(xcol) & valid(ycol), F.lit(False))


def crop(df: DataFrame, x: tuple[float, float], y: tuple[float, float], *, tile: tuple[float, str, str] | None = None) -> DataFrame:
    """Points in a closed box.

    ``tile`` = (width, x column, y column) of a partitioned layout adds the
    matching condition on the partition columns, so that other partitions are
    never listed or read.
    """
    plain = F.col("x").between(*x) & F.col("y").between(*y)
    if tile:
        width, tx, ty = tile
        plain = plain & F.col(tx).between(round(x[0] / width) * width, round(x[1] / width) * width) & F.col(ty).between(round(y[0] / width) * width, round(y[1] / width) * width)
    return df.where(plain)


def open_window(x0: float, y0: float, width: float) -> Column:
    return (F.abs(F.col("x") - x0) < width / 2) & (F.abs(F.col("y") - y0) < width / 2)


def within_radius(x0: float, y0: float, radius: float) -> Column:
    dx, dy = F.col("x") - x0, F.col("y") - y0
    return F.sqrt(dx * dx + dy * dy) < radius


def in_axes(x: tuple[float, float], y: tuple[float, float]) -> Column:
    """Closed in x, half-open in y."""
    return (F.col("x") >= x[0]) & (F.col("x") <= x[1]) & (F.col("y") >= y[0]) & (F.col("y") < y[1])


def subset(df: DataFrame, rows: Column, fields: list[str] | None = None) -> DataFrame:
    out = df.where(rows)
    return out.select(*fields) if fields else out


def map_fields(df: DataFrame, fn: Callable[[Column], Column], fields: list[str]) -> DataFrame:
    return df.withColumns({f: fn(F.col(f)) for f in fields})


def map_arrays(df: DataFrame, fn: Callable, fields: list[str], kind: str = "double") -> DataFrame:
    """``fn`` on pandas Series, batch by batch, for functions that are no expressions."""
    udf = F.pandas_udf(fn, kind)
    return df.withColumns({f: udf(F.col(f)) for f in fields})


def union(parts: list[DataFrame | None]) -> DataFrame:
    """Bag union over the union of the fields; missing ones are null; ``None`` entries are skipped."""
    have = [p for p in parts if p is not None]
    if not have:
        raise ValueError("nothing to unite")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), have)


def ravel(df: DataFrame, fields: list[str], keep: list[str], index: str = "column") -> DataFrame:
    """Array fields to one row per element, in order."""
    zipped = F.arrays_zip(*fields)
    return df.select(*keep, F.posexplode(zipped).alias(index, "_v")).select(*keep, index, *[F.col(f"_v.{f}").alias(f) for f in fields])


def new_rows(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose keys do not occur in ``old`` (nulls compare equal); repeated rows stay."""
    o = old.select(*[F.col(k).alias(f"_o_{k}") for k in keys]).distinct()
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys])
    return new.join(o, cond, "left_anti")


def summary(df: DataFrame, fields: list[str]) -> DataFrame:
    """``field, n, std, min, max`` over valid values (population standard deviation); one pass."""
    aggs = []
    for f in fields:
        v = nan_to_null(F.col(f).cast("double"))
        aggs += [F.count(v).alias(f"{f}__n"), F.stddev_pop(v).alias(f"{f}__std"), F.min(v).alias(f"{f}__min"), F.max(v).alias(f"{f}__max")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(f).alias("field"), *[F.col(f"{f}__{k}").alias(k) for k in ("n", "std", "min", "max")]) for f in fields])
    return one.select(F.inline(rows))


def bounds(df: DataFrame, pad: float = 0.0) -> DataFrame:
    """One row ``x0, x1, y0, y1``; nulls for no valid point."""
    x, y = nan_to_null(F.col("x").cast("double")), nan_to_null(F.col("y").cast("double"))
    return df.agg((F.min(x) - pad).alias("x0"), (F.max(x) + pad).alias("x1"), (F.min(y) - pad).alias("y0"), (F.max(y) + pad).alias("y1"))


def distinct_rows(df: DataFrame, cols: list[str], row_id: str | None = None) -> DataFrame:
    """Distinct tuples; with ``row_id`` also the first row and the number of rows of each."""
    if row_id is None:
        return df.select(*cols).distinct()
    return df.groupBy(*cols).agg(F.min(row_id).cast("bigint").alias("first_row"), F.count("*").alias("n_rows"))


def distinct_bins(df: DataFrame, dx: float, dy: float | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """Centres ``x, y`` of the bins that hold a point; halves go to the even bin, null and NaN to none."""
    d = df.where(valid(x) & valid(y))
    return d.select((F.rint(F.col(x) / dx) * dx + 0.0).alias(x), (F.rint(F.col(y) / (dy or dx)) * (dy or dx) + 0.0).alias(y)).distinct()


def nearest(df: DataFrame, x0: float, y0: float, order: list[str], n: int = 1, x: str = "x", y: str = "y") -> DataFrame:
    """The ``n`` points nearest to a place; ties by ``order``.  Only the best of each task reach the last one."""
    dx, dy = F.col(x) - x0, F.col(y) - y0
    return df.where(valid(x) & valid(y)).orderBy(dx * dx + dy * dy, *order).limit(n)
