"""Square bins: statistics, block medians, robust spread, neighbouring bins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.functions.semantics import floor_bin, round_bin, valid
from firnline.operators.ranks import rank_within


def bin_stats(df: DataFrame, res: float, aggs: dict[str, Column], x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """Centre ``x``, ``y`` of each round bin with ``aggs`` and ``count``; combined before the shuffle."""
    b = df.withColumns({"bx": round_bin("x", res, x0), "by": round_bin("y", res, y0)})
    out = b.groupBy("bx", "by").agg(*[v.alias(k) for k, v in aggs.items()], F.count("*").alias("count"))
    return out.select((F.col("bx") * res + x0).alias("x"), (F.col("by") * res + y0).alias("y"), *aggs, "count")


def bin_apply(df: DataFrame, res: float, fn: Callable, schema: str) -> DataFrame:
    """An arbitrary pandas function per bin (``fn(frame) -> frame``); bins must fit a task."""
    b = df.withColumns({"bx": round_bin("x", res), "by": round_bin("y", res)})
    return b.groupBy("bx", "by").applyInPandas(fn, schema)


def block_median(df: DataFrame, delta: float, fields: list[str], order: list[str], *, z: str = "z", x0: float = 0.0, y0: float = 0.0, **kw) -> DataFrame:
    """The row of median ``z`` per floor bin; for an even count the mean of the two middle rows.

    ``order`` makes the sequence of equal ``z`` total.  Points without valid z
    are left out.  ``count`` is the number of points of the bin.
    """
    b = df.where(valid(z)).withColumns({"bx": floor_bin("x", delta, x0), "by": floor_bin("y", delta, y0)})
    r = rank_within(b, ["bx", "by"], [z, *order], "rn", "n", **kw)
    mid = F.col("rn").isin(0) | (F.col("rn") == F.floor((F.col("n") + 1) / 2)) | (F.col("rn") == F.floor(F.col("n") / 2) + 1)
    return r.where(mid).groupBy("bx", "by").agg(*[F.avg(f).alias(f) for f in fields], F.max("n").alias("count"))


def block_median_nearest(df: DataFrame, delta: float, fields: list[str], order: list[str], *, z: str = "z", **kw) -> DataFrame:
    """As ``block_median``, but of two middle rows the one nearer the bin centre; the second if equally near."""
    b = df.where(valid(z)).withColumns({"bx": floor_bin("x", delta), "by": floor_bin("y", delta)})
    r = rank_within(b, ["bx", "by"], [z, *order], "rn", "n", **kw)
    mid = (F.col("rn") == F.floor((F.col("n") + 1) / 2)) | (F.col("rn") == F.floor(F.col("n") / 2) + 1)
    dx, dy = F.col("x") - (F.col("bx") + 0.5) * delta, F.col("y") - (F.col("by") + 0.5) * delta
    best = F.min_by(F.struct(*fields), F.struct(dx * dx + dy * dy, -F.col("rn")))
    return r.where(mid).groupBy("bx", "by").agg(best.alias("_b"), F.max("n").alias("count")).select("bx", "by", *[F.col(f"_b.{f}").alias(f) for f in fields], "count")


def robust_spread(df: DataFrame, group: list[str], value: str, order: list[str], **kw) -> DataFrame:
    """Half the width between the 16th and 84th percentile (positions p*n - 0.5), null below two values."""
    r = rank_within(df.where(valid(value)), group, [value, *order], "rn", "n", **kw)
    n = F.col("n")

    def part(p: float) -> Column:
        at = F.least(F.greatest(n * p - 0.5, F.lit(0.0)), n - 1.0)
        return F.sum(F.greatest(F.lit(0.0), 1 - F.abs(F.col("rn") - 1 - at)) * F.col(value))

    return r.groupBy(*group).agg(F.max("n").alias("n"), F.when(F.max("n") >= 2, (part(0.84) - part(0.16)) / 2).alias("rde"))


def pad_bins(bins: DataFrame, pad: int, bx: str = "bx", by: str = "by") -> DataFrame:
    """Bins (by number) and all within ``pad`` of them, once each."""
    steps = lambda: F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(-pad, pad + 1)]))
    out = bins.select(bx, by).withColumn("_i", steps()).withColumn("_j", steps())
    return out.select((F.col(bx) + F.col("_i")).alias(bx), (F.col(by) + F.col("_j")).alias(by)).distinct()


def dilate_bins(bins: DataFrame, bx: str = "bx", by: str = "by") -> DataFrame:
    return pad_bins(bins, 1, bx, by)
