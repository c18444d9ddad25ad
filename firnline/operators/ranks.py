"""Numbering rows globally and inside groups without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from firnline.common import broadcast_if_few, staged

HOT_ROWS = 2_000_000  # groups above this are ranked across tasks


def _placed(df: DataFrame, cols: list[Column | str]) -> DataFrame:
    """Rows in global order: ``_part`` and ``_at`` (running number in the part), fixed by writing them."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mid = F.monotonically_increasing_id()
    out = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols).withColumn("_m", mid)
    return staged(out.withColumns({"_part": F.shiftright("_m", 33).cast("int"), "_at": F.col("_m").bitwiseAND((1 << 33) - 1)}).drop("_m"), "order")


def global_index(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``name`` = 0-based position in the order of ``order``, by range partitions and their row counts."""
    rows = _placed(df, order)
    size = rows.groupBy("_part").agg(F.count("*").alias("n"))  # one row per partition
    off = size.select("_part", F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return rows.join(F.broadcast(off), "_part").withColumn(name, F.col("_off") + F.col("_at")).drop("_part", "_at", "_off")


def rank_within(df: DataFrame, group: list[str], order: list[str], rank: str = "rn", size: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """1-based ``rank`` inside ``group`` by ``order`` (total), and the group's ``size``.

    Groups are ranked by an ordinary window; groups of more than ``hot_rows``
    rows are ranked over range partitions of (group, order) and the row counts
    of the parts before.
    """
    hot = df.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows).select(*group, "_n")
    w = W.partitionBy(*group)
    cols = {rank: F.row_number().over(w.orderBy(*order))} | ({size: F.count("*").over(w)} if size else {})
    if not hot.limit(1).count():
        return df.withColumns(cols)
    hot = staged(hot, "hot")  # at most rows / hot_rows
    cold = df.join(broadcast_if_few(hot.drop("_n")), group, "left_anti").withColumns(cols)
    rows = _placed(df.join(broadcast_if_few(hot), group), [*group, *order])
    part = rows.groupBy("_part", *group).agg(F.count("*").alias("_k"), F.min("_at").alias("_first"))
    part = part.withColumn("_off", F.coalesce(F.sum("_k").over(W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    warm = rows.join(broadcast_if_few(staged(part.drop("_k"), "offsets")), ["_part", *group]).withColumn(rank, (F.col("_at") - F.col("_first") + F.col("_off") + 1).cast("int"))
    warm = warm.withColumnRenamed("_n", size) if size else warm.drop("_n")
    return cold.unionByName(warm.drop("_part", "_at", "_first", "_off"))
