"""Shared plumbing: table access, shared scratch folder, small helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """One test table, pruned to ``columns`` so the scan reads nothing else."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset
    and everything runs on this machine a temporary folder is made and set.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if base:
        return base
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    base = "file://" + os.path.join(tempfile.gettempdir(), f"firnline-{os.getpid()}")
    sc.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; what is written there goes when the driver ends."""
    home = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    path = spark._jvm.org.apache.hadoop.fs.Path(home)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return f"{home}/data"


def staged(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage with a table that survives the loss of executors, and lets
    several consumers share one computation.
    """
    path = scratch(df.sparkSession, name)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def finite(c: Column | str) -> Column:
    """``c`` as double, NaN and infinities turned into null."""
    v = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), v)


def hashed(*cols: Column | str) -> Column:
    """64-bit hash used to spread rows evenly over tasks."""
    return F.xxhash64(*cols)


def broadcast_if_few(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """``df`` marked for broadcast if it is proven to have at most ``rows`` (narrow) rows, else unmarked.

    Pass a staged or otherwise cheap ``df``: its rows are counted up to the bound.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
