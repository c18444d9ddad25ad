"""Readers by format name: ``read(spark, "qi", path)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from firnline.sources import arrays, cryosat, geotiff, granules, icessn, qi

READERS: dict[str, Callable[..., DataFrame]] = {
    "qi": qi.read_qi,
    "icessn": icessn.read_icessn,
    "cs2_l2": cryosat.read_l2,
    "cs2_l1b": cryosat.read_l1b,
    "segments": granules.read_segments,
    "geotiff": geotiff.read_geotiff,
    "hdf5": arrays.read_hdf5,
    "netcdf": arrays.read_netcdf,
}


def register(name: str, reader: Callable[..., DataFrame]) -> None:
    """Add a reader of one's own (``reader(spark, path, **options)``)."""
    READERS[name] = reader


def read(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind not in READERS:
        raise ValueError(f"unknown format {kind!r}; known: parquet, {', '.join(sorted(READERS))}")
    return READERS[kind](spark, path, **options)
