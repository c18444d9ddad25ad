"""Spatial index over many files: which rows of which file lie in which bin."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from firnline.common import broadcast_if_few, staged
from firnline.functions.crs import add_latlon, add_xy
from firnline.functions.semantics import round_bin
from firnline.operators.binning import pad_bins


def _bin_type(delta: float, dy: float | None = None) -> str:
    """Bin centres are whole numbers where the spacing is, else doubles."""
    return "bigint" if float(delta).is_integer() and float(dy or delta).is_integer() else "double"


def build_index(df: DataFrame, delta: float, *, file: str = "src", offset: str = "pt_id", dy: float | None = None) -> DataFrame:
    """``file, bin_x, bin_y`` (bin centres) with the first and last offset and the number of rows; one shuffle for all files."""
    kind = _bin_type(delta, dy)
    b = df.select(file, offset, (round_bin("x", delta) * delta).cast(kind).alias("bin_x"), (round_bin("y", dy or delta) * (dy or delta)).cast(kind).alias("bin_y"))
    return b.groupBy(file, "bin_x", "bin_y").agg(F.min(offset).cast("bigint").alias("offset_start"), F.max(offset).cast("bigint").alias("offset_end"), F.count("*").alias("n"))


def merge_index(indexes: list[DataFrame], file: str = "src") -> DataFrame:
    """One index of several; a file already present in an earlier one is skipped; files are renumbered."""
    tagged = [d.withColumn("_seq", F.lit(i)) for i, d in enumerate(indexes)]
    every = reduce(lambda a, b: a.unionByName(b), tagged)
    first = every.groupBy(file).agg(F.min("_seq").alias("_seq"))
    number = first.withColumn("file_num", (F.row_number().over(W.orderBy("_seq", file)) - 1).cast("bigint"))  # one row per file
    return every.join(broadcast_if_few(number), [file, "_seq"]).drop("_seq")


def query_bins(index: DataFrame, bins: DataFrame, *, pad: int = 0, delta: float = 1.0, dy: float | None = None) -> DataFrame:
    """Index rows whose bin is among ``bins`` (centres ``bin_x, bin_y``), widened by ``pad`` bins."""
    q = bins.select("bin_x", "bin_y").distinct()
    if pad:
        kind = _bin_type(delta, dy)
        k = q.select(F.rint(F.col("bin_x") / delta).cast("bigint").alias("bx"), F.rint(F.col("bin_y") / (dy or delta)).cast("bigint").alias("by"))
        q = pad_bins(k, pad).select((F.col("bx") * delta).cast(kind).alias("bin_x"), (F.col("by") * (dy or delta)).cast(kind).alias("bin_y"))
    return index.join(broadcast_if_few(q), ["bin_x", "bin_y"], "left_semi")


def query_latlon(index: DataFrame, places: DataFrame, crs: str | int, delta: float, *, pad: int = 0, dy: float | None = None) -> DataFrame:
    """Index rows of the bins that hold the ``latitude, longitude`` of ``places``, projected to the index's ``crs``."""
    xy = add_xy(places.select("latitude", "longitude"), crs).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    kind = _bin_type(delta, dy)
    bins = xy.select((round_bin("x", delta) * delta).cast(kind).alias("bin_x"), (round_bin("y", dy or delta) * (dy or delta)).cast(kind).alias("bin_y"))
    return query_bins(index, bins, pad=pad, delta=delta, dy=dy)


def bin_latlon(index: DataFrame, crs: str | int) -> DataFrame:
    """Latitude and longitude of the bin centres of an index."""
    return add_latlon(index.select("*", F.col("bin_x").cast("double").alias("x"), F.col("bin_y").cast("double").alias("y")), crs).drop("x", "y")


def bin_key(x: Column, y: Column) -> Column:
    """``x_y`` of a bin centre, without decimals."""
    return F.concat_ws("_", F.format_string("%.0f", x.cast("double")), F.format_string("%.0f", y.cast("double")))


def parse_bin_key(key: Column) -> tuple[Column, Column]:
    """(x, y) of a key; null where the text is none."""
    part = lambda i: F.nullif(F.regexp_extract(key, r"^(-?\d+)_(-?\d+)$", i), F.lit("")).try_cast("double")
    return part(1), part(2)


def resolve_index(index: DataFrame, children: DataFrame, *, file: str = "src", kind: str = "file_type", index_kind: str = "indexed_h5", most: int = 8) -> DataFrame:
    """Rows of an index of indexes down to the files themselves.

    A row whose ``kind`` is ``index_kind`` names an index of its own, whose rows
    stand in ``children`` under ``parent`` and have the same bins; it is
    replaced by them, level by level.  Rows of an index that ``children`` does
    not have give nothing; a chain deeper than ``most`` levels is an error.
    """
    done, rest = index.where(~F.coalesce(F.col(kind) == index_kind, F.lit(False))), index.where(F.col(kind) == index_kind)
    for _ in range(most):
        if not rest.limit(1).count():
            return done
        keys = rest.select(F.col(file).alias("parent"), "bin_x", "bin_y").distinct()
        below = staged(children.join(broadcast_if_few(keys), ["parent", "bin_x", "bin_y"], "left_semi").select(*index.columns), "level")
        done = done.unionByName(below.where(~F.coalesce(F.col(kind) == index_kind, F.lit(False))))
        rest = below.where(F.col(kind) == index_kind)
    if rest.limit(1).count():
        raise ValueError(f"indexes nested deeper than {most} levels")
    return done


def query_box(index: DataFrame, x: tuple[float, float], y: tuple[float, float]) -> DataFrame:
    return index.where(F.col("bin_x").between(*x) & F.col("bin_y").between(*y))


def intersect(a: DataFrame, b: DataFrame, pads: tuple[int, int], delta: float, dy: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of each index in the bins both have, each widened by its own pad."""
    both = a.select("bin_x", "bin_y").intersect(b.select("bin_x", "bin_y"))
    return query_bins(a, both, pad=pads[0], delta=delta, dy=dy), query_bins(b, both, pad=pads[1], delta=delta, dy=dy)


def coalesce_ranges(index: DataFrame, file: str = "src") -> DataFrame:
    """Row ranges per file with overlapping and adjacent ones joined (inclusive ends)."""
    w = W.partitionBy(file).orderBy("offset_start", "offset_end")
    reach = F.max("offset_end").over(w.rowsBetween(W.unboundedPreceding, -1))
    r = index.withColumn("_new", F.when(reach.isNull() | (F.col("offset_start") > reach + 1), 1).otherwise(0))
    r = r.withColumn("_isle", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return r.groupBy(file, "_isle").agg(F.min("offset_start").alias("offset_start"), F.max("offset_end").alias("offset_end")).drop("_isle")


def points_of(points: DataFrame, ranges: DataFrame, bins: DataFrame | None, delta: float, *, file: str = "src", offset: str = "pt_id", dy: float | None = None) -> DataFrame:
    """Points whose exact bin is among ``bins`` of the listed files (the strict reading of a query)."""
    kind = _bin_type(delta, dy)
    b = points.withColumns({"bin_x": (round_bin("x", delta) * delta).cast(kind), "bin_y": (round_bin("y", dy or delta) * (dy or delta)).cast(kind)})
    out = b.join(broadcast_if_few(ranges.select(file).distinct()), file, "left_semi")
    return out if bins is None else out.join(broadcast_if_few(bins.select("bin_x", "bin_y").distinct()), ["bin_x", "bin_y"], "left_semi")


def read_ranges(ranges: DataFrame, reader: Callable[[str, int, int], pd.DataFrame], schema: str, *, file: str = "file", error_action: str = "warn") -> DataFrame:
    """Rows that ``reader(file, first, last)`` returns for each range of a query result, ends included.

    Ranges are spread over the tasks by file.  A file that is missing gives no
    rows; another error of a reader is logged and skipped with
    ``error_action="warn"`` and raised with ``"raise"``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for f, a, b in zip(d[file], d.offset_start, d.offset_end):
                try:
                    yield reader(f, int(a), int(b))
                except FileNotFoundError:
                    continue
                except Exception as problem:
                    if error_action == "raise":
                        raise
                    logging.getLogger(__name__).warning("%s: %s", f, problem)

    return ranges.select(file, "offset_start", "offset_end").repartition(file).mapInPandas(run, schema)


def clean_path(path: Column) -> Column:
    """Repeated slashes as one."""
    return F.regexp_replace(path, "/+", "/")


def resolve_path(name: Column, root: Column, index_dir: Column) -> Column:
    """Absolute names stay; others hang below ``root``, or below the index's folder if there is none."""
    return clean_path(F.when(name.startswith("/"), name).when(root.isNotNull() & (root != ""), F.concat(root, F.lit("/"), name)).otherwise(F.concat(index_dir, F.lit("/"), name)))


def change_root(name: Column, old: str, new: str) -> Column:
    return clean_path(F.when(name.startswith(old), F.concat(F.lit(new), F.substr(name, F.lit(len(old) + 1)))).otherwise(F.concat(F.lit(new + "/"), name)))


def trim_slashes(path: Column) -> Column:
    return clean_path(F.regexp_replace(path, "^/+|/+$", ""))
