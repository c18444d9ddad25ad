"""Laser altimetry granules: one column per field path, long rows per beam.

A granule is read from HDF5 where ``h5py`` is installed, or from Parquet (or any
table) whose columns are named by the paths of the fields, such as
``gt1l/land_ice_segments/ground_track/x_atc``.  Both give the same rows.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.sources import altimetry, glas
from firnline.sources.arrays import decode, need, unpacked
from firnline.sources.packed import read_binary

PAIRS = (1, 2, 3)
_SEGMENTS = {n: g for g, names in altimetry.SEGMENT_FIELDS.items() if g != "derived" for n in names}


def beam_rows(df: DataFrame, *, pairs: tuple[int, ...] = PAIRS, fields: dict[str, str] | None = None, file: str = "source_file") -> DataFrame:
    """Long rows ``<file>, BP, beam, rgt, cycle_number`` and the fields, from columns named by path.

    ``fields`` maps a field to its group below the beam.  Fields a granule does
    not have are null, beams it does not have give no rows, nor do rows without
    segment number.  Track and cycle come from the granule's name.
    """
    fields = fields or _SEGMENTS
    have = set(df.columns)
    beams = []
    for p in pairs:
        for b in "lr":
            path = lambda n, p=p, b=b: f"gt{p}{b}/{fields[n]}/{n}"
            if not any(path(n) in have for n in fields):
                continue
            value = lambda n, path=path: F.col(f"`{path(n)}`").cast("double") if path(n) in have else F.lit(None).cast("double")
            beams.append(F.struct(F.lit(p).alias("BP"), F.lit(b).alias("beam"), *[value(n).alias(n) for n in fields]))
    schema = "struct<BP:int,beam:string," + ",".join(f"`{n}`:double" for n in fields) + ">"
    rows = df.select(F.col(file).alias("source_file"), F.inline(F.array(*beams) if beams else F.array().cast(f"array<{schema}>")))
    if "segment_id" in fields:
        rows = rows.where("segment_id is not null").withColumn("segment_id", F.col("segment_id").cast("bigint"))
    rgt, cycle = altimetry.granule_numbers(F.element_at(F.split("source_file", "/"), -1))
    return rows.withColumns({"rgt": rgt, "cycle_number": cycle})


def read_segments(spark: SparkSession, path: str, *, pairs: tuple[int, ...] = PAIRS, rows: tuple[int, int] | None = None, derive: bool = True) -> DataFrame:
    """Segments of all beams of the granules at ``path`` (Parquet by field path, or HDF5), with the derived columns.

    ``rows`` is a closed range of row numbers within each beam (HDF5 only).
    """
    if ".h5" in path:
        out = _from_hdf5(spark, path, pairs, rows)
    else:
        df = spark.read.option("mergeSchema", "true").parquet(path)
        out = beam_rows(df if "source_file" in df.columns else df.withColumn("source_file", F.col("_metadata.file_path")), pairs=pairs)
    return altimetry.derive_segments(out) if derive else out


def _from_hdf5(spark: SparkSession, path: str, pairs: tuple[int, ...], rows: tuple[int, int] | None) -> DataFrame:
    need("h5py")
    part = slice(rows[0], rows[1] + 1) if rows else slice(None)

    def run(_: str, content: bytes) -> pd.DataFrame:
        h5 = need("h5py").File(io.BytesIO(unpacked(content)), "r")
        out = []
        for p in pairs:
            for b in "lr":
                if f"gt{p}{b}/land_ice_segments/h_li" not in h5:
                    continue
                n = len(h5[f"gt{p}{b}/land_ice_segments/h_li"][part])
                got = {"BP": np.full(n, p), "beam": np.full(n, b, object)}
                for f, g in _SEGMENTS.items():
                    key = f"gt{p}{b}/{g}/{f}"
                    got[f] = decode(h5[key][part], h5[key].attrs.get("_FillValue", -9999)).astype(float) if key in h5 else np.full(n, np.nan)
                out.append(pd.DataFrame(got))
        return pd.concat(out) if out else pd.DataFrame(columns=["BP", "beam", *_SEGMENTS])

    got = read_binary(spark, path, run, "BP int, beam string, " + ", ".join(f"`{n}` double" for n in _SEGMENTS))
    rgt, cycle = altimetry.granule_numbers(F.element_at(F.split("source_file", "/"), -1))
    return got.withColumns({"segment_id": F.col("segment_id").cast("bigint"), "rgt": rgt, "cycle_number": cycle})


def shots(df: DataFrame, *, latitudes: tuple[float, float] | None = None, filters: bool = True) -> DataFrame:
    """Laser shots from columns named ``.../group/d_field``: tidy names, corrected ``z`` with campaign bias, filters.

    The campaign is a column ``campaign`` (number) where the table has one.
    """
    names = {c: c.split("/")[-1] for c in df.columns}
    out = glas.tidy_names(df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]))
    if latitudes:
        out = glas.latitude_range(out, *latitudes)
    if filters:
        out = glas.apply_filters(out)
    out = glas.apply_corrections(out)
    return out.withColumn("z", F.col("z") + glas.campaign_bias(F.col("campaign"))) if "campaign" in out.columns else out
