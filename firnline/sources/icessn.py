"""ICESSN text: comma-separated with a comment header, or separated by spaces."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.common import broadcast_if_few
from firnline.functions.filenames import icessn_days

# fixed value: the header of files that have none
HEADER = (
    "UTC_Seconds_Of_Day, Latitude(deg), Longitude(deg), WGS84_Ellipsoid_Height(m), South-to-North_Slope, West-to-East_Slope, RMS_Fit(cm), "
    "Number_Of_ATM_Measurments_Used, Number_Of_ATM_Measurements_Removed, Distance_Of_Block_To_The_Right_Of_Aircraft(m), Track_Identifier"
)


def short_names(header: str) -> list[str]:
    """``UTC_Seconds_Of_Day(s)`` and the like to ``utc_seconds_of_day``."""
    parts = [p.strip() for p in header.lstrip("# ").split(",")]
    return [re.sub(r"\(.*", "", p).replace("-", "_").lower().strip() for p in parts]


def read_icessn(spark: SparkSession, path: str) -> DataFrame:
    """Points with the fields of the standard header, ``z``, ``sigma``, ``time`` (decimal year), ``days_J2k``, the reference frame named in a comment, and the file.

    Every file is read by its own header, a comment line of at least nine
    names (of several the one that sorts last), or the standard one; names the
    standard header does not have are in the map ``other``.  Lines that are no
    numbers, or fewer than the header has names, are left out.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source_file"))
    comment = F.col("value").startswith("#")
    names = F.transform(F.split(F.ltrim(F.col("value"), F.lit("# ")), ","), lambda c: F.trim(F.lower(F.replace(F.regexp_replace(c, r"\(.*", ""), F.lit("-"), F.lit("_")))))
    header = F.when(F.regexp_count("value", F.lit(",")) >= 8, names)
    about = lines.where(comment).groupBy("source_file").agg(F.max(F.nullif(F.regexp_extract("value", r"(ITRF\d\d)", 1), F.lit(""))).alias("frame"), F.max(header).alias("names"))
    v = F.transform(F.split(F.trim("value"), r"\s*,\s*|\s+"), lambda s: s.try_cast("double"))
    data = lines.where(~comment & (F.length(F.trim("value")) > 0)).select("source_file", v.alias("v"))
    standard = short_names(HEADER)
    data = data.join(broadcast_if_few(about), "source_file", "left").withColumn("names", F.coalesce("names", F.array(*map(F.lit, standard))))
    data = data.where((F.size("v") >= F.size("names")) & ~F.exists("v", lambda x: x.isNull()))
    by_name = F.map_from_arrays(F.array_distinct("names"), F.slice("v", 1, F.size(F.array_distinct("names"))))
    data = data.where(F.size(F.array_distinct("names")) == F.size("names")).select("source_file", "frame", by_name.alias("m"))
    out = data.select("source_file", *[F.try_element_at("m", F.lit(n)).alias(n) for n in standard], F.map_filter("m", lambda k, x: ~k.isin(standard)).alias("other"), "frame")
    days = icessn_days(F.col("source_file")) + F.col("utc_seconds_of_day") / 86400
    return out.withColumns({"days_J2k": days, "time": 2000 + days / 365.25, "z": F.col("wgs84_ellipsoid_height"), "sigma": F.col("rms_fit")})
