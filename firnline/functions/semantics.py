"""Rounding, bins and missing values: what every operator agrees on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_bin(c: Column | str, delta: float, origin: float = 0.0) -> Column:
    """Number of the bin whose centre is nearest; halves go to the even bin."""
    return F.rint((col(c) - origin) / delta).cast("bigint")


def floor_bin(c: Column | str, delta: float, origin: float = 0.0) -> Column:
    return F.floor((col(c) - origin) / delta).cast("bigint")


def valid(c: Column | str) -> Column:
    """Neither null nor NaN."""
    c = col(c)
    return c.isNotNull() & ~F.isnan(c)


def nan_to_null(c: Column | str) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)
