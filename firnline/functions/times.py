"""Epochs of altimetry products as column expressions; all results are doubles or microseconds of UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: days from 2000-01-01 to the UTC dates on which TAI-UTC grew by a second, and TAI-UTC from then on
LEAPS_2000 = ((2192, 33), (3288, 34), (4565, 35), (5660, 36), (6210, 37))
TAI_UTC_2000 = 32
# fixed values: GPS seconds (since 1980-01-06) at which a leap second had been added, 1981 to 2017
GPS_LEAPS = (
    46828800, 78364801, 109900802, 173059203, 252028804, 315187205, 346723206, 393984007, 425520008,
    457056009, 504489610, 551750411, 599184012, 820108813, 914803214, 1025136015, 1119744016, 1167264017,
)
US_2000 = 946_684_800_000_000  # 2000-01-01 in microseconds since 1970
US_2018 = 1_514_764_800_000_000
MATLAB_2018 = 737061.0
MATLAB_2000 = 730486.0
J2K_GPS_DAYS = 7300.0  # 1980-01-06 to 2000-01-01


def tai2000_to_utc_us(day: Column, second: Column, micsec: Column) -> Column:
    """UTC microseconds since 1970 of TAI days, seconds, microseconds since 2000-01-01."""
    s = day.cast("bigint") * 86400 + second.cast("bigint")
    off = F.lit(TAI_UTC_2000)
    for d, n in LEAPS_2000:
        off = off + F.when(s >= d * 86400 + n, 1).otherwise(0)
    return (s - off) * 1_000_000 + micsec.cast("bigint") + US_2000


def delta_time_to_us(delta: Column) -> Column:
    return F.round(delta * 1e6).cast("bigint") + US_2018


def days_j2k_to_us(days: Column) -> Column:
    return F.round(days * 86400e6).cast("bigint") + US_2000


def delta_time_to_matlab(delta: Column) -> Column:
    return MATLAB_2018 + delta / 86400


def seconds_j2k_to_matlab(delta: Column) -> Column:
    return MATLAB_2000 + delta / 86400


def days_j2k_to_year(days: Column) -> Column:
    return days / 365.25 + 2000


def leap_seconds(gps: Column) -> Column:
    """Number of leap seconds added up to a GPS time in seconds."""
    return F.size(F.filter(F.array(*[F.lit(float(v)) for v in GPS_LEAPS]), lambda v: v <= gps)).cast("bigint")


def gps_from_tai2000(day: Column, second: Column, micsec: Column) -> Column:
    """GPS seconds of TAI days, seconds, microseconds since 2000-01-01."""
    return day * 86400.0 + second + micsec / 1e6 + J2K_GPS_DAYS * 86400 - 19


def gps_from_calendar(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """Seconds from 1980-01-06 to a calendar date and time without leap seconds."""
    date = F.make_date(year.cast("int"), month.cast("int"), day.cast("int"))
    days = F.datediff(date, F.lit("1980-01-06").cast("date"))
    return days * 86400.0 + hour * 3600.0 + minute * 60.0 + second


def gps_to_days_j2k(gps: Column) -> Column:
    return (gps - leap_seconds(gps)) / 86400.0 - J2K_GPS_DAYS
