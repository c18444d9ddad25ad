"""Dates written in file names, as column expressions; null where the name has none.

One tokenizer serves all kinds of names: a name is cut into runs of digits with
what follows them, and a run counts as a date only if the calendar has it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

J2000 = "2000-01-01"
DAY_S = 86400.0


def _day(digits: Column) -> Column:
    """Days since 2000 of YYYYMMDD; null if there is no such day."""
    text = F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2))
    return F.when(F.length(digits) == 8, F.datediff(text.try_cast("date"), F.lit(J2000).cast("date")).cast("double"))


def _seconds(digits: Column) -> Column:
    """Seconds of the day of HHMMSS; null if it is no time."""
    h, m, s = (F.substring(digits, i, 2).try_cast("int") for i in (1, 3, 5))
    return F.when((F.length(digits) == 6) & (h < 24) & (m < 60) & (s < 60), h * 3600 + m * 60 + s)


def dates(name: Column) -> Column:
    """Every date of a name, in order: ``day`` and, if a time is joined to it by one character, ``seconds``; ``short`` marks YYMMDD,
    ``joint`` is the text behind the date and ``at`` the number of its run."""
    runs = F.regexp_extract_all(name, F.lit(r"\d+\D*"), F.lit(0))
    head = lambda t: F.regexp_extract(F.coalesce(t, F.lit("")), r"^\d+", 0)

    def one(t: Column, i: Column) -> Column:
        digits, joint = head(t), F.regexp_replace(t, r"^\d+", "")
        short = F.length(digits) == 6
        day = _day(F.when(short, F.concat(F.lit("20"), digits)).otherwise(digits))
        seconds = F.when(F.length(joint) == 1, _seconds(head(F.get(runs, i + 1))))
        return F.struct(day.alias("day"), seconds.alias("seconds"), short.alias("short"), joint.alias("joint"), i.alias("at"))

    return F.filter(F.transform(runs, one), lambda d: d["day"].isNotNull())


def _with_time(d: Column) -> Column:
    return d["day"] + d["seconds"] / DAY_S


def granule_days(name: Column) -> Column:
    """UTC days since 2000-01-01 of the first date of eight digits with a time behind it."""
    return _with_time(F.get(F.filter(dates(name), lambda d: d["seconds"].isNotNull() & ~d["short"]), F.lit(0)))


def icessn_days(name: Column) -> Column:
    """Days since 2000-01-01 of the first date, of eight or six digits, with a time behind it."""
    return F.get(F.filter(dates(name), lambda d: d["seconds"].isNotNull()), F.lit(0))["day"]


def dem_days(name: Column) -> Column:
    """Days since 2000-01-01 of a model's name: the last bare date since 2000 behind some number, else the first with a time joined by another sign."""
    long = F.filter(dates(name), lambda d: ~d["short"])
    bare = F.filter(long, lambda d: d["joint"].startswith("_") & (d["at"] > 0) & (d["day"] >= 0))
    timed = F.filter(long, lambda d: d["seconds"].isNotNull())
    return F.coalesce(F.try_element_at(bare, F.lit(-1))["day"], _with_time(F.get(timed, F.lit(0))))


def dem_year(name: Column) -> Column:
    return 2000 + dem_days(name) / 365.25


def dem_matlab(name: Column) -> Column:
    return dem_days(name) + 730486.0
