"""Scanning-lidar ``qi`` files: fixed records of 10, 12 or 14 32-bit words in either byte order."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from firnline.functions.times import GPS_LEAPS
from firnline.sources.packed import read_binary

# fixed values: names and divisors of the words of a record, by record length
COMMON = [("rel_time", 1e3), ("latitude", 1e6), ("longitude", 1e6), ("elevation", 1e3), ("xmt_sigstr", 1), ("rcv_sigstr", 1), ("azimuth", 1e3), ("pitch", 1e3), ("roll", 1e3)]
WORDS = {
    10: [*COMMON, ("time_hhmmss", 1e3)],
    12: [*COMMON, ("gps_pdop", 1e1), ("pulse_width", 1), ("time_hhmmss", 1e3)],
    14: [*COMMON, ("passive_sig", 1), ("pass_foot_lat", 1e6), ("pass_foot_long", 1e6), ("pass_foot_synth_elev", 1e3), ("time_hhmmss", 1e3)],
}
NAME = re.compile(r"(?:BLATM1B|ILATM1B|ILNSA1B)_(\d{8}|\d{6})")
FIELDS = list(dict.fromkeys(n for w in (10, 12, 14) for n, _ in WORDS[w]))


def file_date(path: str) -> np.datetime64 | None:
    m = NAME.search(path)
    if not m:
        return None
    d = m[1]
    if len(d) == 6:
        d = ("19" if int(d[:2]) >= 90 else "20") + d
    return np.datetime64(f"{d[:4]}-{d[4:6]}-{d[6:]}")


def decode(path: str, content: bytes, rows: tuple[int, int] | None = None) -> pd.DataFrame:
    """Scaled records of one file, ``days_J2k`` (UTC) included; words a format lacks are null."""
    order = ">" if 0 < int.from_bytes(content[:4], "big") <= 100 else "<"
    words = int(np.frombuffer(content, order + "i4", 1)[0]) // 4
    if words not in WORDS:
        raise ValueError(f"{path}: records of {words} words")
    rec = np.frombuffer(content[: len(content) // (4 * words) * 4 * words], order + "i4").reshape(-1, words)[1:]
    # header lines begin with a negative word
    start = int(np.argmax(rec[:, 0] >= 0)) if len(rec) and (rec[:, 0] >= 0).any() else len(rec)
    rec = rec[start:]
    if rows:
        rec = rec[rows[0] : rows[1] + 1]
    out = {n: np.full(len(rec), np.nan) for n in FIELDS}
    for i, (n, s) in enumerate(WORDS[words]):
        out[n] = rec[:, i] / s
    t = rec[:, -1].astype(np.int64)  # hhmmss in thousandths
    seconds = t // 10_000_000 * 3600 + t // 100_000 % 100 * 60 + t % 100_000 / 1000
    date = file_date(path)
    gps = (date - np.datetime64("1980-01-06")).astype(int) * 86400.0 + seconds if date is not None else np.full(len(rec), np.nan)
    leaps = np.searchsorted(np.array(GPS_LEAPS, float), gps, "right")
    out["days_J2k"] = (gps - leaps) / 86400 - 7300
    out["row_number"] = np.arange(len(rec)) + (rows[0] if rows else 0)
    return pd.DataFrame(out)


SCHEMA = ", ".join(f"`{n}` double" for n in [*FIELDS, "days_J2k"]) + ", row_number bigint"


def encode(d: pd.DataFrame, words: int = 12, order: str = ">") -> bytes:
    """A file of the rows' fields; ``time_hhmmss`` and fields not given are zero."""
    rec = np.zeros((len(d) + 1, words), order + "i4")
    rec[0, 0] = 4 * words
    for i, (n, s) in enumerate(WORDS[words]):
        if n in d.columns:
            rec[1:, i] = np.rint(d[n].to_numpy() * s)
    return rec.tobytes()


def read_qi(spark: SparkSession, path: str) -> DataFrame:
    return read_binary(spark, path, decode, SCHEMA)
