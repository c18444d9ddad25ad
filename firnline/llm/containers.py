"""Filling containers of a fixed number of tokens.

Lengths are counted with a public tokenizer; a text longer than a container is
divided into whole containers and a rest, no other text is divided.  Dynamic
programming over the global histogram of lengths chooses bucket boundaries of
least padding, exactly over all distinct lengths.  A token-budget batch holds as
many items of one bucket as fit at its upper end; what space it leaves is topped
up from the shorter buckets.  Because
items of one length are interchangeable, the batches are planned on the
histogram alone (its size is bounded by the capacity, not by the data) and the
items find their container from their rank among the items of their length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firnline.common import broadcast_if_few, staged

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the splitting pattern that belongs to the vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CAPACITY = 8192
BUCKETS = 32
PARTS = 16  # fewest parts in which items of one length are ranked
ROWS_PER_PART = 2_000_000
_encoders: dict[int, object] = {}


def token_counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, n_tokens)``; null texts count 0 tokens, null ids are left out.  No shuffle.

    The vocabulary file (under 1 MB) is read by the driver and travels with the tasks.
    """
    raw = Path(vocabulary).read_bytes()
    if len(raw) > 16_000_000:
        raise ValueError("vocabulary larger than 16 MB")
    key = hash(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        if key not in _encoders:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
            _encoders[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        enc = _encoders[key]
        for b in batches:
            n = [len(enc.encode_ordinary(t.as_py())) if t.is_valid else 0 for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    base = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null")
    return base.mapInArrow(run, "doc_id bigint, n_tokens bigint").select(F.col("doc_id").alias(doc_id), "n_tokens")


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Upper ends of at most ``buckets`` buckets that minimise sum(count * (upper end - length)).

    Exact over all distinct lengths: the best start of the last bucket never
    moves back as its end grows, so a step halves its ranges of starts instead
    of trying all pairs.
    """
    n = len(lengths)
    if not n:
        return np.empty(0, np.int64)
    ends = lengths.astype(np.int64)
    c = np.r_[0, np.cumsum(counts)].astype(np.int64)
    s = np.r_[0, np.cumsum(counts * lengths)].astype(np.int64)
    best, back = ends * c[1:] - s[1:], []
    for _ in range(min(buckets, n) - 1):
        start, new = _last_starts(np.r_[0, best[:-1]], ends, c, s)
        back.append(start)
        best = new
    out, j = [n - 1], n - 1
    for start in reversed(back):
        if start[j] == 0:
            break
        j = int(start[j]) - 1
        out.append(j)
    return ends[sorted(out)]


def _last_starts(before: np.ndarray, ends: np.ndarray, c: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each end j the first start i of the last bucket of least ``before[i]`` plus padding of i..j, and that sum."""
    n = len(ends)
    start, new = np.zeros(n, np.int64), np.zeros(n, np.int64)
    lo, hi, a, b = np.array([0]), np.array([n - 1]), np.array([0]), np.array([n - 1])  # ends lo..hi have their starts in a..b
    while len(lo):
        mid = (lo + hi) // 2
        size = np.minimum(b, mid) - a + 1
        first = np.r_[0, np.cumsum(size)[:-1]]
        i = np.arange(size.sum()) - np.repeat(first, size) + np.repeat(a, size)
        j = np.repeat(mid, size)
        total = before[i] + ends[j] * (c[j + 1] - c[i]) - (s[j + 1] - s[i])
        least = np.minimum.reduceat(total, first)
        at = np.flatnonzero(total == np.repeat(least, size))
        at = at[np.searchsorted(at, first, "left")]
        start[mid], new[mid] = i[at], least
        lo, hi, a, b = np.r_[lo, mid + 1], np.r_[mid - 1, hi], np.r_[a, i[at]], np.r_[i[at], b]
        some = lo <= hi
        lo, hi, a, b = lo[some], hi[some], a[some], b[some]
    return start, new


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int, ends: np.ndarray) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs ``(length, first rank, end rank, first container, items per container)`` and the number of containers.

    From the longest bucket down, a batch is ``capacity // upper end`` items of
    the bucket, its longest first, which fit whatever their lengths are.  The
    space it leaves is topped up from the shorter buckets, longest first, and
    only what these cannot fill from its own bucket.  A pattern is repeated as
    often as its lengths last.
    """
    left = {int(a): int(b) for a, b in zip(lengths, counts) if a > 0}
    used = dict.fromkeys(left, 0)
    runs, containers = [], 0
    live = np.array(sorted(left), dtype=np.int64)  # ascending lengths still there
    while len(live):
        at = int(np.searchsorted(ends, live[-1], "left"))
        home = int(np.searchsorted(live, ends[at - 1], "right")) if at else 0  # first length of the bucket
        room, pattern = capacity, {}
        batch, i = capacity // int(ends[at]), len(live) - 1
        while i >= home and batch > 0:
            n = int(live[i])
            k = min(batch, left[n])
            pattern[n] = k
            batch -= k
            room -= k * n
            i -= 1
        for low, high in ((0, home), (home, len(live))):
            i = high - 1
            while i >= low and room > 0:
                i = min(i, int(np.searchsorted(live, room, "right")) - 1)
                if i < low:
                    break
                n = int(live[i])
                k = min(room // n, left[n] - pattern.get(n, 0))
                if k:
                    pattern[n] = pattern.get(n, 0) + k
                    room -= k * n
                i -= 1
        times = min(left[n] // k for n, k in pattern.items())
        for n, k in pattern.items():
            runs.append((n, used[n], used[n] + k * times, containers, k))
            used[n] += k * times
            left[n] -= k * times
        containers += times
        gone = [n for n in pattern if not left[n]]
        if gone:
            live = live[~np.isin(live, gone)]
    return runs, containers


def fill(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, buckets: int = BUCKETS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, piece, first_token, n_tokens, bucket_end, container_id)``, one row per item.

    Every text is one item, or, if longer than ``capacity``, pieces of exactly
    ``capacity`` tokens and a rest.  A text of no tokens takes no space and
    goes to container 0.  Repeated rows are items of their own; an empty table
    gives no rows.  No container holds more than ``capacity`` tokens.
    """
    tokens = token_counts(docs, doc_id=doc_id, text=text, vocabulary=vocabulary)
    # ``row`` and ``part`` fix order and split of the items, so that later ranks do not depend on how files are read
    tokens = staged(tokens.select(F.col(doc_id).alias("doc_id"), "n_tokens", F.spark_partition_id().alias("at"), F.monotonically_increasing_id().alias("row")), "tokens")
    # few parts, so that the table of lengths per part stays small: capacity x parts rows at most
    parts = max(PARTS, -(-tokens.count() // ROWS_PER_PART))
    tokens = tokens.withColumn("part", F.pmod("at", F.lit(parts))).drop("at")
    size = F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece") * capacity)
    last = F.greatest(F.ceil(F.col("n_tokens") / capacity) - 1, F.lit(0))
    items = tokens.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint")))).withColumn("length", size.cast("bigint"))
    by_part = staged(items.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    hist = by_part.groupBy("length").agg(F.sum("n").alias("n")).orderBy("length").toPandas()  # at most capacity + 1 rows
    lengths, counts = hist.length.to_numpy(np.int64), hist.n.to_numpy(np.int64)
    some = lengths > 0
    ends = boundaries(lengths[some], counts[some], buckets)
    runs, _ = plan(lengths[some], counts[some], capacity, ends)
    runs.sort()
    wide = np.int64(1) << 45  # room for the ranks of one length
    start = np.array([n * wide + a for n, a, *_ in runs], np.int64)
    first = np.array([a for _, a, *_ in runs], np.int64)
    base = np.array([c for *_, c, _ in runs], np.int64)
    per = np.array([k for *_, k in runs], np.int64)

    def place(length: pd.Series, rank: pd.Series) -> pd.Series:
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        out = np.zeros(len(n), np.int64)
        ok = n > 0
        j = np.searchsorted(start, n[ok] * wide + r[ok], "right") - 1
        out[ok] = base[j] + (r[ok] - first[j]) // per[j]
        return pd.Series(out)

    def upper(length: pd.Series) -> pd.Series:
        n = length.to_numpy(np.int64)
        return pd.Series(np.where(n > 0, ends[np.searchsorted(ends, n, "left").clip(0, max(0, len(ends) - 1))] if len(ends) else 0, 0))

    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = broadcast_if_few(staged(by_part.select("length", "part", F.coalesce(before, F.lit(0)).alias("off")), "offsets"), 200_000)
    own = F.row_number().over(W.partitionBy("length", "part").orderBy("row", "piece")) - 1
    ranked = items.withColumn("own", own).join(offsets, ["length", "part"]).withColumn("rank", F.col("off") + F.col("own"))
    where = F.pandas_udf(place, T.LongType())("length", "rank")
    return ranked.select(F.col("doc_id").alias(doc_id), "piece", (F.col("piece") * capacity).alias("first_token"), F.col("length").alias("n_tokens"), F.pandas_udf(upper, T.LongType())("length").alias("bucket_end"), where.alias("container_id"))


def filling(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, items, tokens, share of space used, most tokens in a container."""
    per = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("k"))
    return per.agg(F.count("*").alias("containers"), F.sum("k").alias("items"), F.sum("t").alias("tokens"), (F.sum("t") / (F.count("*") * capacity)).alias("used"), F.max("t").alias("fullest"))
