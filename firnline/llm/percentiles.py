"""Percentiles of very large columns by deterministic buffer collapsing.

A sketch is a set of sorted buffers of ``K`` values, each with an integer
weight, and one short buffer of weight 1.  As soon as ``FAN`` buffers of one
weight exist they collapse into one buffer of ``FAN`` times that weight, which
keeps the values at evenly spaced positions of the weighted merge.  Collapsing
only equal weights makes the merge tree balanced, however the parts are
joined.  Each sketch carries the sum W of weights and the number C of its
collapses, which bound the rank error of any percentile.  A collapse into
weight w keeps the ranks w/2 (or (w+1)/2 if w is odd) of every stretch of w
ranks, so it shifts a rank by at most w/2, and the last position found may lie
within one buffer element: at most ``(W + C - 1) / 2 + heaviest weight`` ranks,
whatever the order and place of the collapses (the sharper figure with -C needs
offsets that alternate over the whole tree, which parts built apart do not).  Sketches of
partitions, days or runs join into one of the union without reading values
again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.common import finite, hashed, staged

K = 512
FAN = 8
HELD = 2_000_000  # values a partition holds before it passes its sketches on


class Sketch:
    """Buffers by weight; ``short`` are values of weight 1 that fill no buffer yet."""

    __slots__ = ("short", "held", "full", "weights", "collapses")

    def __init__(self):
        self.short: list[np.ndarray] = []
        self.held = 0
        self.full: dict[int, list[np.ndarray]] = {}
        self.weights = 0
        self.collapses = 0

    def add(self, values: np.ndarray) -> None:
        self.short.append(values)
        self.held += len(values)
        if self.held >= K:
            v = np.concatenate(self.short)
            whole = len(v) // K * K
            self.short, self.held = [v[whole:]], len(v) - whole
            for i in range(0, whole, K):
                self.buffer(1, np.sort(v[i : i + K]))

    def buffer(self, weight: int, values: np.ndarray) -> None:
        same = self.full.setdefault(weight, [])
        same.append(values)
        if len(same) == FAN:
            del self.full[weight]
            total = weight * FAN
            merged = np.sort(np.concatenate(same))  # all of one weight: position p stands for ranks p*weight ...
            # evenly spaced weighted positions; the middle of each stretch of ``total`` ranks,
            # alternately below and above it where there is no middle
            mid = (total + 1) // 2 if total % 2 else total // 2 + self.collapses % 2
            at = mid + np.arange(K, dtype=np.int64) * total
            self.weights += total
            self.collapses += 1
            self.buffer(total, merged[(at - 1) // weight])

    def rows(self) -> list[tuple[int, np.ndarray, int, int]]:
        """(weight, values, sum of collapse weights, collapses); the figures stand in the first row."""
        out = [(1, np.concatenate(self.short) if self.short else np.empty(0), self.weights, self.collapses)]
        return out + [(w, b, 0, 0) for w in sorted(self.full) for b in self.full[w]]

    def take(self, weight: int, values: np.ndarray, weights: int, collapses: int) -> None:
        self.weights += weights
        self.collapses += collapses
        if weight == 1 and len(values) < K:
            self.add(values)
        else:
            self.buffer(weight, values)

    def quantiles(self, probs: list[float]) -> tuple[int, list[float], int]:
        """(count, values, bound of the rank error)."""
        parts = [(1, np.concatenate(self.short))] if self.held else []
        parts += [(w, b) for w, bs in self.full.items() for b in bs]
        v = np.concatenate([b for _, b in parts])
        w = np.concatenate([np.full(len(b), w, np.int64) for w, b in parts])
        order = np.argsort(v, kind="stable")
        upto = np.cumsum(w[order])
        n = int(upto[-1])
        rank = np.maximum(1, np.ceil(np.asarray(probs) * n - 1e-9)).astype(np.int64)
        got = v[order][np.searchsorted(upto, rank, "left")]
        bound = 0 if not self.collapses else (self.weights + self.collapses - 1) // 2 + max(self.full, default=1)
        return n, got.tolist(), bound


def _emit(keys: list[str], held: dict[tuple, Sketch], part: int) -> pd.DataFrame:
    rows = [(*k, part, *r) for k, s in held.items() for r in s.rows()]
    return pd.DataFrame(rows, columns=[*keys, "part", "weight", "vals", "weights", "collapses"])


def _schema(df: DataFrame, keys: list[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"`{k}` {types[k]}" for k in keys) + ", part int, weight bigint, vals array<double>, weights bigint, collapses bigint"


def sketch(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sketches of ``value`` per ``keys``, built inside each partition (no shuffle).

    Nulls, NaN and infinities are not counted.  Null keys form their own group.
    A partition keeps at most ``HELD`` values in memory.
    """
    ks = [f"k{i}" for i in range(len(keys))]
    base = df.select(*[F.col(k).alias(a) for k, a in zip(keys, ks)], finite(value).alias("v")).where("v is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: dict[tuple, Sketch] = {}
        size = 0
        for d in batches:
            if not len(d):
                continue
            code = d.groupby(ks, dropna=False, sort=False).ngroup().to_numpy()
            order = np.argsort(code, kind="stable")
            v = d.v.to_numpy()[order]
            cut = np.flatnonzero(np.diff(code[order])) + 1
            names = d[ks].iloc[order[np.r_[0, cut]]].itertuples(index=False, name=None)
            for k, s, e in zip(names, np.r_[0, cut], np.r_[cut, len(v)]):
                k = tuple(None if x is None or x != x else x for x in k)
                held.setdefault(k, Sketch()).add(v[s:e])
            size += len(v)
            if size >= HELD:
                yield _emit(ks, held, part)
                held, size = {}, 0
        if held:
            yield _emit(ks, held, part)

    out = base.mapInPandas(run, _schema(base, ks))
    return out.select(*[F.col(a).alias(k) for a, k in zip(ks, keys)], "part", "weight", "vals", "weights", "collapses")


def _walk(ks: list[str], finish):
    """Stream sketch rows sorted by key; ``finish`` turns each completed sketch into rows.

    Keys that end inside a batch and have fewer than ``K`` values in all, none
    of them collapsed, are finished together without a sketch of their own.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, now = None, None
        for d in batches:
            if not len(d):
                continue
            keys = d[ks]
            filled = keys.where(keys.notna(), None)
            code = filled.apply(lambda c: pd.factorize(c, use_na_sentinel=False)[0]).to_numpy()
            first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]).any(axis=1)])
            held = d.vals.str.len().to_numpy()
            size = np.add.reduceat(held, first)
            plain = np.add.reduceat((d.weight.to_numpy() != 1) | (d.collapses.to_numpy() > 0), first) == 0
            small = plain & (size < K)
            small[-1] = False  # may go on in the next batch
            names = list(filled.iloc[first].itertuples(index=False, name=None))
            names = [tuple(None if x is None or x != x else x for x in n) for n in names]
            if now is not None and names[0] == last:
                small[0] = False
            out = []
            for g, start, end in zip(range(len(first)), first, np.r_[first[1:], len(d)]):
                if small[g]:
                    continue
                if now is None or names[g] != last:
                    if now is not None:
                        out += finish(last, now)
                    last, now = names[g], Sketch()
                for r in d.iloc[start:end, -4:].itertuples(index=False, name=None):
                    now.take(r[0], np.asarray(r[1], dtype=np.float64), r[2], r[3])
            if out:
                yield pd.DataFrame(out, columns=finish.columns)
            if small.any():
                rows = np.repeat(small, np.diff(np.r_[first, len(d)]))
                v = np.concatenate(list(d.vals[rows])) if size[small].sum() else np.empty(0)
                yield finish.together([n for n, s in zip(names, small) if s], v, size[small])
        if now is not None:
            out = finish(last, now)
            if out:
                yield pd.DataFrame(out, columns=finish.columns)

    return run


class _Rows:
    def __init__(self, ks):
        self.columns = [*ks, "part", "weight", "vals", "weights", "collapses"]

    def __call__(self, k, s):
        return [(*k, 0, *r) for r in s.rows()]

    def together(self, names, v, size):
        at = np.cumsum(size)[:-1]
        return pd.DataFrame([(*k, 0, 1, x, 0, 0) for k, x in zip(names, np.split(v, at))], columns=self.columns)


class _Quantiles:
    def __init__(self, ks, probs, names):
        self.columns, self.probs = [*ks, "n", *names, "max_rank_error"], probs

    def __call__(self, k, s):
        if not s.held and not s.full:
            return []
        n, q, bound = s.quantiles(self.probs)
        return [(*k, n, *q, bound)]

    def together(self, names, v, size):
        some = size > 0
        size, names = size[some], [n for n, s in zip(names, some) if s]
        v = v[np.lexsort((v, np.repeat(np.arange(len(size)), size)))]
        first = np.cumsum(size) - size
        out = pd.DataFrame(names, columns=self.columns[: len(names[0])] if names else self.columns[: self.columns.index("n")])
        out["n"] = size
        for c, p in zip(self.columns[self.columns.index("n") + 1 : -1], self.probs):
            out[c] = v[first + np.maximum(1, np.ceil(p * size - 1e-9)).astype(np.int64) - 1]
        return out.assign(max_rank_error=0)[self.columns]


def _sorted(sk: DataFrame, keys: list[str], ks: list[str], by: list) -> DataFrame:
    df = sk.select(*[F.col(k).alias(a) for k, a in zip(keys, ks)], "part", "weight", "vals", "weights", "collapses")
    return df.repartition(*by).sortWithinPartitions(*ks, "weight", "part")


def merge(sk: DataFrame, keys: list[str], *, rows_per_task: int = 512) -> DataFrame:
    """Join sketches into one per ``keys``; ``sk`` should be a written table, it is read twice.

    Keys with more than ``rows_per_task`` buffers are first joined in salted
    pieces and then once more, so a hot key is never gathered from all
    partitions by one task.
    """
    ks = [f"k{i}" for i in range(len(keys))]
    hot = sk.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > rows_per_task)
    pieces = hot.agg(F.max("n")).first()[0]
    if pieces:
        salt = F.pmod(hashed("part", F.hash("vals")), F.lit(-(-pieces // rows_per_task))).cast("int")
        df = sk.select(*[F.col(k).alias(a) for k, a in zip(keys, ks)], salt.alias("salt"), "part", "weight", "vals", "weights", "collapses")
        df = df.repartition(*ks, "salt").sortWithinPartitions(*ks, "salt", "weight", "part")
        df = df.select(*ks, "salt", "weight", "vals", "weights", "collapses")
        types = dict(df.dtypes)
        schema = ", ".join(f"{k} {types[k]}" for k in [*ks, "salt"]) + ", part int, weight bigint, vals array<double>, weights bigint, collapses bigint"
        df = df.mapInPandas(_walk([*ks, "salt"], _Rows([*ks, "salt"])), schema)
        sk = staged(df.select(*[F.col(a).alias(k) for a, k in zip(ks, keys)], F.col("salt").alias("part"), "weight", "vals", "weights", "collapses"), "sketches")
    df = _sorted(sk, keys, ks, ks).select(*ks, "weight", "vals", "weights", "collapses")
    out = df.mapInPandas(_walk(ks, _Rows(ks)), _schema(df, ks))
    return out.select(*[F.col(a).alias(k) for a, k in zip(ks, keys)], "part", "weight", "vals", "weights", "collapses")


def percentiles(sk: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """``keys``, ``n``, one column per entry of ``probs`` and ``max_rank_error`` from merged sketches.

    A percentile is the value of rank ceil(p * n), exact while a group has
    fewer than ``FAN * K`` values.  Groups without values give no row.
    """
    ks = [f"k{i}" for i in range(len(keys))]
    df = _sorted(sk, keys, ks, ks).select(*ks, "weight", "vals", "weights", "collapses")
    types = dict(df.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in ks) + ", n bigint, " + ", ".join(f"`{p}` double" for p in probs) + ", max_rank_error bigint"
    out = df.mapInPandas(_walk(ks, _Quantiles(ks, list(probs.values()), list(probs))), schema)
    return out.select(*[F.col(a).alias(k) for a, k in zip(ks, keys)], "n", *probs, "max_rank_error")
