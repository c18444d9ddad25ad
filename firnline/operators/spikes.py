"""Spikes, stuck values and impossible readings, per source and pass.

Every source has an autoregression of order ``ORDER`` on the differences of
consecutive readings.  In each pass its residuals are tested for two shapes: an
additive outlier, which leaves the echo ``1, -(1 + a1), a1 - a2, ...`` in the
residuals behind it, and a level shift, which leaves ``1, -a1, -a2, ...``.  The
larger statistic decides; what was found is taken off the series and the tests
repeat until nothing is left.  Coefficients and scatter of a source come from
the cleaned series of all its passes by mergeable sums (lag products, and a
histogram of the residuals for their median) and are fitted anew after each
round of cleaning.  A lasting shift is no case.  Readings found to be outliers,
and those on a level that the pass leaves again at once, are then judged from
both sides by the autoregression of the good readings around them: a case is
far from both.  Stuck runs and limits are judged apart and
take no part in the fit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.common import broadcast_if_few, finite, staged
from firnline.operators.ranks import rank_within

ORDER = 5  # of the autoregression
FITS = 2  # rounds of cleaning and fitting after the first fit
ROUNDS = 12  # most rounds of tests in a pass
TEST = 5.0  # least statistic that counts as an outlier or a shift
SPIKE = 5.8  # least size of a case in scatters of its source
LASTING = 6  # readings from which on a shift inside a pass lasts; at the ends of a pass EDGE
EDGE = 3
STUCK = 6
BLOCK = 4096  # readings of a pass in one row of the work table; longer passes are cut with a halo on both sides
HALO = 128
BINS = 16  # of the residual histogram, per factor of two
LEAST = 1e-6  # scatter that no source goes below


def _lagged(x: np.ndarray, age: np.ndarray, k: int) -> np.ndarray:
    """``x`` of k readings ago, 0 where the pass has none."""
    out = np.zeros_like(x)
    out[k:] = x[:-k]
    out[age < k] = 0
    return out


def _ahead(x: np.ndarray, left: np.ndarray, k: int) -> np.ndarray:
    """``x`` of k readings on, 0 where the pass has none."""
    out = np.zeros_like(x)
    out[: len(x) - k] = x[k:]
    out[left < k] = 0
    return out


def _steps(y: np.ndarray, age: np.ndarray) -> np.ndarray:
    d = np.zeros_like(y)
    d[1:] = np.diff(y)
    d[age == 0] = 0
    return d


def _residuals(y: np.ndarray, age: np.ndarray, phi: np.ndarray) -> np.ndarray:
    d = _steps(y, age)
    e = d.copy()
    for k in range(ORDER):
        e -= phi[:, k] * _lagged(d, age, k + 1)
    return e


def _tests(e: np.ndarray, age: np.ndarray, left: np.ndarray, phi: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sizes and statistics of an additive outlier and of a level shift at every reading."""
    a = np.concatenate([np.ones((len(e), 1)), -phi, np.zeros((len(e), 1))], axis=1)  # echo of a shift
    c = a.copy()
    c[:, 1:] -= a[:, :-1]  # an outlier is a shift and, one reading on, its opposite
    top, out = [], []
    for echo in (c, a):
        num, den = np.zeros(len(e)), np.zeros(len(e))
        for k in range(ORDER + 2):
            ok = left >= k if k else age > 0
            num += np.where(ok, echo[:, k] * (_ahead(e, left, k) if k else e), 0)
            den += np.where(ok, echo[:, k] ** 2, 0)
        w = num / np.maximum(den, 1e-9)
        out.append(w)
        top.append(np.abs(w) * np.sqrt(den) / s)
    top[1][age == 0] = 0
    return out[0], top[0], out[1], top[1]


def _read_backwards(z, age, left, phi, s, wa, ta, wl, tl) -> None:
    """The first readings of a pass have no full past: their tests are made on the pass read backwards, in place.

    Its autoregression is the same.  A shift between two readings stands at
    the earlier one then, with the other sign.  Passes too short for either
    direction keep what they have.
    """
    head = np.flatnonzero((age < 3 * (ORDER + 1)) & (age + left + 1 >= 2 * (ORDER + 1)))
    if not len(head):
        return
    a = age[head]
    n = np.minimum(a + left[head] + 1, 3 * (ORDER + 1))
    flip = head - a + n - 1 - a  # where each reading comes from when its head is turned round
    b = _tests(_residuals(z[flip], a, phi[head]), a, n - 1 - a, phi[head], s[head])
    here = np.arange(len(head)) - a + n - 1 - a  # and where it has gone
    start = a <= ORDER
    t, at = head[start], here[start]
    wa[t], ta[t] = b[0][at], b[1][at]
    t, at = head[start & (a > 0)], here[start & (a > 0)] + 1
    wl[t], tl[t] = -b[2][at], b[3][at]


def clean(v: np.ndarray, first: np.ndarray, phi: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cleaned series, deviation of each doubtful reading, else 0) of passes that start at ``first``; ``phi`` and ``s`` per pass."""
    size = np.diff(np.r_[first, len(v)])
    y, spike, shift = v.astype(float), np.zeros(len(v)), np.zeros(len(v))
    busy = np.arange(len(first))
    for _ in range(ROUNDS):
        # only passes in which the last round found something are tested again
        n = size[busy]
        at = np.repeat(first[busy] - np.cumsum(n) + n, n) + np.arange(n.sum())
        own = np.repeat(np.arange(len(busy)), n)
        age = at - first[busy][own]
        left = n[own] - 1 - age
        p, sc, z = phi[busy][own], s[busy][own], y[at]
        wa, ta, wl, tl = _tests(_residuals(z, age, p), age, left, p, sc)
        _read_backwards(z, age, left, p, sc, wa, ta, wl, tl)
        t = np.maximum(ta, tl)
        peak = t > TEST
        for k in range(1, ORDER + 2):
            peak &= (t > _lagged(t, age, k)) & (t >= _ahead(t, left, k))
        if not peak.any():
            break
        outlier = peak & (ta >= tl)
        spike[at[outlier]] += wa[outlier]
        y[at[outlier]] -= wa[outlier]
        lift = np.where(peak & ~outlier, wl, 0.0)
        if lift.any():
            shift[at] += lift
            up = np.cumsum(lift)
            y[at] -= up - (up - lift)[np.cumsum(n) - n][own]
        busy = busy[np.unique(own[peak])]
    out = np.zeros(len(v))
    for f in np.unique(np.searchsorted(first, np.flatnonzero((spike != 0) | (shift != 0)), "right") - 1):
        here = slice(first[f], first[f] + size[f])
        out[here] = both_sides(v[here], suspects(spike[here] != 0, shift[here] != 0), phi[f], s[f])
    return y, out


def suspects(spike: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Readings of one pass that may be outliers: those found to be, and those on a level that does not last.

    Findings fewer than ``LASTING`` readings apart belong together, and with
    them all readings between; what follows the last shift is its level.
    """
    n = len(spike)
    out = spike.copy()
    hits = np.flatnonzero(spike | shift)
    for a, b in zip(hits[:-1], hits[1:]):
        if b - a < LASTING:
            out[a:b] = True
    at = np.flatnonzero(shift)
    if len(at):
        if at[0] < EDGE:
            out[: at[0]] = True
        if n - at[-1] < EDGE:
            out[at[-1] :] = True
    return out


def both_sides(v: np.ndarray, doubt: np.ndarray, phi: np.ndarray, s: float) -> np.ndarray:
    """How far each doubtful reading is from what the good readings before and behind it let expect: the smaller of the two, else 0.

    A side with fewer than ``EDGE`` good readings tells nothing.  Doubtful
    readings that agree with one side are good from then on and the others are
    judged again.
    """
    level = np.r_[1 + phi[0], np.diff(phi), -phi[-1]]  # weights of the last readings in the prediction
    bad = doubt.copy()
    dev = np.zeros(len(v))
    for _ in range(4):
        good, ask = np.flatnonzero(~bad), np.flatnonzero(bad)
        dev = np.zeros(len(v))
        if not len(ask) or len(good) < EDGE:
            break
        i = np.searchsorted(good, ask)
        sides = []
        for step, start, there in ((-1, i - 1, i), (1, i, len(good) - i)):
            k = start[:, None] + step * np.minimum(np.arange(ORDER + 1)[None, :], np.maximum(there - 1, 0)[:, None])
            expected = (v[good[np.clip(k, 0, len(good) - 1)]] * level).sum(1)
            sides.append(np.where(there >= EDGE, v[ask] - expected, np.inf))
        near = np.where(np.abs(sides[0]) <= np.abs(sides[1]), *sides)
        dev[ask] = np.where(np.isfinite(near), near, 0.0)
        again = np.abs(dev) > SPIKE * s
        if (again == bad).all():
            break
        bad = again
    return dev


def _pack(limits: dict[str, tuple[float, float]]):
    """Rows of a block, in order, to one row of arrays; stuck runs and limit violations are settled here."""

    def block(d: pd.DataFrame) -> tuple:
        v, pos = d.v.to_numpy(), d.pos.to_numpy()
        low, high = limits[d.field.iloc[0]]
        # repeated rows of one reading count once and share its result
        new = np.ones(len(v), bool)
        new[1:] = (pos[1:] != pos[:-1]) | (v[1:] != v[:-1])
        reading = np.cumsum(new) - 1
        u = v[new]
        start = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
        length = np.diff(np.r_[start, len(u)])
        kind = np.where((u < low) | (u > high), 2, np.where(np.repeat(length >= STUCK, length), 1, 0))
        use = kind == 0
        at = np.where(use, np.cumsum(use) - 1, -kind)[reading]
        return d.src.iloc[0], d.field.iloc[0], u[use], d.rid.to_numpy(), at.astype(np.int32), d.own.to_numpy()

    names = ["src", "field", "u", "rid", "at", "own"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []  # the last block may go on in the next batch
        for d in batches:
            if not len(d):
                continue
            key = d.blk.to_numpy()
            edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            out = []
            if rest and rest[-1].blk.iloc[-1] == key[0]:
                if len(edge) == 1:
                    rest.append(d)
                    continue
                out.append(block(pd.concat([*rest, d.iloc[: edge[1]]], ignore_index=True)))
                edge = edge[1:]
            elif rest:
                out.append(block(pd.concat(rest, ignore_index=True)))
            out += [block(d.iloc[a:b]) for a, b in zip(edge[:-1], edge[1:])]
            rest = [d.iloc[edge[-1] :]]
            if out:
                yield pd.DataFrame(out, columns=names)
        if rest:
            yield pd.DataFrame([block(pd.concat(rest, ignore_index=True))], columns=names)

    return run


def _stacked(u: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All readings of some blocks in one array, where each block with readings starts, and the numbers of these blocks."""
    n = np.array([len(x) for x in u])
    some = np.flatnonzero(n > 0)
    v = np.concatenate([u.iloc[i] for i in some]) if len(some) else np.empty(0)
    return v, np.cumsum(n[some]) - n[some], some


def _sums(fitted: bool):
    """Per source: sums and counts of lag products (0 ... 2 * ORDER + 1) and the histogram of residuals (from 1000 on)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            v, first, some = _stacked(d.u)
            if not len(v):
                continue
            size = np.diff(np.r_[first, len(v)])
            own = np.repeat(np.arange(len(first)), size)
            age = np.arange(len(v)) - first[own]
            if fitted:
                phi, s = np.stack(d.phi.to_numpy()[some]), d.s.to_numpy()[some]
                y, _ = clean(v, first, phi, s)
                x = _steps(y, age)
                e = np.abs(_residuals(y, age, phi[own]))[age > 0]
                bins = 1500 + np.floor(BINS * np.log2(np.clip(e, LEAST / 10, 1e9))).astype(np.int64)
            else:
                # nothing is known yet: steps are clipped at three robust spreads of their own block
                x = _steps(v, age)
                order = np.lexsort((np.abs(x), own))
                mid = 1.4826 * np.abs(x)[order][first + size // 2]
                x = np.clip(x, -3 * mid[own], 3 * mid[own])
            code, names = pd.factorize(d.src.to_numpy()[some])
            who = code[own]
            rows = []
            for k in range(ORDER + 1):
                there = age > k
                rows.append((names, np.full(len(names), k), np.bincount(who, np.where(there, x * (_lagged(x, age, k) if k else x), 0), len(names))))
                rows.append((names, np.full(len(names), ORDER + 1 + k), np.bincount(who, there, len(names))))
            if fitted:
                pair, count = np.unique(np.stack([who[age > 0], bins]), axis=1, return_counts=True)
                rows.append((names[pair[0]], pair[1], count.astype(float)))
            yield pd.DataFrame({"src": np.concatenate([r[0] for r in rows]), "i": np.concatenate([r[1] for r in rows]), "x": np.concatenate([r[2] for r in rows])})

    return run


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Yule-Walker coefficients of each source, and its scatter: from the median residual, before there is one from the equations."""
    for d in batches:
        n = len(d)
        if not n:
            continue
        r = np.zeros((n, ORDER + 1))
        s = np.zeros(n)
        for q, (i, x) in enumerate(zip(d.i, d.x)):
            got = dict(zip(i.tolist(), x.tolist()))
            r[q] = [got.get(k, 0.0) / max(got.get(ORDER + 1 + k, 0.0), 1.0) for k in range(ORDER + 1)]
            bins = sorted(k for k in got if k >= 1000)
            if bins:
                upto = np.cumsum([got[k] for k in bins])
                j = int(np.searchsorted(upto, upto[-1] / 2, "left"))
                part = (upto[-1] / 2 - (upto[j - 1] if j else 0)) / got[bins[j]]
                s[q] = 1.4826 * 2 ** ((bins[j] - 1500 + part) / BINS)
        a = r[:, np.abs(np.subtract.outer(np.arange(ORDER), np.arange(ORDER)))]
        a += np.eye(ORDER) * (1e-12 + 0.001 * r[:, :1, None])
        phi = np.linalg.solve(a, r[:, 1:, None])[:, :, 0]
        s = np.where(s > 0, s, np.sqrt(np.maximum(r[:, 0] - (phi * r[:, 1:]).sum(1), 0)))
        yield pd.DataFrame({"src": d.src, "phi": list(phi), "s": np.maximum(s, LEAST)})


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for d in batches:
        v, first, some = _stacked(d.u)
        size = np.zeros(len(v))
        if len(v):
            s = d.s.to_numpy()[some]
            _, size = clean(v, first, np.stack(d.phi.to_numpy()[some]), s)
            size = np.abs(size) / np.repeat(s, np.diff(np.r_[first, len(v)]))
        start = np.zeros(len(d), np.int64)
        start[some] = first
        rids, fields, reasons = [], [], []
        for b, (field, rid, at, own) in enumerate(zip(d.field, d.rid, d["at"], d.own)):
            z = np.where(at >= 0, size[np.clip(start[b] + at, 0, max(0, len(size) - 1))] if len(size) else 0.0, 0.0)
            for hit, reason in ((at == -2, "limit"), (at == -1, "stuck"), (z > SPIKE, "spike")):
                found = rid[hit & own]
                rids.append(found)
                fields += [field] * len(found)
                reasons += [reason] * len(found)
        if reasons:
            yield pd.DataFrame({"rid": np.concatenate(rids), "field": fields, "reason": reasons})


def readings(df: DataFrame, *, row_id: str, value: str, source: list[str], within: list[str], order: list[str], fills: tuple[float, ...] = ()) -> DataFrame:
    """``rid, field, src, pas, o, v``: the readings of one column; several such tables can be judged together.  See ``flag_readings``."""
    key = lambda cols: F.xxhash64(F.lit(value), *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in cols])
    out = df.select(
        F.col(row_id).cast("bigint").alias("rid"), F.lit(value).alias("field"), key(source).alias("src"), key([*source, *within]).alias("pas"),
        F.array(*[F.col(c).cast("double") for c in order]).alias("o"), finite(value).alias("v"),
    )
    return out.where(F.col("v").isNotNull() & F.col("rid").isNotNull() & ~F.col("v").isin([float(f) for f in fills]))


def flag_all(base: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """``(rid, field, reason)`` of the cases among ``readings``; ``limits`` are what each field can hold.

    The readings are shuffled once, into blocks (a pass, or a piece of a long
    one) that are written as rows of arrays; fits and judgement read these
    without a shuffle.  A pass of more than ``BLOCK`` rows first has its
    repeated rows joined into one, and is then cut by the exact rank in the
    pass into blocks of ``BLOCK`` readings with ``HALO`` readings of their
    neighbours on both sides, so neither a hot pass nor a hot reading becomes
    one task.
    """
    whole = {"b": F.lit(0).cast("bigint"), "own": F.lit(True)}
    long = base.groupBy("pas").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("pas")
    copies = None
    rows = base
    if long.limit(1).count():
        long = broadcast_if_few(staged(long, "long_passes"))
        # two hashes stand for a reading: pass, position and value
        mark = lambda k: F.xxhash64(F.lit(k), "src", "pas", "o", "v")
        keyed = base.join(long, "pas", "left_semi").withColumns({"k1": mark(0), "k2": mark(1)})
        one = staged(keyed.groupBy("k1", "k2", "field", "src", "pas", "o", "v").agg(F.min("rid").alias("rid")), "readings")
        copies = keyed.select("k1", "k2", F.col("rid").alias("copy")), one.select("k1", "k2", "rid", F.col("field").alias("f"))
        rows = base.join(long, "pas", "left_anti").withColumns(whole).unionByName(_cut(one.drop("k1", "k2")))
    else:
        rows = rows.withColumns(whole)
    rows = rows.select("rid", "field", "src", F.xxhash64("pas", "b").alias("blk"), "o", F.xxhash64("o").alias("pos"), "v", "own")
    rows = rows.repartition("blk").sortWithinPartitions("blk", "o", "v", "rid").select("rid", "field", "src", "blk", "pos", "v", "own")
    types = "src bigint, field string, u array<double>, rid array<bigint>, at array<int>, own array<boolean>"
    blocks = staged(rows.mapInPandas(_pack(limits), types), "blocks")

    model = _model(blocks.select("src", "u"), fitted=False)
    for _ in range(FITS):
        model = _model(_with(blocks.select("src", "u"), model), fitted=True)
    found = _with(blocks, model).mapInPandas(_judge, "rid bigint, field string, reason string")
    if copies is not None:
        found = staged(found, "found")
        every, first = copies
        spread = first.join(found, (F.col("f") == found["field"]) & (first["rid"] == found["rid"])).select("k1", "k2", "field", "reason")
        spread = spread.join(every, ["k1", "k2"]).select(F.col("copy").alias("rid"), "field", "reason")
        found = found.join(first.select("rid", F.col("f").alias("field")), ["rid", "field"], "left_anti").unionByName(spread)
    return found


def _model(blocks: DataFrame, fitted: bool) -> DataFrame:
    """``src, phi, s`` from one pass over the blocks; sums are combined in the tasks and before the shuffle."""
    sums = blocks.mapInPandas(_sums(fitted), "src bigint, i bigint, x double").groupBy("src", "i").agg(F.sum("x").alias("x"))
    per = sums.groupBy("src").agg(F.collect_list(F.struct("i", "x")).alias("r")).select("src", F.col("r.i").alias("i"), F.col("r.x").alias("x"))
    return staged(per.mapInPandas(_solve, "src bigint, phi array<double>, s double"), "model")


def _with(blocks: DataFrame, model: DataFrame) -> DataFrame:
    """Blocks with the model of their source; beyond the bound of a broadcast hot sources are split by the adaptive planner."""
    return blocks.join(broadcast_if_few(model), "src")


def _cut(rows: DataFrame) -> DataFrame:
    """Rows of long passes with the block ``b`` they belong to (``own``) or lend their value to."""
    ranked = rank_within(rows, ["pas"], ["o", "v", "rid"], "rk", "n")
    at = lambda d: F.floor((F.col("rk") - 1 + d) / BLOCK)
    last = F.floor((F.col("n") - 1) / BLOCK)
    near = F.sequence(F.greatest(at(-HALO), F.lit(0).cast("bigint")), F.least(at(HALO), last))
    return ranked.withColumn("b", F.explode(near)).withColumn("own", F.col("b") == at(0)).drop("rk", "n")


def flag_readings(
    df: DataFrame,
    *,
    row_id: str,
    value: str,
    source: list[str],
    within: list[str],
    order: list[str],
    low: float,
    high: float,
    fills: tuple[float, ...] = (),
) -> DataFrame:
    """``(row_id, reason)`` of readings that are a ``spike``, ``stuck`` or beyond the ``limit``.

    ``source`` names the instrument whose ordinary scatter measures a
    deviation, ``within`` + ``order`` a pass and the sequence in it.  Missing
    values (null, NaN, infinite, ``fills``) are no readings: they are never
    flagged and do not interrupt a run.  Repeated rows share the verdict of
    their reading; ties in ``order`` are taken by value, then id.  A source of
    which nothing varies has the scatter ``LEAST``.  Null keys form their own
    source or pass.  Empty input gives an empty result.
    """
    base = readings(df, row_id=row_id, value=value, source=source, within=within, order=order, fills=fills)
    return flag_all(base, {value: (low, high)}).select(F.col("rid").alias(row_id), "reason")
