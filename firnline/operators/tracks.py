"""Along-track analysis: rows of a track are ordered by an explicit sequence column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from firnline.functions.semantics import valid

NEAR_CELLS = 4  # cells per side of the blocks in which points look for segments


def _w(track: list[str], order: str):
    return W.partitionBy(*track).orderBy(order)


def number_rows(df: DataFrame, track: list[str], order: list[str], name: str = "i") -> DataFrame:
    return df.withColumn(name, (F.row_number().over(W.partitionBy(*track).orderBy(*order)) - 1).cast("bigint"))


def segments(df: DataFrame, track: list[str], order: str, fields: list[str], keep: list[str] | None = None) -> DataFrame:
    """Pairs of consecutive vertices: ``<f>0`` and ``<f>1`` of each field, ``keep`` of the first; the last vertex starts none."""
    w = _w(track, order)
    nxt = F.lead(F.struct(*fields, F.col(order).alias("_o"))).over(w)
    s = df.withColumn("_n", nxt).where("_n is not null")
    return s.select(*track, order, *[F.col(f).alias(f"{f}0") for f in fields], *[F.col(f"_n.{f}").alias(f"{f}1") for f in fields], *(keep or []))


def path_length(df: DataFrame, track: list[str], order: str, x: str = "x", y: str = "y") -> DataFrame:
    """``length`` = distance along the track up to each vertex."""
    w = _w(track, order)
    dx, dy = F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)
    step = F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0))
    return df.withColumn("_d", step).withColumn("length", F.sum("_d").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_d")


def _residual(w, h: str, slope: Column, s: str, to: int) -> Column:
    other = F.lead if to > 0 else F.lag
    return F.col(h) - slope * (F.col(s) - other(s).over(w)) - other(h).over(w)


def along_track_residuals(df: DataFrame, track: list[str], order: str, h: str, slope: Column | str, s: str) -> DataFrame:
    """``min_dh`` (smallest residual to a neighbour) and ``rss_dh`` (root of the sum of squares); one-sided at the ends."""
    w = _w(track, order)
    k = F.col(slope) if isinstance(slope, str) else slope
    e = df.withColumns({"_a": F.abs(_residual(w, h, k, s, -1)), "_b": F.abs(_residual(w, h, k, s, 1))})
    sq = F.coalesce(F.col("_a") * F.col("_a"), F.lit(0.0)) + F.coalesce(F.col("_b") * F.col("_b"), F.lit(0.0))
    return e.withColumns({"min_dh": F.least("_a", "_b"), "rss_dh": F.sqrt(sq)}).drop("_a", "_b")


def flag_residuals(df: DataFrame, threshold: float, *, valid_col: str = "valid", null_field: str | None = None) -> DataFrame:
    over = F.col("rss_dh") > threshold
    out = df.withColumn(valid_col, F.when(over, F.lit(False)).otherwise(F.col(valid_col) if valid_col in df.columns else F.lit(True)))
    return out.withColumn(null_field, F.when(~over, F.col(null_field))) if null_field else out


def resample_path(df: DataFrame, track: list[str], order: str, spacing: float, x: str = "x", y: str = "y") -> DataFrame:
    """Points every ``spacing`` along each path, and its last vertex: ``track, k, length, x, y``."""
    p = path_length(df, track, order, x, y)
    w = _w(track, order)
    nxt = F.lead(F.struct(F.col("length").alias("l"), F.col(x).alias("x"), F.col(y).alias("y"))).over(w)
    seg = p.withColumn("n", nxt)
    last = seg.where("n is null").select(*track, F.lit(None).cast("bigint").alias("k"), "length", F.col(x).alias("x"), F.col(y).alias("y"))
    seg = seg.where("n.l > length")
    first = F.ceil(F.col("length") / spacing).cast("bigint")
    end = F.ceil(F.col("n.l") / spacing).cast("bigint") - 1  # half-open: a mark belongs to the segment it starts or lies inside
    seg = seg.where(end >= first).withColumn("k", F.explode(F.sequence(first, end)))
    f = (F.col("k") * spacing - F.col("length")) / (F.col("n.l") - F.col("length"))
    inner = seg.select(*track, "k", (F.col("k") * spacing).alias("length"), (F.col(x) + f * (F.col("n.x") - F.col(x))).alias("x"), (F.col(y) + f * (F.col("n.y") - F.col(y))).alias("y"))
    return inner.unionByName(last)


def segment_cells(s: DataFrame, cell: float, reach: float = 0.0, x: str = "x", y: str = "y") -> DataFrame:
    """Segments ``x0, y0, x1, y1`` with one row per square cell ``cx, cy`` that lies within ``reach`` of them along x and y.

    A long slanted segment gets the cells along its line, not those of its
    box; a billionth of a cell is added on all sides against rounding.
    """
    a, b, c, d = (F.col(n) for n in (f"{x}0", f"{x}1", f"{y}0", f"{y}1"))
    s = s.withColumn("_eps", reach + 1e-9 * (cell + F.greatest(F.abs(a), F.abs(b), F.abs(c), F.abs(d))))
    span = lambda lo, hi: F.sequence(F.floor((lo - F.col("_eps")) / cell).cast("bigint"), F.floor((hi + F.col("_eps")) / cell).cast("bigint"))
    s = s.withColumn("cx", F.explode(span(F.least(a, b), F.greatest(a, b))))
    # heights at which the segment enters and leaves the column of cells
    low, high = F.least(a, b), F.greatest(a, b)
    at = lambda v: c + (F.least(F.greatest(v, low), high) - a) / (b - a) * (d - c)
    left = F.when(a == b, c).otherwise(at(F.col("cx") * cell - F.col("_eps")))
    right = F.when(a == b, d).otherwise(at((F.col("cx") + 1) * cell + F.col("_eps")))
    s = s.withColumns({"_l": left, "_r": right})
    return s.withColumn("cy", F.explode(span(F.least("_l", "_r"), F.greatest("_l", "_r")))).drop("_eps", "_l", "_r")


def along_track_coords(points: DataFrame, point_id: str, path: DataFrame, track: list[str], order: str, d_max: float) -> DataFrame:
    """``point_id, along, across, dist`` of the nearest path segment within ``d_max``.

    Segments and points go through one shuffle by square block of ``d_max``-sized
    cells; in a task the segments of a block come before its points, which
    stream.  Only the best segment of a point leaves the task, so candidates are
    never sorted or shuffled.  Ties go to the smaller along-track, then
    across-track coordinate.
    """
    box = path.agg(*[f(c).cast("double").alias(f"{c}{n}") for c in "xy" for n, f in enumerate((F.min, F.max))]).first()
    seg = segments(path_length(path, track, order), track, order, ["x", "y", "length"])
    side = NEAR_CELLS * d_max
    block = lambda c: F.floor(c / side).cast("bigint")
    place = ["x0", "y0", "x1", "y1", "length0"]
    some = None not in tuple(box)
    p = points.where(valid("x") & valid("y") & F.lit(some))
    if some:
        p = p.where(F.col("x").between(box.x0 - d_max, box.x1 + d_max) & F.col("y").between(box.y0 - d_max, box.y1 + d_max))
    p = p.select(block(F.col("x")).alias("cx"), block(F.col("y")).alias("cy"), F.lit(1).alias("__k"), F.col("x").cast("double").alias("x0"), F.col("y").cast("double").alias("y0"), *[F.lit(None).cast("double").alias(n) for n in place[2:]], F.col(point_id).alias("__id"))
    # a segment reaches a billionth of a block further than d_max, as points are put in cells by rounded quotients
    s = segment_cells(seg, side, d_max).select("cx", "cy", F.lit(0).alias("__k"), *[F.col(n).cast("double").alias(n) for n in place], F.lit(None).cast(p.schema["__id"].dataType).alias("__id"))
    rows = s.unionByName(p).repartition("cx", "cy").sortWithinPartitions("cx", "cy", "__k")
    kind = p.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, cells = None, [], {}
        for batch in batches:
            key = np.stack([batch.column(n).to_numpy() for n in ("cx", "cy", "__k")])
            ends = np.r_[np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, key.shape[1]] if batch.num_rows else []
            a = 0
            for b in map(int, ends):
                some, (cx, cy, points_now) = batch.slice(a, b - a), key[:, a].tolist()
                a = b
                if (cx, cy) != at:
                    at, parts, cells = (cx, cy), [], {}
                got = np.stack([some.column(n).to_numpy(zero_copy_only=False) for n in place[: 2 if points_now else 5]])
                if not points_now:
                    parts.append(got)
                    continue
                if not parts:
                    continue
                parts = [np.concatenate(parts, axis=1)] if len(parts) > 1 else parts
                sub = np.floor(got / d_max)
                names, group = np.unique(sub, axis=1, return_inverse=True)
                best = np.full((3, got.shape[1]), np.nan)
                for k, (i, j) in enumerate(names.T):
                    if (i, j) not in cells:
                        cells[i, j] = _reaching(parts[0], i, j, d_max)
                    own = np.flatnonzero(group.ravel() == k)
                    best[:, own] = _nearest(got[:, own], cells[i, j], d_max)
                found = np.flatnonzero(~np.isnan(best[2]))
                if len(found):
                    yield pa.RecordBatch.from_arrays([some.column("__id").take(pa.array(found)), *[pa.array(v[found]) for v in best]], ["id", "along", "across", "dist"])

    j = rows.mapInArrow(run, f"id {kind}, along double, across double, dist double")
    best = F.min_by(F.struct("along", "across", "dist"), F.struct("dist", "along", "across"))  # ids may repeat
    return j.groupBy(F.col("id").alias(point_id)).agg(best.alias("b")).select(point_id, "b.along", "b.across", "b.dist")


def _reaching(seg: np.ndarray, i: float, j: float, d_max: float) -> np.ndarray:
    """Rows ``x0, y0, dx, dy, length0, ds`` of the segments whose box reaches a cell."""
    x0, y0, x1, y1, length = seg
    near = np.ones(len(x0), bool)
    for lo, hi, c in ((np.minimum(x0, x1), np.maximum(x0, x1), i), (np.minimum(y0, y1), np.maximum(y0, y1), j)):
        eps = 1e-9 * (d_max + np.maximum(np.abs(lo), np.abs(hi)))
        near &= (hi + d_max + eps >= c * d_max) & (lo - d_max - eps <= (c + 1) * d_max)
    x0, y0, x1, y1, length = seg[:, near]
    dx, dy = x1 - x0, y1 - y0
    out = np.stack([x0, y0, dx, dy, length, np.sqrt(dx * dx + dy * dy)])
    return np.ascontiguousarray(out[:, out[5] > 0])


def _nearest(p: np.ndarray, seg: np.ndarray, d_max: float, most: int = 250_000) -> np.ndarray:
    """``along, across, dist`` of places ``p`` (x, y), NaN where nothing is near; ``most`` pairs are held at once."""
    x0, y0, dx, dy, length, ds = seg
    best = np.full((3, p.shape[1]), np.nan)
    step = max(1, most // max(1, len(x0)))
    for a in range(0, p.shape[1] if len(x0) else 0, step):
        rx, ry = p[0, a : a + step, None] - x0, p[1, a : a + step, None] - y0
        t = (rx * dx + ry * dy) / ds
        c = (ry * dx - rx * dy) / ds
        over = np.maximum(np.maximum(t - ds, -t), 0.0)
        dist = np.sqrt(c * c + over * over)
        dist[~(dist <= d_max)] = np.inf
        low = dist.min(axis=1)
        i, j = np.nonzero((dist == low[:, None]) & np.isfinite(low)[:, None])
        along, across = length[j] + np.minimum(np.maximum(t[i, j], 0.0), ds[j]), c[i, j]
        turn = np.lexsort((across, along, i))
        i, along, across = i[turn], along[turn], across[turn]
        first = np.r_[True, i[1:] != i[:-1]] if len(i) else np.zeros(0, bool)
        best[:, a + i[first]] = along[first], across[first], low[i[first]]
    return best
