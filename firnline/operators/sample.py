"""Raster values at points: lookups in a small broadcast raster, or blocks of cells beside their points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.common import broadcast_if_few
from firnline.functions.semantics import valid
from firnline.operators.blocks import by_block, stream
from firnline.operators.raster import GridMeta


def bilinear(points: DataFrame, point_id: list[str], cells: DataFrame, meta: GridMeta, field: str, *, x: Column | None = None, y: Column | None = None, out: str = "value", distinct: bool = False) -> DataFrame:
    """``point_id, value`` by the four corner weights; null where a corner with weight is missing or outside.

    One row per row of ``points``, or with ``distinct`` per different id and
    place; points outside the raster give none.
    """
    px, py = x if x is not None else F.col("x"), y if y is not None else F.col("y")
    p = points.select(*point_id, px.alias("__px"), py.alias("__py"))
    g = cells.where(valid(field)).select("row", "col", F.col(field).alias("_z"))
    few = broadcast_if_few(g, 500_000)
    if few is not g:
        p = p.distinct() if distinct else p
        p = p.select(*point_id, ((F.col("__px") - meta.x0) / meta.dx).alias("_c"), ((F.col("__py") - meta.y0) / meta.dy).alias("_r"))
        p = p.where((F.col("_c") >= 0) & (F.col("_c") <= meta.nx - 1) & (F.col("_r") >= 0) & (F.col("_r") <= meta.ny - 1))
        p = p.withColumns({"c0": F.least(F.floor("_c"), F.lit(max(0, meta.nx - 2))).cast("bigint"), "r0": F.least(F.floor("_r"), F.lit(max(0, meta.ny - 2))).cast("bigint")})
        p = p.withColumns({"_u": F.col("_c") - F.col("c0"), "_v": F.col("_r") - F.col("r0")})
        # a small raster: one lookup per corner in the same broadcast table, points are neither copied nor shuffled
        total, full = F.lit(0.0), F.lit(True)
        for i, j in ((0, 0), (1, 0), (0, 1), (1, 1)):
            corner = few.select((F.col("row") - j).alias("r0"), (F.col("col") - i).alias("c0"), F.col("_z").alias(f"_z{i}{j}"))
            p = p.join(F.broadcast(corner), ["r0", "c0"], "left")
            w = (F.col("_u") if i else 1 - F.col("_u")) * (F.col("_v") if j else 1 - F.col("_v"))
            total = total + F.when(w > 0, w * F.col(f"_z{i}{j}")).otherwise(0.0)
            full = full & ((w <= 0) | F.col(f"_z{i}{j}").isNotNull())
        return p.select(*point_id, F.when(full, total).alias(out))
    kinds = dict(p.dtypes)
    rows, halo = by_block(p, point_id, cells, meta, field, [(0.0, 0.0)], x="__px", y="__py", distinct=distinct)

    def fold():
        def each(batch: pa.RecordBatch, value: np.ndarray, full: np.ndarray, inside: np.ndarray) -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([*[batch.column(k) for k in point_id], pa.array(value[0], mask=~full[0])], [*point_id, out])
            return got.filter(pa.array(inside[0]))

        return each, lambda: None

    return stream(rows, halo, meta, [(0.0, 0.0)], fold, ", ".join([*[f"`{k}` {kinds[k]}" for k in point_id], f"`{out}` double"]))


def trilinear(points: DataFrame, point_id: list[str], cells: DataFrame, meta: GridMeta, field: str, times: list[float], *, t: str = "t", out: str = "value") -> DataFrame:
    """Bilinear in space, linear between the bracketing bands in time; null outside the times."""
    ts = F.array(*[F.lit(float(v)) for v in times])
    k = F.size(F.filter(ts, lambda v: v <= F.col(t))) - 1
    p = points.where(F.col(t).between(times[0], times[-1])).withColumn("_k", F.least(k, F.lit(max(0, len(times) - 2))))
    p = p.withColumn("_f", F.when(F.lit(len(times) > 1), (F.col(t) - F.element_at(ts, F.col("_k") + 1)) / (F.element_at(ts, F.least(F.col("_k") + 2, F.lit(len(times)))) - F.element_at(ts, F.col("_k") + 1))).otherwise(0.0))
    p = p.withColumn("_b", F.explode(F.array(*[F.struct(F.lit(d).alias("d")) for d in ((0, 1) if len(times) > 1 else (0,))])))
    p = p.withColumns({"band": (F.col("_k") + F.col("_b.d")).cast("bigint"), "_wt": F.when(F.col("_b.d") == 1, F.col("_f")).otherwise(1 - F.col("_f"))}).where("_wt > 0")
    # one bilinear pass per band is avoided: the band joins as a third key
    q = p.select(*point_id, "band", "_wt", ((F.col("x") - meta.x0) / meta.dx).alias("_c"), ((F.col("y") - meta.y0) / meta.dy).alias("_r"))
    q = q.where((F.col("_c") >= 0) & (F.col("_c") <= meta.nx - 1) & (F.col("_r") >= 0) & (F.col("_r") <= meta.ny - 1))
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    q = q.withColumn("k", corner).withColumns({"row": F.least(F.floor("_r"), F.lit(max(0, meta.ny - 2))).cast("bigint") + F.col("k.i"), "col": F.least(F.floor("_c"), F.lit(max(0, meta.nx - 2))).cast("bigint") + F.col("k.j")})
    q = q.withColumn("w", F.col("_wt") * (1 - F.abs(F.col("_r") - F.col("row"))) * (1 - F.abs(F.col("_c") - F.col("col")))).where("w > 0")
    g = cells.where(valid(field)).select("row", "col", "band", F.col(field).alias("_v"))
    j = q.join(broadcast_if_few(g, 500_000), ["row", "col", "band"], "left")
    full = F.sum(F.when(F.col("_v").isNull(), F.col("w")).otherwise(0.0)) == 0
    return j.groupBy(*point_id).agg(F.when(full, F.sum(F.col("w") * F.col("_v"))).alias(out))


def _around(step: float, centre: tuple[float, float] = (0.0, 0.0)) -> list[tuple[float, float]]:
    return [(float(centre[0] + i * step), float(centre[1] + j * step)) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def valid_around(points: DataFrame, point_id: list[str], cells: DataFrame, meta: GridMeta, field: str, reach: float, *, distinct: bool = False) -> DataFrame:
    """Ids of points whose value is defined at all nine positions shifted by 0 or +-reach.

    ``distinct`` takes points of one id and place once.
    """
    kinds = dict(points.select(*point_id).dtypes)
    rows, halo = by_block(points, point_id, cells, meta, field, _around(reach), distinct=distinct)

    def fold():
        return (lambda batch, value, full, inside: batch.select(point_id).filter(pa.array(full.all(axis=0)))), lambda: None

    return stream(rows, halo, meta, _around(reach), fold, ", ".join(f"`{k}` {kinds[k]}" for k in point_id))


def misfits_of(rows: DataFrame, halo: tuple[int, int], meta: GridMeta, z: str, shifts: list[tuple[float, float]]) -> DataFrame:
    """``dx, dy, n, misfit`` of each shift over rows of ``by_block``: a task gives one row per shift, joined about their means."""

    def fold():
        n, mean, m2 = (np.zeros(len(shifts)) for _ in range(3))

        def each(batch: pa.RecordBatch, value: np.ndarray, full: np.ndarray, inside: np.ndarray) -> None:
            h = batch.column(z).cast(pa.float64()).to_numpy(zero_copy_only=False)  # null is nan
            some = batch.column(z).is_valid().to_numpy(zero_copy_only=False)
            for k in range(len(shifts)):
                e = (h - value[k])[full[k] & some]
                count[k] += full[k].sum()
                if len(e):
                    m, t = e.mean(), n[k] + len(e)
                    m2[k] += ((e - m) ** 2).sum() + (m - mean[k]) ** 2 * n[k] * len(e) / t
                    mean[k] += (m - mean[k]) * len(e) / t
                    n[k] = t

        count = np.zeros(len(shifts), np.int64)
        return each, lambda: pa.RecordBatch.from_arrays([pa.array(np.arange(len(shifts))), pa.array(count), pa.array(n), pa.array(mean), pa.array(m2)], ["k", "count", "n", "mean", "m2"])

    parts = stream(rows, halo, meta, shifts, fold, "k bigint, count bigint, n double, mean double, m2 double")
    t = parts.groupBy("k").agg(F.sum("count").alias("n"), F.collect_list(F.struct("n", "mean", "m2")).alias("l")).where("n > 0")
    add = lambda f: F.aggregate("l", F.lit(0.0), lambda a, v: a + f(v))
    t = t.withColumn("t", add(lambda v: v["n"]))
    t = t.withColumn("m", add(lambda v: v["n"] * v["mean"]) / F.when(F.col("t") > 0, F.col("t")))
    m2 = add(lambda v: v["m2"] + v["n"] * (v["mean"] - F.col("m")) * (v["mean"] - F.col("m")))
    at = lambda i: F.element_at(F.array(*[F.lit(float(s[i])) for s in shifts]), (F.col("k") + 1).cast("int"))
    return t.select(at(0).alias("dx"), at(1).alias("dy"), "n", F.sqrt(m2 / F.when(F.col("t") > 0, F.col("t"))).alias("misfit"))


def shift_misfit(points: DataFrame, point_id: list[str], cells: DataFrame, meta: GridMeta, field: str, z: str, step: float, centre: tuple[float, float] = (0.0, 0.0), *, distinct: bool = False) -> DataFrame:
    """``dx, dy, n, misfit`` of nine shifts in one job: population deviation of z minus the raster.

    ``distinct`` takes points of one id, place and z once.
    """
    shifts = _around(step, centre)
    keep = list(dict.fromkeys([*(point_id if distinct else []), z]))
    return misfits_of(*by_block(points, keep, cells, meta, field, shifts, distinct=distinct), meta, z, shifts)
