"""Neighbourhood statistics and registration of points to rasters."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.common import staged
from firnline.functions.semantics import valid
from firnline.operators.blocks import by_block
from firnline.operators.raster import GridMeta
from firnline.operators.sample import bilinear, misfits_of

EDIT_ROUNDS = 6
DAMPING = 1e-6  # added to the sums of squares of the slopes


def _spreads(r: np.ndarray, use: np.ndarray, first: np.ndarray, seg: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Half the 16-84 percent width (Hazen positions) of the used residuals of every segment; nan below two."""
    s = r[np.lexsort((np.where(use, r, np.inf), seg))]
    at = lambda p: np.clip(p * n - 0.5, 0, np.maximum(n - 1, 0))

    def value(p: float) -> np.ndarray:
        k = at(p)
        low = np.floor(k).astype(np.int64)
        high = np.minimum(low + 1, np.maximum(n - 1, 0))
        return s[first + low] + (k - low) * (s[first + high] - s[first + low])

    return np.where(n >= 2, (value(0.84) - value(0.16)) / 2, np.nan)


def edited_planes(dx: np.ndarray, dy: np.ndarray, dz: np.ndarray, first: np.ndarray, min_sigma: float = 0.5) -> dict[str, np.ndarray]:
    """``bias, noise, slope_x, slope_y, n`` of one plane per segment of rows (segments start at ``first``).

    Weighted normal equations of all segments are summed and solved together;
    a row's weight is 1 or 0.  Slopes (per km) are damped by ``DAMPING``.
    Residuals beyond three robust spreads lose their weight and the fit
    repeats, until no weight changes or four rows or fewer are left.  nan
    where a segment has at most four rows.
    """
    size = np.diff(np.r_[first, len(dx)])
    seg = np.repeat(np.arange(len(first)), size)
    g = np.stack([dx / 1000, dy / 1000, np.ones(len(dx))])
    w = np.ones(len(dx), bool)
    add = lambda v: np.add.reduceat(np.where(w, v, 0.0), first)
    m = np.full((len(first), 3), np.nan)
    r = np.zeros(len(dx))
    open_ = np.ones(len(first), bool)
    for k in range(EDIT_ROUNDS):
        open_ &= add(1.0) > 4
        if not open_.any():
            break
        a = np.empty((len(first), 3, 3))
        for i in range(3):
            for j in range(3):
                a[:, i, j] = add(g[i] * g[j]) + (DAMPING if i == j < 2 else 0.0)
        b = np.stack([add(g[i] * dz) for i in range(3)], axis=1)
        m[open_] = np.linalg.solve(a[open_], b[open_][:, :, None])[:, :, 0]
        rows = open_[seg]
        r = np.where(rows, dz - np.einsum("ij,ji->i", m[seg], g), r)
        if k == EDIT_ROUNDS - 1:
            break
        limit = 3 * np.fmax(_spreads(r, w, first, seg, add(1.0).astype(np.int64)), min_sigma)
        new = np.where(rows, np.abs(r) < limit[seg], w)
        open_ &= np.logical_or.reduceat(new != w, first)
        w = new
    n = add(1.0)
    mean = add(r) / np.maximum(n, 1)
    noise = np.sqrt(np.maximum(add((r - mean[seg]) ** 2) / np.maximum(n, 1), 0))
    return {"bias": -m[:, 2], "noise": noise, "slope_x": m[:, 0] / 1000, "slope_y": m[:, 1] / 1000, "n": n.astype(np.int64)}


def neighbours(points: DataFrame, point_id: str, radius: float, fields: list[str]) -> DataFrame:
    """Pairs of different points within ``radius`` (closed): ``<id>, n_<id>, dist`` and the neighbour's fields.

    Points meet in bins of the radius; one side looks into its 3 x 3
    surroundings, so each ordered pair appears once.
    """
    cell = lambda c: F.floor(F.col(c) / radius).cast("bigint")
    p = points.where(valid("x") & valid("y"))
    a = p.select(F.col(point_id), F.col("x").alias("_x"), F.col("y").alias("_y"), cell("x").alias("cx"), cell("y").alias("cy"))
    steps = F.explode(F.array(*[F.lit(i).cast("bigint") for i in (-1, 0, 1)]))
    b = p.select(F.col(point_id).alias(f"n_{point_id}"), F.col("x").alias("nx"), F.col("y").alias("ny"), *[F.col(f).alias(f"n_{f}") for f in fields], cell("x").alias("cx"), cell("y").alias("cy"))
    b = b.withColumn("_i", steps).withColumn("_j", steps).withColumns({"cx": F.col("cx") + F.col("_i"), "cy": F.col("cy") + F.col("_j")}).drop("_i", "_j")
    dx, dy = F.col("nx") - F.col("_x"), F.col("ny") - F.col("_y")
    j = a.hint("shuffle_hash").join(b, ["cx", "cy"]).where(F.col(point_id) != F.col(f"n_{point_id}")).withColumns({"dx": dx, "dy": dy})
    j = j.withColumn("dist", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).where(F.col("dist") <= radius)
    return j.select(point_id, f"n_{point_id}", "dx", "dy", "dist", *[f"n_{f}" for f in fields])


def plane_sums(points: DataFrame, point_id: str, radius: float, z: str = "z", least: int = 6) -> DataFrame:
    """First-pass plane of each point's neighbours from normal-equation sums (slopes damped as in ``edited_planes``)."""
    nb = neighbours(points, point_id, radius, [z]).join(points.select(point_id, F.col(z).alias("_z0")), point_id)
    u, v, d = F.col("dx") / 1000, F.col("dy") / 1000, F.col(f"n_{z}") - F.col("_z0")
    s = nb.groupBy(point_id).agg(
        F.count("*").alias("n"), *[F.sum(e).alias(k) for k, e in (("uu", u * u), ("uv", u * v), ("vv", v * v), ("u", u), ("v", v), ("ud", u * d), ("vd", v * d), ("d", d))]
    ).where(F.col("n") >= least)
    c = F.col
    a, b, e = c("uu") + 1e-6, c("uv"), c("vv") + 1e-6
    det = a * (e * c("n") - c("v") * c("v")) - b * (b * c("n") - c("v") * c("u")) + c("u") * (b * c("v") - e * c("u"))
    m2 = a * (e * c("d") - c("vd") * c("v")) - b * (b * c("d") - c("vd") * c("u")) + c("ud") * (b * c("v") - e * c("u"))
    return s.select(point_id, "n", (-m2 / F.when(det != 0, det)).alias("bias"))


def radius_stats(points: DataFrame, point_id: str, radius: float, *, z: str = "z", min_sigma: float = 0.5, least: int = 6) -> DataFrame:
    """``point_id, bias, noise, slope_x, slope_y, n``: edited plane fit to the neighbours of each point with at least ``least``.

    The neighbours of a task's points stream through in order of the point and
    are fitted together, batch by batch.  Points or neighbours without z do not count.
    """
    nb = neighbours(points, point_id, radius, [z]).join(points.select(point_id, F.col(z).alias("_z0")), point_id)
    nb = nb.select(F.col(point_id).alias("pid"), "dx", "dy", (F.col(f"n_{z}") - F.col("_z0")).alias("dz")).where("dz is not null")
    names = ["bias", "noise", "slope_x", "slope_y", "n"]

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None

        def done(d: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
            got = pd.DataFrame(edited_planes(d.dx.to_numpy(), d.dy.to_numpy(), d.dz.to_numpy(), first, min_sigma))
            got.insert(0, "pid", d.pid.to_numpy()[first])
            return got[(np.diff(np.r_[first, len(d)]) >= least) & got.bias.notna().to_numpy()]

        for d in batches:
            d = d if rest is None else pd.concat([rest, d], ignore_index=True)
            key = d.pid.to_numpy()
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(d) else np.empty(0, np.int64)
            rest = d.iloc[first[-1] :] if len(first) else d  # the last point may go on in the next batch
            if len(first) > 1:
                yield done(d.iloc[: first[-1]], first[:-1])
        if rest is not None and len(rest):
            yield done(rest.reset_index(drop=True), np.zeros(1, np.int64))

    kind = dict(nb.dtypes)["pid"]
    rows = nb.repartition("pid").sortWithinPartitions("pid").mapInPandas(fit, f"pid {kind}, bias double, noise double, slope_x double, slope_y double, n bigint")
    return rows.select(F.col("pid").alias(point_id), *names)


def grid_shift(points: DataFrame, point_id: str | list[str], cells: DataFrame, meta: GridMeta, field: str, shift: tuple[float, float], *, z: str = "z", sigma: str = "sigma", sigma_min: float = 0.02, rounds: int = 1, distinct: bool = False) -> dict[str, float]:
    """Misfit of one shift: weighted plane of z minus raster, edited at three robust spreads.

    Each round is one aggregation of normal-equation sums; the 3 x 3 solution
    is the only thing done on the driver.  ``distinct`` takes points that agree
    in id, place, z and sigma once.
    """
    point_id = [point_id] if isinstance(point_id, str) else point_id
    keep = list(dict.fromkeys([*point_id, "x", "y", z, sigma])) if distinct else list(dict.fromkeys(["x", "y", z, sigma]))
    v = bilinear(points, keep, cells, meta, field, x=F.col("x") + shift[0], y=F.col("y") + shift[1], out="_value", distinct=distinct).where("_value is not null")
    # every round reads this: the raster is sampled once
    p = staged(v.select("x", "y", (F.col(z) - F.col("_value")).alias("d"), F.greatest(F.lit(sigma_min), F.col(sigma)).alias("s")), "shifted")
    mx, my, sx, sy = p.agg(F.avg("x"), F.avg("y"), F.stddev_pop("x"), F.stddev_pop("y")).first()
    if mx is None:
        return {"sigma": float("nan"), "sigma_scaled": float("nan"), "n": 0}
    g = [F.lit(1.0), (F.col("x") - mx) / (sx or 1.0), (F.col("y") - my) / (sy or 1.0)]
    use, m, got = p, None, None
    for _ in range(max(1, rounds)):
        w = 1 / (F.col("s") * F.col("s"))
        sums = use.agg(*[F.sum(w * g[i] * g[j]) for i in range(3) for j in range(i, 3)], *[F.sum(w * g[i] * F.col("d")) for i in range(3)]).first()
        if sums[0] is None:
            break
        a = np.zeros((3, 3))
        a[np.triu_indices(3)] = sums[:6]
        a = a + a.T - np.diag(np.diag(a))
        m = np.linalg.lstsq(a, np.array(sums[6:], float), rcond=None)[0]
        r = F.col("d") - sum((float(k) * e for k, e in zip(m, g)), F.lit(0.0))
        fit = use.withColumns({"r": r, "rs": r / F.col("s")})
        got = fit.agg(F.stddev_pop("r"), F.stddev_pop("rs"), F.count("*"), F.percentile_approx("rs", F.array(F.lit(0.16), F.lit(0.84)), F.lit(10000))).first()
        lo, hi = got[3]
        use = p.withColumns({"r": r, "rs": r / F.col("s")}).where(F.abs("rs") < 3 * (hi - lo) / 2).drop("r", "rs")
    return {"sigma": got[0], "sigma_scaled": got[1], "n": got[2], "dz": float(m[0]), "slope_x": float(m[1]) / (sx or 1.0), "slope_y": float(m[2]) / (sy or 1.0)} if got else {"sigma": float("nan"), "sigma_scaled": float("nan"), "n": 0}


def search_offsets(points: DataFrame, point_id: str | list[str], cells: DataFrame, meta: GridMeta, field: str, *, z: str = "z", first_step: float = 10.0, tolerance: float = 1.0, most: int | None = None, distinct: bool = False) -> tuple[tuple[float, float], float]:
    """Best shift by pattern search: the new ones of a round's nine shifts in one job, the step halved when the centre is best.

    It goes on until the centre is best at the last step (of at most
    ``tolerance``); a search not over in ``most`` rounds is an error.  Every
    move lowers the misfit, so no place is taken twice.
    The points are kept on disk once, beside all cells that the next shifts may
    need, and anew with twice the reach where the search leaves these.
    """
    point_id = [point_id] if isinstance(point_id, str) else point_id
    keep = list(dict.fromkeys([*(point_id if distinct else []), z]))
    centre, step, reach = (0.0, 0.0), first_step, 2 * first_step
    known: dict[tuple[float, float], float | None] = {}
    rows, halo = None, (0, 0)
    for round_ in count():
        if round_ == most:
            raise RuntimeError(f"no best shift in {most} rounds")
        around = [(centre[0] + i * step, centre[1] + j * step) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        if new := [s for s in around if s not in known]:
            far = max(abs(v) for s in new for v in s)
            if rows is None or far > reach:
                while far > reach:
                    reach *= 2
                if rows is not None:
                    rows.unpersist()
                rows, halo = by_block(points, keep, cells, meta, field, [(reach, reach)], distinct=distinct)
                rows = rows.persist(StorageLevel.DISK_ONLY)  # their order in a task counts, which files would not keep
            got = {(r["dx"], r["dy"]): r["misfit"] for r in misfits_of(rows, halo, meta, z, new).collect()}  # nine rows at most
            known |= {s: got.get(s) for s in new}
        some = [s for s in around if known[s] is not None]
        top = min(some, key=lambda s: (known[s], abs(s[0] - centre[0]) + abs(s[1] - centre[1]), s), default=None)
        if top is None or top == centre and step <= tolerance:
            rows.unpersist()
            return centre, float("nan") if top is None else known[centre]
        if top == centre:
            step /= 2
        centre = top
