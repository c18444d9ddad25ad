"""Points near other points or inside regions: strip sweep join.

Both sides are cut into strips of the second axis (latitude, or y of a map
projection), and the strips, in order, into ranges of about as many left rows,
a partition each.  A left row lives in exactly one strip, which therefore owns all
its pairs; a right row is copied into every strip its reach overlaps.  Inside
a strip rows are sorted along the first axis and swept once: right rows form
an active set while the sweep passes their extent, left rows are looked up by
binary search, and every candidate is verified by the exact predicate.

Strips holding more left rows than ``rows_per_task`` are divided by a salt of
the left rows (right rows are copied to each part), so that a hot strip never
becomes one task.  No pair is lost or repeated by either step.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from firnline.common import finite, staged
from firnline.functions.geodesy import polar_forward

EARTH_M = 6371008.8  # mean radius
STRIPS = 4096  # most strips per plane; bounds the driver-side strip histogram
HISTOGRAM_ROWS = 100_000  # most strips whose counts are broadcast (about 4 MB)
PREFILTER_ROWS = 200_000  # most occupied cells that are broadcast (about 5 MB)


def edges(text: str | None) -> np.ndarray | None:
    """Edges ``x0, y0, x1, y1`` of all rings of a ``POLYGON`` or ``MULTIPOLYGON``, whatever its spacing; None if a ring is unusable."""
    out = []
    for ring in re.findall(r"\(([^()]+)\)", text or ""):
        try:
            pts = np.array([[float(v) for v in p.split()[:2]] for p in ring.split(",")])
        except ValueError:
            return None
        if pts.ndim != 2 or pts.shape[1] != 2 or len(pts) < 3 or not np.isfinite(pts).all():
            return None
        out.append(np.hstack([pts, np.roll(pts, -1, axis=0)]))
    return np.vstack(out) if out else None


def inside(px: np.ndarray, py: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Even-odd rule over all edges, so that holes and parts count; points on an edge fall on either side by rounding."""
    e = e[e[:, 1] != e[:, 3]]
    out = np.zeros(len(px), bool)
    step = max(1, 4_000_000 // max(1, len(e)))
    for i in range(0, len(px), step):
        x, y = px[i : i + step, None], py[i : i + step, None]
        hit = ((e[:, 1] > y) != (e[:, 3] > y)) & (x < (e[:, 2] - e[:, 0]) * (y - e[:, 1]) / (e[:, 3] - e[:, 1]) + e[:, 0])
        out[i : i + step] = hit.sum(axis=1) % 2 == 1
    return out


class _Sweep:
    """State of one task: the active right rows of the current strip."""

    def __init__(self, geographic: bool):
        self.geo = geographic
        self.key = None
        self.active = None  # columns lo, hi, x, y, r, id, ring
        self.parsed: dict[str, np.ndarray | None] = {}

    def edges(self, ring: str) -> np.ndarray | None:
        if ring not in self.parsed:
            if len(self.parsed) > 1000:
                self.parsed.clear()
            self.parsed[ring] = edges(ring)
        return self.parsed[ring]

    def strip(self, d: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Rows of one strip in sweep order; may be called again with its continuation."""
        right = d[d.side == 0]
        left = d[d.side == 1]
        if len(right):
            new = right[["lo", "hi", "x", "y", "r", "rid", "ring"]]
            self.active = new if self.active is None else pd.concat([self.active, new], ignore_index=True)
        if self.active is None or not len(self.active) or not len(left):
            return
        lx, ly, lid = left.lo.to_numpy(), left.y.to_numpy(), left.lid.to_numpy()
        act = self.active[self.active.hi >= lx[0]]
        self.active = act
        a = np.searchsorted(lx, act.lo.to_numpy(), "left")
        b = np.searchsorted(lx, act.hi.to_numpy(), "right")
        ids, xs, ys, rs, rings = (act[c].to_numpy() for c in ("rid", "x", "y", "r", "ring"))
        todo = np.flatnonzero(b > a)
        start = 0
        while start < len(todo):  # candidates in pieces of about a million
            n = np.cumsum(b[todo[start:]] - a[todo[start:]])
            end = start + max(1, int(np.searchsorted(n, 1_000_000, "right")))
            take = todo[start:end]
            start = end
            cnt = b[take] - a[take]
            rep = np.repeat(take, cnt)
            pos = np.arange(cnt.sum()) - np.repeat(np.cumsum(cnt) - cnt, cnt) + np.repeat(a[take], cnt)
            px, py = lx[pos], ly[pos]
            if self.geo:
                p, q = np.radians(py), np.radians(ys[rep])
                h = np.sin((p - q) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(px - xs[rep]) / 2) ** 2
                ok = 2 * EARTH_M * np.arcsin(np.minimum(1, np.sqrt(h))) <= rs[rep]
            else:
                dx, dy = px - xs[rep], py - ys[rep]
                ok = dx * dx + dy * dy <= rs[rep] * rs[rep]
            at = np.r_[0, np.cumsum(cnt)]
            for k, p, q in zip(take, at[:-1], at[1:]):
                if rings[k] is not None:
                    e = self.edges(rings[k])
                    ok[p:q] = inside(px[p:q], py[p:q], e) if e is not None else False
            if ok.any():
                yield pd.DataFrame({"lid": lid[pos[ok]], "rid": ids[rep[ok]]})


def _sweeper(geographic: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = _Sweep(geographic)
        for d in batches:
            if not len(d):
                continue
            key = d.part.to_numpy()
            cut = np.flatnonzero(key[1:] != key[:-1]) + 1
            for s, e in zip(np.r_[0, cut], np.r_[cut, len(d)]):
                if state.key != key[s]:
                    state.key, state.active = key[s], None
                yield from state.strip(d.iloc[s:e])

    return run


def strip_sweep_join(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    right_id: str,
    *,
    plane: str = "plane",
    x: str = "x",
    y: str = "y",
    radius: str = "radius",
    ring: str | None = None,
    geographic: bool = False,
    rows_per_task: int = 500_000,
    prefilter: bool = True,
) -> DataFrame:
    """Pairs ``(left_id, right_id)`` of the same ``plane`` with distance <= radius of the right row,
    or the left point inside the right row's ring.

    ``x``/``y`` are map coordinates, or longitude/latitude with
    ``geographic=True`` (metres on the sphere, longitudes taken round the
    globe, poles included).  Rows with null, NaN or infinite coordinates, null
    ids, null planes, or a null/negative radius without ring join nothing.
    Rings are POLYGON or MULTIPOLYGON of any spacing, holes included; one that
    cannot be read joins nothing.  Repeated rows count each.  Empty inputs give an empty result.  Other
    columns of the inputs are ignored, whatever their names.
    """
    spark = left.sparkSession
    p, q = F.col(plane).cast("string"), F.col(x).cast("double")
    lon = F.pmod(q, F.lit(360.0)) if geographic else q
    lt = left.select(F.col(left_id).cast("bigint").alias("lid"), p.alias("pl"), finite(lon).alias("x"), finite(y).alias("y")).where(
        "lid is not null and pl is not null and x is not null and y is not null"
    )
    rcols = [F.col(right_id).cast("bigint").alias("rid"), p.alias("pl"), finite(lon).alias("x"), finite(y).alias("y"), finite(radius).alias("r")]
    rt = right.select(*rcols, (F.col(ring) if ring else F.lit(None).cast("string")).alias("ring"))
    rt = rt.where("rid is not null and pl is not null and (ring is not null or (x is not null and y is not null and r >= 0))")

    # extent of every right row
    if geographic:
        deg = F.degrees(F.col("r") / EARTH_M)
        ylo, yhi = F.col("y") - deg, F.col("y") + deg
        # widest longitude reach on the cap; the whole circle once a pole is inside
        reach = F.when(
            (ylo > -90) & (yhi < 90), F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.col("r") / EARTH_M) / F.cos(F.radians("y"))))) + 1e-9
        ).otherwise(360.0)
        rt = rt.withColumns({"ylo": ylo - 1e-9, "yhi": yhi + 1e-9, "w": reach})
        turns = F.when(F.col("w") >= 180, F.array(F.lit(0.0))).otherwise(F.array(F.lit(-360.0), F.lit(0.0), F.lit(360.0)))
        rt = rt.withColumn("turn", F.explode(turns))
        rt = rt.withColumns(
            {
                "lo": F.when(F.col("w") >= 180, F.lit(0.0)).otherwise(F.col("x") + F.col("turn") - F.col("w")),
                "hi": F.when(F.col("w") >= 180, F.lit(360.0)).otherwise(F.col("x") + F.col("turn") + F.col("w")),
            }
        ).where("hi >= 0 and lo <= 360").drop("turn", "w")
    else:
        # first two numbers of every vertex of every ring
        vertex = F.transform(F.regexp_extract_all("ring", F.lit(r"([^(),]+)"), F.lit(1)), lambda v: F.split(F.trim(v), r"\s+"))
        number = lambda i: F.filter(F.transform("c", lambda v: F.get(v, F.lit(i)).try_cast("double")), lambda v: v.isNotNull())
        rt = rt.withColumn("c", F.when(F.col("ring").isNotNull(), vertex))
        xs, ys = number(0), number(1)
        pick = lambda a, b: F.when(F.col("ring").isNotNull(), a).otherwise(b)
        rt = rt.withColumns(
            {
                "lo": pick(F.array_min(xs), F.col("x") - F.col("r")),
                "hi": pick(F.array_max(xs), F.col("x") + F.col("r")),
                "ylo": pick(F.array_min(ys), F.col("y") - F.col("r")),
                "yhi": pick(F.array_max(ys), F.col("y") + F.col("r")),
            }
        ).drop("c").where("lo is not null and ylo is not null")

    ext = rt.agg(F.min("ylo").alias("a"), F.max("yhi").alias("b"), F.percentile_approx(F.col("yhi") - F.col("ylo"), 0.9, 1000).alias("h"), F.count("*").alias("n")).first()
    out = "lid bigint, rid bigint"
    names = [F.col("lid").alias(left_id), F.col("rid").alias(right_id)]
    if not ext["n"]:
        return spark.createDataFrame([], out).select(*names)
    # as high as most right rows; the few taller ones are copied into more strips
    height = max(ext["h"], (ext["b"] - ext["a"]) / STRIPS, 1e-9)
    strip = lambda c: F.floor((c - ext["a"]) / height).cast("int")
    lt = lt.where(F.col("y").between(ext["a"], ext["b"])).withColumn("s", strip(F.col("y")))
    rt = rt.withColumn("s", F.explode(F.sequence(strip(F.col("ylo")), strip(F.col("yhi")))))

    if prefilter:
        # cells the right side touches; broadcast only while provably few
        span = rt.agg(F.min("lo").alias("a"), F.max("hi").alias("b")).first()
        step = max((span["b"] - span["a"]) / 512, 1e-9)
        cell = lambda c: F.floor((c - span["a"]) / step).cast("int")
        cells = rt.select("pl", "s", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("c")).distinct()
        if cells.limit(PREFILTER_ROWS + 1).count() <= PREFILTER_ROWS:
            lt = lt.withColumn("c", cell(F.col("x"))).join(F.broadcast(cells), ["pl", "s", "c"], "left_semi").drop("c")
    lt = staged(lt, "left")  # slim rows that may have a partner: the input is read once

    # strip histogram: at most STRIPS rows per plane; hot strips get several salts, ranges of strips of even size a partition
    hist = staged(lt.groupBy("pl", "s").agg(F.count("*").alias("n")), "strips")
    k = F.ceil(F.col("n") / rows_per_task).cast("int")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = hist.agg(F.sum("n"), F.count("*")).first()
    few = (total[1] or 0) <= HISTOGRAM_ROWS
    if few:
        upto = F.sum("n").over(W.orderBy("pl", "s").rowsBetween(W.unboundedPreceding, -1))  # over the histogram, of bounded size
        first = F.floor(F.coalesce(upto, F.lit(0)) * parts / max(1, total[0] or 1)).cast("int")
    else:
        first = F.pmod(F.xxhash64("pl", "s"), F.lit(parts)).cast("int")
    hist = staged(hist.select("pl", "s", k.alias("k"), first.alias("first")), "ranges")
    hist = F.broadcast(hist) if few else hist
    lt = lt.join(hist, ["pl", "s"]).withColumn("salt", F.pmod(F.xxhash64("lid"), F.col("k").cast("bigint")).cast("int"))
    rt = rt.join(hist, ["pl", "s"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))

    null = lambda t: F.lit(None).cast(t)
    both = rt.select("pl", "s", "salt", "first", F.lit(0).alias("side"), "lo", "hi", "x", "y", "r", "rid", null("bigint").alias("lid"), "ring").unionByName(
        lt.select("pl", "s", "salt", "first", F.lit(1).alias("side"), F.col("x").alias("lo"), F.col("x").alias("hi"), "x", "y", null("double").alias("r"), null("bigint").alias("rid"), "lid", null("string").alias("ring"))
    )
    both = both.withColumn("part", F.concat_ws("/", "pl", "s", "salt"))
    both = both.repartitionById(parts, F.pmod(F.col("first") + F.col("salt"), F.lit(parts))).sortWithinPartitions("part", "lo", "side")
    cols = ["part", "side", "lo", "hi", "x", "y", "r", "rid", "lid", "ring"]
    return both.select(*cols).mapInPandas(_sweeper(geographic), out).select(*names)


def place_in_plane(df: DataFrame, *, x="x", y="y", lat="latitude", lon="longitude", epsg="epsg") -> DataFrame:
    """Fill missing x, y from latitude/longitude by the polar stereographic projection of ``epsg``
    (3413 or 3031).  Rows with neither stay null."""
    px, py = polar_forward(finite(lat), finite(lon), F.col(epsg))
    have = finite(x).isNotNull() & finite(y).isNotNull()
    placed = F.struct(F.when(have, F.col(x)).otherwise(px).alias(x), F.when(have, F.col(y)).otherwise(py).alias(y))
    # inline() keeps later filters on x, y from copying the projection formula into themselves
    return df.select(*[c for c in df.columns if c not in (x, y)], F.inline(F.array(placed)))


def points_in_sites(points: DataFrame, sites: DataFrame, **kw) -> DataFrame:
    """``(point_id, site_id)`` of every point inside a site's circle or ring of the same epsg.

    Nulls: points and circles without usable x, y are placed by
    latitude/longitude; with neither they match nothing.
    """
    pts = place_in_plane(points.select("point_id", "epsg", "x", "y", "latitude", "longitude"))
    st = place_in_plane(sites.select("site_id", "kind", "epsg", "x", "y", "latitude", "longitude", "radius_m", "ring"))
    st = st.withColumn("ring", F.when(F.col("kind") == "polygon", F.col("ring"))).where("kind <> 'polygon' or ring is not null")
    st = st.withColumn("radius_m", F.when(F.col("kind") == "circle", F.col("radius_m")))
    return strip_sweep_join(pts, st, "point_id", "site_id", plane="epsg", radius="radius_m", ring="ring", **kw)
