import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from firnline.operators import blocks, crossover, register, sample, smooth, tracks
from firnline.operators.raster import GridMeta, lattice
from firnline.plans import catalogue


def _tracks(n=12, k=9, seed=3):
    rng = np.random.default_rng(seed)
    return [(t, i, float(i + rng.random()), float(rng.random() * 6), float(10 * i)) for t in range(n) for i in range(k)]


def test_crossovers_match_brute_force(spark):
    rows = _tracks()
    d = spark.createDataFrame(rows, "track int, i long, x double, y double, time double")
    c = crossover.crossovers(d, "track", "i", cell=1.0)
    plan = c._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (((" in plan and "cx" in plan  # an equi-join on cells
    got = {(r.track_a, r.i_a, r.track_b, r.i_b): (r.la, r.lb) for r in c.collect()}
    seg = {}
    for t, g in itertools.groupby(rows, key=lambda r: r[0]):
        g = list(g)
        for p, q in zip(g, g[1:]):
            seg[t, p[1]] = np.array([[p[2], p[3]], [q[2], q[3]]])
    want = {}
    for (t, i), a in seg.items():
        for (u, j), b in seg.items():
            if t < u:
                m = np.column_stack([a[1] - a[0], -(b[1] - b[0])])
                if abs(np.linalg.det(m)) > 1e-12:
                    la, lb = np.linalg.solve(m, b[0] - a[0])
                    if 0 < la < 1 and 0 < lb < 1:
                        want[t, i, u, j] = (la, lb)
    assert got.keys() == want.keys() and len(want) > 20
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_parallel_and_shared_ends(spark):
    rows = [(1, 0, 0.0, 0.0), (1, 1, 2.0, 2.0), (2, 0, 0.0, 1.0), (2, 1, 2.0, 3.0), (3, 0, 0.0, 0.0), (3, 1, 2.0, -2.0)]
    d = spark.createDataFrame(rows, "track int, i long, x double, y double")
    assert crossover.crossovers(d, "track", "i", cell=1.0).count() == 0
    assert crossover.crossovers(d, "track", "i", cell=1.0, closed=True).count() == 1


def test_slopes_of_a_plane(spark):
    d = spark.createDataFrame(_tracks(), "track int, i long, x double, y double, time double").withColumn("h", 2 * F.col("x") - 3 * F.col("y") + 7)
    c = crossover.crossovers(d, "track", "i", cell=1.0)
    for r in crossover.crossover_slopes(c, d, "track", "i", "h").collect():
        assert (r.slope_x, r.slope_y) == pytest.approx((2, -3), abs=1e-6)


def test_resample_ends(spark):
    d = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 3.0, 4.0), (1, 2, 3.0, 4.0), (1, 3, 3.0, 10.0)], "track int, i long, x double, y double")
    p = sorted((r.length, r.x, r.y) for r in tracks.resample_path(d, ["track"], "i", 2.5).collect())
    assert [q[0] for q in p] == [0, 2.5, 5, 7.5, 10, 11] and p[1][1:] == pytest.approx((1.5, 2)) and p[-1] == (11.0, 3.0, 10.0)


def test_single_point_track(spark):
    d = spark.createDataFrame([(1, 0, 0.0, 0.0)], "track int, i long, x double, y double")
    assert tracks.segments(d, ["track"], "i", ["x"]).count() == 0
    assert tracks.along_track_residuals(d, ["track"], "i", "y", F.lit(0.0), "x").first().min_dh is None


def test_radius_stats_recover_a_plane(spark):
    rng = np.random.default_rng(2)
    p = [(i, float(a), float(b), float(5 + 0.01 * a - 0.02 * b)) for i, (a, b) in enumerate(rng.random((200, 2)) * 100)]
    d = spark.createDataFrame(p, "id long, x double, y double, z double")
    rows = register.radius_stats(d, "id", 30.0).collect()
    assert len(rows) > 150
    assert all(r.slope_x == pytest.approx(0.01, abs=2e-3) and abs(r.bias) < 0.05 for r in rows if r.n > 20)


def test_search_finds_the_shift(spark):
    m = GridMeta(0.0, 1.0, 41, 0.0, 1.0, 41)
    z = lambda x, y: F.sin(x / 5.0) * 10 + F.cos(y / 4.0) * 10
    cells = lattice(spark, (0, 40), (0, 40)).withColumn("v", z(F.col("col"), F.col("row")))
    p = lattice(spark, (8, 30), (8, 30)).select(F.struct("row", "col").alias("pid"), F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"), F.lit(0.1).alias("sigma"))
    p = p.withColumn("z", z(F.col("x") + 2, F.col("y") - 1))
    best, misfit = register.search_offsets(p, "pid", cells, m, "v", first_step=2.0, tolerance=1.0, most=8)
    assert best == (2.0, -1.0) and misfit < 0.2
    fit = register.grid_shift(p, "pid", cells, m, "v", (2.0, -1.0), rounds=2)
    assert abs(fit["dz"]) < 0.05


def test_smoothing_keeps_constants_and_fills(spark):
    g = lattice(spark, (0, 9), (0, 9)).withColumn("z", F.when((F.col("row") == 4) & (F.col("col") == 4), None).otherwise(3.0))
    assert all(r.z == pytest.approx(3.0) for r in smooth.fill_holes(g, "z", 1.0).collect())
    b = smooth.blend([g.na.fill(3.0, ["z"]).where("col < 7"), g.na.fill(3.0, ["z"]).where("col > 2").withColumn("z", F.lit(5.0))], "z", feather=3.0)
    got = {(r.row, r.col): r.z for r in b.collect()}
    assert got[5, 1] == 3.0 and got[5, 8] == 5.0 and 3 < got[5, 4] < 5


def test_trilinear(spark):
    m = GridMeta(0.0, 1.0, 4, 0.0, 1.0, 4)
    cells = lattice(spark, (0, 3), (0, 3)).crossJoin(spark.createDataFrame([(0,), (1,)], "band long")).withColumn("v", F.col("row") + 10.0 * F.col("col") + 100.0 * F.col("band"))
    p = spark.createDataFrame([(1, 1.5, 0.5, 2005.0), (2, 3.0, 3.0, 2010.0), (3, 9.0, 0.0, 2005.0)], "id int, x double, y double, t double")
    got = {r.id: r.value for r in sample.trilinear(p, ["id"], cells, m, "v", [2000.0, 2010.0]).collect()}
    assert got == {1: pytest.approx(65.5), 2: pytest.approx(133.0)}


def test_all_tracks_are_taken(spark, sf):
    users = {r.user_id for r in spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct().collect()}
    known = catalogue.queries()
    for name in ("track_split", "path_length"):
        assert {r.track for r in known[name](spark, sf).collect()} == users
    rows = known["crossovers"](spark, sf).collect()
    assert {r.track_a for r in rows} | {r.track_b for r in rows} == users


def test_all_points_are_taken(spark, sf):
    known = catalogue.queries()
    pts = catalogue.pts(spark, sf).select("x", "y").distinct().toPandas()
    x, y = pts.x.to_numpy(), pts.y.to_numpy()
    d2 = (x[:, None] - x) ** 2 + (y[:, None] - y) ** 2
    near = d2 <= 25
    np.fill_diagonal(near, False)
    got = known["radius_neighbors"](spark, sf)
    assert sorted((r.ax, r.ay, r.bx, r.by) for r in got.collect()) == sorted((x[i], y[i], x[j], y[j]) for i, j in zip(*np.nonzero(near)))
    n = {(a, b): k for a, b, k in zip(x, y, (d2 <= 400).sum(1) - 1) if k >= 6}
    assert {(r.x, r.y): r.n for r in known["radius_plane_first_pass"](spark, sf).collect()} == n


def test_all_ranges_are_taken(spark, sf):
    known = catalogue.queries()
    p = catalogue.pts(spark, sf, True).select("src", "o1", "pt_id").toPandas()
    runs = p.assign(g=p.o1 // 100).groupby(["src", "g"]).pt_id.agg(["min", "max"]).reset_index().sort_values(["src", "min", "max"])
    want = []
    for src, lo, hi in runs[["src", "min", "max"]].itertuples(index=False):
        if want and want[-1][0] == src and lo <= want[-1][2] + 1:
            want[-1][2] = max(want[-1][2], hi)
        else:
            want.append([src, lo, hi])
    got = known["coalesce_ranges"](spark, sf).select("src", "offset_start", "offset_end").collect()
    assert sorted(map(list, got)) == sorted(want)


def test_along_track_places_of_all_points(spark, sf):
    known = catalogue.queries()
    p = catalogue.pts(spark, sf).select("o1", "o2", "x", "y", "z").distinct().toPandas()
    t = catalogue.trk(spark, sf).toPandas().sort_values(["track", "i"])
    best = np.full(len(p), np.inf)
    for _, k in t.groupby("track"):
        a, b = k[["x", "y"]].to_numpy()[:-1], k[["x", "y"]].to_numpy()[1:]
        for q, e in zip(a, b - a):
            r = p[["x", "y"]].to_numpy() - q
            f = np.clip(r @ e / max(e @ e, 1e-300), 0, 1)
            best = np.minimum(best, np.hypot(*(r - f[:, None] * e).T))
    want = sorted((a, b, round(c, 3)) for a, b, c in zip(p.o1, p.o2, best) if c <= 25)
    got = sorted((r.o1, r.o2, r.dist) for r in known["along_track_coords"](spark, sf).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want] and all(abs(g[2] - w[2]) < 2e-3 for g, w in zip(got, want))


def test_edited_planes_match_least_squares():
    """Against a plain damped least-squares fit with the same edit, one segment at a time; short segments give none."""
    rng = np.random.default_rng(4)
    sizes = [3, 5, 12, 40, 7, 200]
    parts = []
    for n in sizes:
        x, y = rng.uniform(-20, 20, n), rng.uniform(-20, 20, n)
        z = 3 + 0.05 * x - 0.02 * y + rng.normal(0, 0.3, n)
        z[rng.random(n) < 0.1] += 50
        parts.append((x, y, z))
    dx, dy, dz = (np.concatenate(v) for v in zip(*parts))
    got = register.edited_planes(dx, dy, dz, np.r_[0, np.cumsum(sizes)[:-1]])
    for k, (x, y, z) in enumerate(parts):
        if len(x) <= 4:
            assert np.isnan(got["bias"][k])
            continue
        keep = np.ones(len(x), bool)
        for turn in range(register.EDIT_ROUNDS):
            if keep.sum() <= 4:
                break
            g = np.c_[x / 1000, y / 1000, np.ones(len(x))]
            lhs = g[keep].T @ g[keep] + register.DAMPING * np.diag([1, 1, 0])
            m = np.linalg.solve(lhs, g[keep].T @ z[keep])
            res = z - g @ m
            lo, hi = np.quantile(res[keep], [0.16, 0.84], method="hazen")
            after = np.abs(res) < 3 * max((hi - lo) / 2, 0.5)
            if turn == register.EDIT_ROUNDS - 1 or (after == keep).all():
                break
            keep = after
        assert got["bias"][k] == pytest.approx(-m[2]) and got["slope_x"][k] == pytest.approx(m[0] / 1000) and got["n"][k] == keep.sum()
        assert got["noise"][k] == pytest.approx(res[keep].std())


def test_crossings_with_keys_and_time(spark):
    """``pair``, ``different`` and ``max_dt`` against all pairs; long slanted and upright segments."""
    rng = np.random.default_rng(2)
    rows = [(t, i, float(rng.uniform(-50, 50)), float(rng.uniform(-50, 50)), float(rng.uniform(0, 100)), t % 2, t % 3) for t in range(14) for i in range(5)]
    rows += [(20, 0, 5.0, -60.0, 1.0, 0, 0), (20, 1, 5.0, 60.0, 2.0, 0, 0), (21, 0, -60.0, 10.0, 3.0, 0, 1), (21, 1, 60.0, 10.0, 4.0, 0, 1)]
    df = spark.createDataFrame(rows, "track int, i int, x double, y double, time double, par int, grp int")
    for kw in ({}, {"pair": "par"}, {"different": "grp"}, {"time": "time", "max_dt": 20.0}, {"pair": "par", "different": "grp", "time": "time", "max_dt": 30.0}):
        want = set()
        seg = [(a, b) for a, b in zip(rows[:-1], rows[1:]) if a[0] == b[0]]
        for p, q in ((p, q) for p in seg for q in seg if p[0][0] < q[0][0]):
            if ("pair" in kw and p[0][5] != q[0][5]) or ("different" in kw and p[0][6] == q[0][6]) or ("max_dt" in kw and abs(p[0][4] - q[0][4]) > kw["max_dt"]):
                continue
            m = np.array([[p[1][2] - p[0][2], q[0][2] - q[1][2]], [p[1][3] - p[0][3], q[0][3] - q[1][3]]])
            if abs(np.linalg.det(m)) > 0:
                la, lb = np.linalg.solve(m, [q[0][2] - p[0][2], q[0][3] - p[0][3]])
                if 0 < la < 1 and 0 < lb < 1:
                    want.add((p[0][0], p[0][1], q[0][0], q[0][1]))
        got = [tuple(r) for r in crossover.crossovers(df, "track", "i", cell=7.0, **kw).select("track_a", "i_a", "track_b", "i_b").collect()]
        assert len(got) == len(set(got)) and set(got) == want and want


def _sloped(spark, n=60, hole=7):
    cells = lattice(spark, (0, n - 1), (0, n - 1)).where(f"(row * 13 + col) % {hole} <> 0").withColumn("v", F.col("col") * 0.5 + F.col("row") * F.col("row") / 10.0)
    p = spark.range(400).select(F.col("id"), (F.col("id") * 0.37 % (n + 4) - 2).alias("x"), (F.col("id") * 1.91 % (n + 4) - 2).alias("y"), (F.col("id") % 50).cast("double").alias("_z"))
    return GridMeta(0.0, 1.0, n, 0.0, 1.0, n), cells, p


def test_large_rasters_give_what_small_ones_do(spark, monkeypatch):
    m, cells, p = _sloped(spark)
    small = sample.bilinear(p, ["id", "_z"], cells, m, "v")
    monkeypatch.setattr(sample, "broadcast_if_few", lambda g, n: g)
    monkeypatch.setattr(blocks, "BLOCK", 16)
    large = sample.bilinear(p.repartition(3), ["id", "_z"], cells, m, "v")
    assert small.count() < 400 and small.where("value is null").count() > 0
    assert sorted(map(tuple, large.collect()), key=str) == sorted(map(tuple, small.collect()), key=str)


def _by_hand(spark, m, cells, p, dx, dy, monkeypatch):
    v = sample.bilinear(p, ["id", "_z"], cells, m, "v", x=F.col("x") + dx, y=F.col("y") + dy).where("value is not null")
    return v.agg(F.count("*"), F.stddev_pop(F.col("_z") - F.col("value"))).first()


@pytest.mark.parametrize("z", ["_z", "z"])
def test_misfits_beside_blocks(spark, monkeypatch, z):
    m, cells, p = _sloped(spark)
    by_hand = {(dx, dy): _by_hand(spark, m, cells, p, dx, dy, monkeypatch) for dx, dy in ((-2.0, 2.0), (0.0, 0.0), (2.0, 0.0))}
    monkeypatch.setattr(blocks, "BLOCK", 16)
    monkeypatch.setattr(sample, "broadcast_if_few", lambda g, n: g)
    q = p.withColumnRenamed("_z", z)
    got = {(r.dx, r.dy): r for r in sample.shift_misfit(q.unionByName(q), ["id"], cells, m, "v", z, 2.0, distinct=True).collect()}
    assert len(got) == 9
    for k, (n, s) in by_hand.items():
        assert got[k].n == n and got[k].misfit == pytest.approx(s, rel=1e-12)


def test_valid_around_beside_blocks(spark, monkeypatch):
    m, cells, p = _sloped(spark, hole=601)
    ok = None
    for dx in (-3.0, 0.0, 3.0):
        for dy in (-3.0, 0.0, 3.0):
            v = sample.bilinear(p, ["id"], cells, m, "v", x=F.col("x") + dx, y=F.col("y") + dy).where("value is not null").select("id")
            ok = v if ok is None else ok.intersect(v)
    want = sorted(r.id for r in ok.collect())
    monkeypatch.setattr(blocks, "BLOCK", 16)
    got = sample.valid_around(p.unionByName(p), ["id"], cells, m, "v", 3.0, distinct=True)
    assert "Window" not in got._jdf.queryExecution().toString() and 0 < len(want) < 400
    assert sorted(r.id for r in got.collect()) == want


def test_search_goes_on_to_the_best_shift(spark):
    m = GridMeta(0.0, 1.0, 60, 0.0, 1.0, 20)
    cells = lattice(spark, (0, 19), (0, 59)).withColumn("v", F.col("col") * F.col("col") * 1.0 + F.col("row"))
    p = lattice(spark, (5, 9), (5, 14)).select("row", "col", F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))
    p = p.withColumn("z", (F.col("x") + 6) * (F.col("x") + 6) + F.col("y"))
    best, misfit = register.search_offsets(p, ["row", "col"], cells, m, "v", first_step=1.0, tolerance=1.0)
    assert best[0] == 6.0 and misfit == pytest.approx(0, abs=1e-9)
    with pytest.raises(RuntimeError):
        register.search_offsets(p, ["row", "col"], cells, m, "v", first_step=1.0, tolerance=1.0, most=4)


def test_search_query_is_not_cut(spark, sf, monkeypatch):
    given = {}
    monkeypatch.setattr(catalogue.register, "search_offsets", lambda *a, **kw: given.update(kw) or ((0.0, 0.0), 1.0))
    catalogue.queries()["search_offsets"](spark, sf)
    assert "most" not in given


def test_filling_by_blocks(spark):
    g = lattice(spark, (-9, 25), (0, 40)).where("(row * 7 + col) % 5 <> 0").withColumn("v", F.when((F.col("row") * 3 + F.col("col")) % 4 != 0, F.sin(F.col("row") * 0.3) + F.col("col")))
    g = g.unionByName(spark.createDataFrame([(900, 900, None), (None, 3, 1.0)], g.schema))
    filled = smooth.fill_holes(g, "v", 1.0, block=8)
    assert filled._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0  # cells are shuffled once
    cells = {(r.row, r.col): r.v for r in g.collect()}
    got = {(r.row, r.col): r.v for r in filled.collect()}
    assert got.keys() == cells.keys() and got[900, 900] is None and got[None, 3] == 1.0
    near = dict(smooth.kernel(1.0))
    for (row, col), v in cells.items():
        if row is not None and row < 900:
            some = [(near[i] * near[j], cells[row + i, col + j]) for i in near for j in near if cells.get((row + i, col + j)) is not None]
            want = v if v is not None else sum(w * z for w, z in some) / sum(w for w, _ in some)
            assert got[row, col] == pytest.approx(want, rel=1e-12)
    wide = smooth.fill_holes(g.where("row < 900").withColumn("k", F.lit(1)), "v", 1.0, block=8)
    assert {(r.row, r.col): r.v for r in wide.collect()} == {k: pytest.approx(v, rel=1e-12) for k, v in got.items() if k not in ((900, 900), (None, 3))}


def test_carried_fields_are_those_of_joins(spark, sf):
    d = spark.createDataFrame([(t, 3 * i if t == 2 else i, x, y, h) for t, i, x, y, h in _tracks(8, 7)], "track int, i long, x double, y double, h double")
    same = lambda a, b: sorted(map(tuple, a.select(*b.columns).collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    plain = crossover.crossovers(d, "track", "i", cell=1.0)
    full = crossover.crossovers(d, "track", "i", cell=1.0, carry=["x", "y", "h"])
    assert same(crossover.crossover_values(full, d, "track", "i", ["h"]), crossover.crossover_values(plain, d, "track", "i", ["h"]))
    assert same(crossover.crossover_slopes(full, d, "track", "i", "h"), crossover.crossover_slopes(plain, d, "track", "i", "h"))
    kept = crossover.crossovers(crossover.with_near(d, "track", "i", ["h"], 1), "track", "i", cell=1.0, keep=["near"])
    assert same(crossover.crossover_neighbours(kept, d, "track", "i", ["h"], 1), crossover.crossover_neighbours(plain, d, "track", "i", ["h"], 1))
    for name in ("crossover_values", "crossover_slope", "crossover_neighbors", "crossover_cube_pivot"):
        plan = catalogue.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") == 1, name  # only segments meet


def test_segments_of_a_cell_are_merged(spark, sf):
    """Rows of one cell are held at a time, not a hashed side; many in one cell, with repeats and ends, are all compared."""
    for name in ("crossovers", "crossover_values", "crossover_slope", "crossover_neighbors", "crossover_cube_pivot"):
        plan = catalogue.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 1 and "HashJoin" not in plan, name
    d = spark.range(600).select((F.col("id") / 2).cast("long").alias("track"), (F.col("id") % 2).alias("i"), ((F.col("id") * 37) % 101 / 10.0).alias("x"), ((F.col("id") * 53) % 97 / 10.0).alias("y"))
    one, many = ({tuple(r) for r in c.collect()} for c in (crossover.crossovers(d, "track", "i", cell=w).select("track_a", "i_a", "track_b", "i_b", "la", "lb") for w in (1000.0, 0.7)))
    assert one == many and len(one) > 1000


def test_neighbours_unroll_numbers_only(spark):
    """One generator over crossings, of constants; rows are those of the joins, for several widths and with missing vertices."""
    d = spark.createDataFrame([(t, 2 * i if t == 3 else i, x, y, h if i % 5 else None) for t, i, x, y, h in _tracks(7, 6)], "track int, i long, x double, y double, h double")
    plain = crossover.crossovers(d, "track", "i", cell=1.0)
    for extra in (0, 1, 3):
        kept = crossover.crossovers(crossover.with_near(d, "track", "i", ["h", "x"], extra), "track", "i", cell=1.0, keep=["near"])
        got, want = (crossover.crossover_neighbours(c, d, "track", "i", ["h", "x"], extra) for c in (kept, plain))
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert got.dtypes == want.dtypes and plan.count("Generate") == kept._jdf.queryExecution().optimizedPlan().toString().count("Generate") + 1
        some = sorted(map(tuple, got.collect()), key=str)
        assert some == sorted(map(tuple, want.collect()), key=str) and len(some) == plain.count() * 4 * (extra + 1) > 0


def test_nearest_segments_against_all_pairs(spark):
    """Ties, segments without length, missing places and far points; no candidate goes through a sort or shuffle."""
    rng = np.random.default_rng(11)
    path = [(t, i, float(rng.integers(-60, 60)), float(rng.integers(-60, 60))) for t in range(12) for i in range(6)]
    path += [(50, 0, 0.0, 0.0), (50, 1, 0.0, 0.0), (50, 2, 8.0, 0.0), (51, 0, -900.0, 5.0), (51, 1, 900.0, 7.0)]
    pts = [(k, float(rng.integers(-80, 80)), float(rng.integers(-80, 80))) for k in range(300)] + [(300, 880.0, 9.0), (301, 5000.0, 0.0), (302, None, 1.0), (303, float("nan"), 1.0)]
    t = spark.createDataFrame(path, "track int, i int, x double, y double")
    p = spark.createDataFrame(pts, "id int, x double, y double")
    got = tracks.along_track_coords(p, "id", t, ["track"], "i", 4.0)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan
    want, length = {}, 0.0
    for a, b in zip(path, path[1:]):
        if a[0] != b[0]:
            length = 0.0
            continue
        (dx, dy), at = (b[2] - a[2], b[3] - a[3]), length
        ds = np.sqrt(dx * dx + dy * dy)
        length += ds
        for k, x, y in pts if ds else []:
            if x is None:
                continue
            s, c = ((x - a[2]) * dx + (y - a[3]) * dy) / ds, ((y - a[3]) * dx - (x - a[2]) * dy) / ds
            d = np.sqrt(c * c + max(s - ds, -s, 0.0) ** 2)
            if d <= 4.0:
                want[k] = min(want.get(k, (np.inf,)), (d, at + min(max(s, 0.0), ds), c))
    assert {r.id: (r.dist, r.along, r.across) for r in got.collect()} == {k: pytest.approx(v, rel=1e-12, abs=1e-12) for k, v in want.items()}
    assert len(want) > 100 and 300 in want
    nothing = t.where("x > 1e9")
    assert tracks.along_track_coords(p, "id", nothing, ["track"], "i", 4.0).count() == 0


def test_first_crossings_are_those_of_all(spark):
    """Against all crossings, in tracks that turn back; crossings themselves are neither sorted nor shuffled."""
    rng = np.random.default_rng(5)
    rows = [(f"t{t}", 3 * i, float(rng.integers(-40, 40)), float(rng.integers(-40, 40)), float(rng.uniform(0, 90))) for t in range(25) for i in range(8)]
    d = spark.createDataFrame([*rows, ("t3", 99, None, 1.0, 2.0)], "track string, i long, x double, y double, time double")
    for kw in ({}, {"closed": True}, {"time": "time", "max_dt": 25.0}):
        want = {}
        for r in crossover.crossovers(d, "track", "i", cell=7.0, **kw).collect():
            k = (r.track_a, r.track_b)
            want[k] = min(want.get(k, (r.i_a, r.i_b, r.la, r.lb, r.x, r.y)), (r.i_a, r.i_b, r.la, r.lb, r.x, r.y))
        got = crossover.crossovers(d, "track", "i", cell=7.0, first_only=True, **kw)
        assert "Join" not in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and "Aggregate" not in plan
        small = crossover.first_crossings(d, "track", "i", width=7.0, most_rows=30, most_tracks=4, **kw)
        for some in (got, small):
            some = some.collect()
            assert {(r.track_a, r.track_b): (r.i_a, r.i_b, r.la, r.lb, r.x, r.y) for r in some} == want and len(some) == len(want) > 100
    assert crossover.crossovers(d.where("x > 1e9"), "track", "i", cell=7.0, first_only=True).count() == 0


def test_rounding_of_crossings_is_that_of_sql(spark):
    import duckdb

    rng = np.random.default_rng(4)
    v = [1.005, -1.005, 0.285, 2.675, 0.0, -0.001, 0.49999999999999994, 0.125, 1e300, -1e17, float("inf"), *map(float, rng.normal(0, 1000, 500)), *map(float, rng.integers(-9999, 9999, 500) / 1000)]
    d = spark.createDataFrame([(x,) for x in v] + [(None,), (float("nan"),)], "v double")
    got = [str(r[0]) for r in d.select(catalogue.near("v", 2)).collect()]
    assert got == [str(r[0]) for r in duckdb.execute("select round(unnest(?::double[]), 2) + 0.0", [[*v, None, float("nan")]]).fetchall()]


def test_slopes_are_rounded_as_crossings_are(spark, sf, monkeypatch):
    monkeypatch.setattr(catalogue, "near", lambda c, n: F.lit(float(n)))
    assert tuple(catalogue.queries()["crossover_slope"](spark, sf).first())[4:] == (2.0, 2.0)
