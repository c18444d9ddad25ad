import numpy as np
import pytest
from pyspark.sql import functions as F

from firnline.functions import crs, filenames
from firnline.operators import binning, index, points, raster, tiling
from firnline.operators.ranks import global_index, rank_within
from firnline.plans import catalogue


def test_tiny_points(spark):
    x = list(range(10))
    d = points.from_columns(spark, {"x": x, "y": [v * v for v in x], "z": [v * v for v in x]})
    e = points.union([d, d.select((-F.col("x")).alias("x"), "y", "z").withColumn("t", F.col("x") - 2)])
    rows = e.collect()
    assert len(rows) == 20 and sum(r.t is None for r in rows) == 10


def test_missing_fields_and_empty(spark):
    e = spark.createDataFrame([], "x double, y double, z double")
    assert points.bounds(e).first().x0 is None
    assert points.complete_fields(e, ["x", "q"]).columns == ["x", "y", "z", "q"]
    assert binning.block_median(e, 1.0, ["z"], ["x"]).count() == 0
    s = points.summary(spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double"), ["x"]).first()
    assert (s.n, s.std, s.min, s.max) == (2, 1.0, 1.0, 3.0)


def test_half_even_bins(spark):
    d = spark.createDataFrame([(v,) for v in (-2.5, -0.5, 0.5, 1.5, 2.5)], "x double").withColumn("y", F.lit(0.0))
    got = {r.x: r["count"] for r in binning.bin_stats(d, 1.0, {}).collect()}
    assert got == {-2.0: 1, 0.0: 2, 2.0: 2}


def test_new_rows_null_keys(spark):
    a = spark.createDataFrame([(1.0, None), (1.0, None), (2.0, 3.0)], "x double, y double")
    b = spark.createDataFrame([(1.0, None)], "x double, y double")
    assert [tuple(r) for r in points.new_rows(a, b, ["x", "y"]).collect()] == [(2.0, 3.0)]


def test_hot_groups_rank_the_same(spark):
    rng = np.random.default_rng(5)
    g = np.where(rng.random(3000) < 0.4, 0, rng.integers(1, 50, 3000))
    d = spark.createDataFrame([(int(a), float(b), i) for i, (a, b) in enumerate(zip(g, rng.random(3000)))], "g int, v double, id long")
    a = {r.id: (r.rn, r.n) for r in rank_within(d, ["g"], ["v", "id"], "rn", "n").collect()}
    b = {r.id: (r.rn, r.n) for r in rank_within(d, ["g"], ["v", "id"], "rn", "n", hot_rows=100).collect()}
    assert a == b
    o = {r.id: r.at for r in global_index(d, ["v", "id"], "at").collect()}
    assert [i for i, _ in sorted(o.items(), key=lambda t: t[1])] == [r.id for r in d.orderBy("v", "id").collect()]


def test_block_median_is_a_median(spark):
    rng = np.random.default_rng(1)
    xy = rng.random((2000, 2)) * 10
    z = rng.random(2000)
    d = spark.createDataFrame([(float(a), float(b), float(c), i) for i, ((a, b), c) in enumerate(zip(xy, z))], "x double, y double, z double, id long")
    for r in binning.block_median(d, 2.0, ["z"], ["id"], hot_rows=50).collect():
        own = z[(xy[:, 0] // 2 == r.bx) & (xy[:, 1] // 2 == r.by)]
        assert r["count"] == len(own) and r.z == pytest.approx(np.median(own))
    for r in binning.robust_spread(d.withColumn("k", F.lit(1)), ["k"], "z", ["id"]).collect():
        lo, hi = np.interp(np.array([0.16, 0.84]) * 2000, np.arange(2000) + 0.5, np.sort(z))
        assert r.rde == pytest.approx((hi - lo) / 2)


def test_tiling_schema_and_pruning(spark, tmp_path):
    t = tiling.TilingSchema.from_json(tiling.TilingSchema(spacing=10.0, mapping="floor", scale=1.0).to_json())
    assert t.mapping == "floor"
    d = spark.range(100).select((F.col("id") % 10 * 3.0).alias("x"), F.floor(F.col("id") / 10).cast("double").alias("y"), F.lit(0.0).alias("time"))
    s = tiling.TilingSchema(spacing=10.0)
    tiling.write_tiles(d, str(tmp_path / "t"), s)
    got = points.crop(spark.read.parquet(str(tmp_path / "t")), (6.0, 12.0), (0.0, 9.0), tile=(10.0, "tile_x", "tile_y"))
    assert got.count() == 30
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tile_x" in plan and "PushedFilters: [IsNotNull(x)" in plan


def test_crs():
    assert crs.choose(None, None, 3031, "x") == 3031 and crs.choose(own_epsg=3413) == 3413
    for c in (3413, 3031):
        assert crs.epsg_of(crs.proj4_of(c)) == c == crs.attributes(f"EPSG:{c}")["spatial_epsg"]
    assert crs.epsg_of("+proj=stere +lat_0=90 +lat_ts=70 +lon_0=-45 +datum=WGS84 +units=m") == 3413
    with pytest.raises(ValueError):
        crs.epsg_of(4326)


def test_projection_round_trip(spark):
    d = spark.createDataFrame([(-85.0, 10.0), (-60.0, -170.0)], "latitude double, longitude double")
    b = crs.add_latlon(crs.add_xy(d, 3031).drop("latitude", "longitude"), 3031).collect()
    assert [(r.latitude, r.longitude) for r in b] == [pytest.approx((-85.0, 10.0), abs=1e-9), pytest.approx((-60.0, -170.0), abs=1e-9)]


def test_read_ranges(spark):
    import pandas as pd

    r = spark.createDataFrame([("a", 2, 4), ("gone", 0, 1), ("bad", 0, 1)], "file string, offset_start long, offset_end long")

    def reader(f, a, b):
        if f == "gone":
            raise FileNotFoundError(f)
        if f == "bad":
            raise ValueError("broken")
        return pd.DataFrame({"file": [f] * (b - a + 1), "row": range(a, b + 1)})

    assert [x.row for x in index.read_ranges(r, reader, "file string, row long").orderBy("row").collect()] == [2, 3, 4]
    with pytest.raises(Exception, match="broken"):
        index.read_ranges(r, reader, "file string, row long", error_action="raise").count()


def test_grid_meta():
    a, b = raster.GridMeta(0, 1, 5, 0, 1, 5), raster.GridMeta(3, 1, 5, -2, 1, 3)
    u = a.union(b)
    assert (u.x0, u.nx, u.y0, u.ny) == (0, 8, -2, 7)
    assert len(a.ring()) == 5 and a.ring()[0] == a.ring()[-1]


def test_projections(spark):
    """Known places, round trips, and names of projections."""
    place = spark.createDataFrame([(60.0, 15.0), (0.0, 15.0), (-33.9, 18.4), (84.0, 20.0), (90.0, 0.0), (None, 1.0)], "latitude double, longitude double")
    x = [(r.x, r.y) for r in crs.add_xy(place, "EPSG:32633").collect()]
    assert x[0] == (pytest.approx(500000), pytest.approx(6651411.190, abs=2e-3)) and x[1] == (pytest.approx(500000), pytest.approx(0, abs=1e-6)) and x[5] == (None, None)
    for code in (32633, 32734, "+proj=utm +zone=33 +datum=WGS84", 3857, 4326, 3413):
        back = crs.add_latlon(crs.add_xy(place, code).withColumnsRenamed({"latitude": "la", "longitude": "lo"}), code).collect()
        for r in back[:4] if code not in (3413,) else [back[0], back[3]]:
            assert r.latitude == pytest.approx(r.la, abs=1e-8) and r.longitude == pytest.approx(r.lo, abs=1e-8)
    m = crs.add_xy(place, 3857).collect()
    assert m[0].x == pytest.approx(1669792.362) and m[0].y == pytest.approx(8399737.890, abs=1e-2) and m[4].y is None
    with pytest.raises(ValueError):
        crs.add_xy(place, 2154)


def test_indexes_of_indexes(spark):
    top = spark.createDataFrame([("a.h5", "h5", 1, 2), ("i1", "indexed_h5", 1, 2), ("i1", "indexed_h5", 5, 5)], "src string, file_type string, bin_x int, bin_y int")
    kids = spark.createDataFrame([("i1", "b.h5", "h5", 1, 2), ("i1", "c.h5", "h5", 9, 9), ("i1", "i2", "indexed_h5", 5, 5), ("i2", "d.h5", "h5", 5, 5)], "parent string, src string, file_type string, bin_x int, bin_y int")
    assert sorted(r.src for r in index.resolve_index(top, kids).collect()) == ["a.h5", "b.h5", "d.h5"]
    loop = kids.unionByName(spark.createDataFrame([("i2", "i2", "indexed_h5", 5, 5)], kids.schema))
    with pytest.raises(ValueError):
        index.resolve_index(top, loop, most=3)
    assert index.resolve_index(top.where("false"), kids).count() == 0


def test_bin_keys(spark):
    k = spark.createDataFrame([(-100, 20.0), (0, -5.0)], "x int, y double").select(index.bin_key(F.col("x"), F.col("y")).alias("k")).union(spark.createDataFrame([("bad",)], "k string"))
    x, y = index.parse_bin_key(F.col("k"))
    assert [tuple(r) for r in k.select("k", x, y).collect()] == [("-100_20", -100.0, 20.0), ("0_-5", 0.0, -5.0), ("bad", None, None)]


def test_bands_by_time(spark):
    c = spark.createDataFrame([(0, 0, b, t, float(b)) for b, t in ((0, 2005.0), (1, 2001.0), (2, 2003.0), (3, 2003.0))], "row int, col int, band int, t double, z double")
    assert sorted((r.band, r.t, r.z) for r in raster.time_range(c, 2001, 2003).collect()) == [(0, 2001.0, 1.0), (1, 2003.0, 2.0), (2, 2003.0, 3.0)]
    assert raster.time_range(c, 1990, 1991).count() == 0


def test_dates_in_names(spark):
    names = ["ATM1B_20161012_123456.h5", "ILATM2_131119_000000_x", "WV01_1020_20110203_x_dem.tif", "x_20110203T010203_y", "x_20111399_010203_y", "nothing", None, "SETSM_s2s041_WV01_20200101_1020010090_10200100_2m_dem.tif"]
    d = spark.createDataFrame([(n,) for n in names], "n string")
    n = F.col("n")
    got = [tuple(r) for r in d.select(filenames.granule_days(n), filenames.icessn_days(n), filenames.dem_days(n)).collect()]
    day = lambda *a: float((np.datetime64("%04d-%02d-%02d" % a) - np.datetime64("2000-01-01")).astype(int))
    assert got[0][0] == pytest.approx(day(2016, 10, 12) + (12 * 3600 + 34 * 60 + 56) / 86400) and got[1][1] == day(2013, 11, 19) and got[2][2] == day(2011, 2, 3)
    assert got[3][2] == pytest.approx(day(2011, 2, 3) + 3723 / 86400) and got[4] == got[5] == got[6] == (None, None, None) and got[7][2] == day(2020, 1, 1)


def test_many_small_tiles_are_few_files(spark, tmp_path):
    """3,000 tiles of three rows in six columns: files follow columns and tasks, not tiles; nothing is lost, nulls included."""
    d = spark.range(9000).select((F.col("id") % 6 * 10.0).alias("x"), (F.col("id") % 500 * 10.0).alias("y"), F.col("id").cast("double").alias("time"))
    d = d.unionByName(spark.createDataFrame([(None, 1.0, -1.0), (2.0, None, -2.0)], d.schema))
    s, path = tiling.TilingSchema(spacing=10.0), str(tmp_path / "t")
    tiling.write_tiles(d.where("time < 3000"), path, s)
    tiling.append_tiles(d, path, s)
    assert len(list((tmp_path / "t").rglob("*.parquet"))) <= 2 * (7 + 4 + 1)
    got = spark.read.parquet(path)
    assert sorted(r.time for r in got.select("time").collect()) == [-2.0, -1.0, *map(float, range(9000))]
    assert got.where("tile_x <> rint(x / 10) * 10 or tile_y <> rint(y / 10) * 10").count() == 0
    box = points.crop(got, (10.0, 20.0), (0.0, 40.0), tile=(10.0, "tile_x", "tile_y"))
    assert box.count() == d.where("x between 10 and 20 and y between 0 and 40").count() > 0
    assert "PartitionFilters: [isnotnull(tile_x" in box._jdf.queryExecution().executedPlan().toString()


def test_append_keeps_the_folders_of_a_store(spark, tmp_path):
    d = spark.range(60).select((F.col("id") % 6 * 10.0).alias("x"), (F.col("id") % 4 * 10.0).alias("y"), F.col("id").cast("double").alias("time"))
    s, path = tiling.TilingSchema(spacing=10.0), str(tmp_path / "t")
    tiling.assign_tiles(d.where("time < 20"), s).write.partitionBy("tile_x", "tile_y").parquet(path)  # as written by earlier versions
    tiling.append_tiles(d, path, s)
    got = spark.read.parquet(path)
    assert sorted(r.time for r in got.collect()) == list(range(60)) and got.where("tile_x <> x or tile_y <> y").count() == 0


def test_tile_query_writes_a_file_per_column(spark, tmp_path, monkeypatch):
    """The store of ``tile_write_read`` has as many files as columns of tiles and tasks, and its rows are all read back."""
    sf = "/root/testdata/sf0.1"  # tiles in more than one row
    monkeypatch.setattr(catalogue, "scratch", lambda s, name: str(tmp_path / name))
    catalogue.queries()["tile_write_read"](spark, sf).count()
    got = spark.read.parquet(str(tmp_path / "tiles"))
    assert got.count() == catalogue.pts(spark, sf).count()
    assert len(list((tmp_path / "tiles").rglob("*.parquet"))) <= got.select("tile_x").distinct().count() + 4


def test_many_columns_of_tiles_are_few_files(spark, tmp_path):
    """900 columns of tiles: files follow tasks, a box skips files by their statistics; appending keeps the kind of the store."""
    d = spark.range(9000).select((F.col("id") % 900 * 10.0).alias("x"), (F.col("id") % 7 * 10.0).alias("y"), F.col("id").cast("double").alias("time"))
    d = d.unionByName(spark.createDataFrame([(None, 1.0, -1.0), (2.0, None, -2.0)], d.schema))
    s, path = tiling.TilingSchema(spacing=10.0), str(tmp_path / "t")
    tiling.write_tiles(d.where("time < 3000"), path, s)
    tiling.append_tiles(d, path, s)
    assert 0 < len(list((tmp_path / "t").rglob("*.parquet"))) <= 2 * 4
    tiling.write_tiles(d.where("time = 5"), path, s, mode="append")
    assert not list((tmp_path / "t").glob("tile_x=*"))
    got = spark.read.parquet(path)
    assert sorted(r.time for r in got.select("time").collect()) == sorted([-2.0, -1.0, 5.0, *map(float, range(9000))])
    assert got.where("tile_x <> rint(x / 10) * 10 or tile_y <> rint(y / 10) * 10").count() == 0
    box = points.crop(got, (10.0, 20.0), (0.0, 40.0), tile=(10.0, "tile_x", "tile_y"))
    assert box.where("time <> 5").count() == d.where("time <> 5 and x between 10 and 20 and y between 0 and 40").count() > 0
    assert ">= 10.0" in (plan := box._jdf.queryExecution().executedPlan().toString()) and "IsNotNull(tile_x" in plan  # read by statistics
