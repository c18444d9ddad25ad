import json

import numpy as np
from pyspark.sql import functions as F

from firnline import jobs
from firnline.operators.raster import GridMeta
from firnline.sources import altimetry, geotiff


def test_jobs(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    d = spark.range(400).select((F.col("id") % 20 * 10.0).alias("x"), (F.floor(F.col("id") / 20) * 10.0).alias("y"), F.when(F.col("id") != 3, F.sin("id") + 0.01 * F.col("id")).alias("z"), F.col("id").cast("double").alias("time"))
    d.write.parquet(p("pts"))
    jobs.main(["index", "--args", json.dumps({"glob": p("pts"), "kind": "parquet", "out": p("idx"), "delta": 50.0})])
    assert spark.read.parquet(p("idx")).agg(F.sum("n")).first()[0] == 400
    jobs.main(["tiles", "--args", json.dumps({"src": p("pts"), "out": p("tiles"), "spacing": 100.0, "bounds": [0, 100, 0, 190]})])
    assert spark.read.parquet(p("tiles")).count() == 11 * 20 - 1
    jobs.main(["reduce", "--args", json.dumps({"src": p("pts"), "out": p("red"), "scale": 20.0, "radius": 60.0})])
    assert spark.read.parquet(p("red")).where("n > 4").count() > 50
    jobs.main(["reroot", "--args", json.dumps({"src": p("idx"), "out": p("idx2"), "old": "file:", "new": "/new", "file": "source_file"})])
    assert spark.read.parquet(p("idx2")).where("source_file like '/new/%'").count() > 0
    t = spark.range(60).select((F.col("id") % 6).alias("track"), F.floor(F.col("id") / 6).alias("i")).withColumns({"x": F.col("i") + 0.1 * F.col("track"), "y": F.when(F.col("track") % 2 == 0, F.col("i")).otherwise(9.3 - F.col("i")), "h": F.col("i") * 2.0})
    t.write.parquet(p("trk"))
    jobs.main(["crossovers", "--args", json.dumps({"src": p("trk"), "out": p("xo"), "track": "track", "order": "i", "cell": 2.0, "height": "h", "fields": ["x"]})])
    assert spark.read.parquet(p("xo")).count() == 9
    cells = spark.range(100).select(F.floor(F.col("id") / 10).alias("row"), (F.col("id") % 10).alias("col"), F.col("id").cast("double").alias("z")).withColumns({"tile_row": F.col("row"), "tile_col": F.col("col")})
    cells.write.parquet(p("cells"))
    meta = {"x0": 0.0, "dx": 1.0, "nx": 10, "y0": 0.0, "dy": 1.0, "ny": 10}
    jobs.main(["mosaic", "--args", json.dumps({"src": p("cells"), "out": p("mos"), "meta": meta, "field": "z", "pad": 0.0, "feather": 2.0, "tif": p("m.tif"), "epsg": 3031})])
    z, m = geotiff.read_array((tmp_path / "m.tif").read_bytes())
    assert z.shape == (1, 10, 10) and abs(z[0, 4, 5] - 45) < 1e-9 and GridMeta(**meta).nx == m["nx"]


def test_altimetry_columns(spark, sf):
    a = spark.read.parquet(f"{sf}/atl06_segments.parquet")
    d = altimetry.derive_segments(a)
    assert d.count() == a.count() and d.where("h_li > 1e30").count() == 0 and d.where("not valid or sigma_geo_r is null").count() == 0
    w = altimetry.beams_wide(d, ["rgt", "cycle_number", "segment_id"], ["h_li"])
    assert w.columns[-2:] == ["h_li_l", "h_li_r"] and w.count() > 0
    t, c = altimetry.granule_numbers(F.lit("ATL06_20190205214422_06120206_004_01.h5"))
    r = spark.range(1).select(t.alias("t"), c.alias("c")).first()
    assert (r.t, r.c) == (612, 2)
    along = spark.createDataFrame([(1, 1, 5.0), (1, 2, 6.0), (2, 1, 7.0)], "ref_pt int, cycle_number int, h double")
    cross = spark.createDataFrame([(1, 1, 5.5)], "ref_pt int, cycle_number int, h double")
    got = {(r.ref_pt, r.cycle_number): (r.h_0, r.h_1) for r in altimetry.crossover_cube(along, cross, ["h"]).collect()}
    assert got == {(1, 1): (5.0, 5.5), (1, 2): (6.0, None)}
    m = altimetry.repeat_track_matrix(along.select("ref_pt").distinct(), along.select("cycle_number").distinct(), along)
    assert m.count() == 4 and m.where("h is null").count() == 1
    assert np.isclose(d.select("matlab_time").first()[0], 737061, atol=5000)
