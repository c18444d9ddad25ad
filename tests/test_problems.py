"""The general data problems on small fixtures: brute force, nulls, ties, repeats, empty tables, clashing columns."""

import datetime as dt
import json
import random
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from firnline.functions.json_canon import canonical, canonical_text
from firnline.operators import drift, instants, nearby, spikes, units
from firnline.streaming.compaction import compact_files, fingerprinted, repeated, settled

# ---- 1 units

REC = "rec_id long, source_id int, abs_orbit int, Day int, Second int, days_J2k double, note string, Freeboard string, SSHA_interp string, Sig0_1 string"


def _rec(i, source, fb=None, ssh=None, sig=None, note=None, day=5000, orbit=1):
    return (i, source, orbit, day, 0, None, note, fb, ssh, sig)


def test_units_by_value_note_header_and_inference(spark):
    heads = [
        (1, "Freeboard [m]; SSHA_interp [m]; Sig0_1 [dB]"),
        (2, "scale_factor 0.001 applies to heights [m], 0.01 to Sig0_1 [dB]"),
        (3, "freeboard in feet, other heights in m, sigma0 dB"),
        (4, "until 2014-06-30 heights in mm, from 2014-07-01 in m; sigma0 dB"),
        (5, None),
        (6, "Heights in milimetres, backscater in hundredths of a decibell"),
    ]
    rows = [_rec(i, 1, str(0.2 + 0.01 * (i % 30)), str(0.1 * (-1) ** i), str(9 + i % 3)) for i in range(100)]
    rows += [
        _rec(1000, 1, "30 cm", "-5 mm.", "950 1/100 dB"),
        _rec(1001, 1, "1,5 feet", "NaN", "8.0 lin."),
        _rec(1002, 1, "300", "30", "900", "mm for freeboard; Cm for ssha; backscatter x0.01 dB"),
        _rec(1003, 1, "2 m", None, "--", "FB=mm. SSH=mm SIG=cdB"),
        _rec(1012, 1, "0.5", "10", "900", "FB=m SSH=mm. SIG=1/100 dB"),
        _rec(1013, 1, "100", "20", "900", "mm. for freeboard; cm. for ssha; backscatter x0.01 dB"),
        _rec(1004, 2, "300", "100", "980"),
        _rec(1005, 3, "1.0", "0.1", "9"),
        _rec(1006, 4, "300", "-100", "9", day=5000),
        _rec(1007, 4, "0.3", "-0.1", "9", day=5600),
        _rec(1008, 6, "300", "100", "980"),
        _rec(1009, 99, "0.3", "0.1", "9.5"),
        _rec(1010, 1, "", "-9999", "n/a"),
        _rec(1011, 1, "0.4", None, None, "checked"),
    ]
    rows += [_rec(2000 + i, 5, str(200 + 10 * (i % 30)), None, None) for i in range(20)]
    r = spark.createDataFrame(rows, REC).withColumn("field", F.lit("clash")).withColumn("unit", F.lit(1))
    s = spark.createDataFrame(heads, "source_id int, header_text string").withColumn("text", F.lit(0))
    got = {(x.rec_id, x.field_name): (x.unit, x.stated_by, x.common) for x in units.normalise(r, s).collect()}
    want = {
        (1000, "Freeboard"): ("cm", "value", 0.3), (1000, "SSHA_interp"): ("mm", "value", -0.005), (1000, "Sig0_1"): ("cdb", "value", 9.5),
        (1001, "Freeboard"): ("ft", "value", 0.4572), (1001, "Sig0_1"): ("lin", "value", 9.0309), (1002, "Freeboard"): ("mm", "note", 0.3),
        (1002, "SSHA_interp"): ("cm", "note", 0.3), (1002, "Sig0_1"): ("cdb", "note", 9.0), (1003, "Freeboard"): ("m", "value", 2.0),
        (1004, "Freeboard"): ("mm", "source", 0.3), (1004, "Sig0_1"): ("cdb", "source", 9.8), (1005, "Freeboard"): ("ft", "source", 0.3048),
        (1005, "SSHA_interp"): ("m", "source", 0.1), (1006, "SSHA_interp"): ("mm", "source", -0.1), (1007, "Freeboard"): ("m", "source", 0.3),
        (1008, "Freeboard"): ("mm", "source", 0.3), (1008, "Sig0_1"): ("cdb", "source", 9.8), (2000, "Freeboard"): ("mm", "inferred", 0.2),
        (1011, "Freeboard"): ("m", "source", 0.4), (1012, "Freeboard"): ("m", "note", 0.5), (1012, "SSHA_interp"): ("mm", "note", 0.01), (1012, "Sig0_1"): ("cdb", "note", 9.0),
        (1013, "Freeboard"): ("mm", "note", 0.1), (1013, "SSHA_interp"): ("cm", "note", 0.2),
    }
    for k, (u, by, v) in want.items():
        assert got[k][:2] == (u, by), (k, got[k])
        assert got[k][2] == pytest.approx(v, abs=1e-4)
    assert not {k for k in got if k[0] == 1010} and (1003, "Sig0_1") not in got and (1001, "SSHA_interp") not in got


def test_units_empty_and_null(spark):
    none = spark.createDataFrame([], REC)
    heads = spark.createDataFrame([], "source_id int, header_text string")
    assert units.normalise(none, heads).count() == 0
    odd = spark.createDataFrame([(None,) * 10, (1, None, None, None, None, None, None, "0.3", None, None), (1, None, None, None, None, None, None, "0.3", None, None)], REC)
    assert [r.unit for r in units.normalise(odd, heads).collect()] == ["m", "m"]


def test_one_unit_per_value(spark):
    """Overlapping, dated and contradictory headers, grouped numbers and unknown units: one row per value always."""
    heads = [
        (1, "until 2014-06-30 heights in mm; heights in metres"), (2, "Freeboard in cm; Freeboard in m since 2010-01-01"), (3, "Freeboard in m; Freeboard in cm"),
        (4, "Freeboard in m"), (4, "Freeboard in cm"),
    ]
    rows = [_rec(100 + i, 4, str(0.2 + 0.01 * (i % 30)), None, None) for i in range(60)]
    rows += [_rec(1, 1, "1.5", None, None, day=5000), _rec(2, 1, "1.5", None, None, day=6000), _rec(3, 2, "1.5", None, None, day=3000), _rec(4, 2, "1.5", None, None, day=5000), _rec(5, 3, "1.5", None, None)]
    texts = ["1,234.5 mm", "12 345 mm", "1.234,5 mm", "1,234,567 um", "1,234", "\u22125 cm", "1'234.5 cm", "0.002 km", "3 in", '3"', "5 parsec", "2 yd", "7 m or 7 ft", "1 234,5 mm", "-1,5e-1 m"]
    rows += [_rec(10 + i, 4, t, None, None) for i, t in enumerate(texts)]
    out = units.normalise(spark.createDataFrame(rows, REC), spark.createDataFrame(heads, "source_id int, header_text string")).collect()
    assert len(out) == len(rows)
    got = {r.rec_id: r for r in out}
    assert [(got[i].unit, got[i].stated_by) for i in range(1, 6)] == [("mm", "source"), ("m", "source"), ("cm", "source"), ("m", "source"), (None, "unresolved")]
    want = [1.2345, 12.345, 1.2345, 1.234567, 0.01234, -0.05, 12.345, 2.0, 0.0762, 0.0762, None, 1.8288, None, 1.2345, -0.15]
    for i, v in enumerate(want):
        assert got[10 + i].common == (None if v is None else pytest.approx(v)), texts[i]
    assert got[20].stated_by == got[22].stated_by == "unresolved" and got[100].unit == "cm"


def test_timeline_of_a_header():
    assert units.timeline([]) == []
    assert units.timeline([("m", None, None)]) == [("0001-01-01", "9999-12-31", "m")]
    got = units.timeline([("m", None, None), ("mm", None, "2014-06-30"), ("cm", "2014-01-01", "2014-01-31")])
    assert got == [("0001-01-01", "2014-01-01", "mm"), ("2014-01-01", "2014-02-01", "cm"), ("2014-02-01", "2014-07-01", "mm"), ("2014-07-01", "9999-12-31", "m")]
    assert units.timeline([("m", "2014-01-01", "2014-01-31"), ("ft", "2014-01-01", "2014-01-31")]) == [("2014-01-01", "2014-02-01", None)]


def test_rare_guess_yields_to_the_other_passes(spark):
    """A pass whose figures are a little nearer to another unit takes the unit of its source's passes."""
    rng = random.Random(5)
    rows = []
    for source in (1, 2):
        for orbit in range(40):
            level = 9.5 * (1 + 0.02 * rng.gauss(0, 1))
            wild = source == 2 and orbit == 7
            for k in range(30):
                v = level * 10 ** (rng.gauss(0, 0.19 if wild else 0.115))
                rows.append((source * 100000 + orbit * 100 + k, source, orbit, 5000, 100, None, None, None, None, f"{v:.3f}"))
    rec = spark.createDataFrame(rows, "rec_id long, source_id int, abs_orbit int, Day int, Second int, days_J2k double, note string, Freeboard string, SSHA_interp string, Sig0_1 string")
    heads = spark.createDataFrame([(1, "Sig0_1 in dB"), (2, None)], "source_id int, header_text string")
    assert {r.unit for r in units.normalise(rec, heads).collect()} == {"db"}


def test_edit_cost_prefers_near_spellings():
    assert units.edit_cost("meter", "metre") < units.edit_cost("meter", "feet")
    assert units.edit_cost("decibell", "decibel") <= 0.5
    assert units.read_statement("Freeboard 1e-3 m", {"freeboard": ("field", "Freeboard"), "m": ("unit", "m")}) == [("Freeboard", "mm", None, None)]


# ---- 2 nearby


def test_plane_join_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    p = [(i, "A" if i % 3 else "B", float(a), float(b)) for i, (a, b) in enumerate(rng.random((600, 2)) * 100)]
    p += [(i, "A", 50.0, 50.0) for i in range(600, 900)]  # a third at one place
    p += [(900, None, 1.0, 1.0), (901, "A", None, 1.0), (902, "A", float("nan"), 1.0), (None, "A", 1.0, 1.0)]
    q = [(i, "A" if i % 2 else "B", float(a), float(b), float(r)) for i, (a, b, r) in enumerate(np.c_[rng.random((60, 2)) * 100, rng.random(60) * 8])]
    q += [(60, "A", 50.0, 50.0, 0.0), (61, "A", 5.0, 5.0, None), (62, "A", 5.0, 5.0, -1.0)]
    left = spark.createDataFrame(p, "point_id long, epsg string, x double, y double").withColumn("lo", F.lit(9)).withColumn("s", F.lit("q"))
    right = spark.createDataFrame(q, "site_id long, epsg string, x double, y double, radius double")
    want = sorted((a[0], b[0]) for a in p for b in q if a[0] is not None and a[1] == b[1] and None not in (a[2], b[4]) and b[4] >= 0 and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= b[4] ** 2)
    for kw in ({}, {"rows_per_task": 50}, {"prefilter": False, "rows_per_task": 50}):
        got = nearby.strip_sweep_join(left, right, "point_id", "site_id", plane="epsg", **kw)
        assert sorted(map(tuple, got.collect())) == want
    e = spark.createDataFrame([], left.schema)
    assert nearby.strip_sweep_join(e, right, "point_id", "site_id", plane="epsg").count() == 0
    assert nearby.strip_sweep_join(left, spark.createDataFrame([], right.schema), "point_id", "site_id", plane="epsg").count() == 0


def test_geographic_join_round_the_globe(spark):
    rng = np.random.default_rng(1)
    lat = np.r_[rng.random(300) * 180 - 90, [89.99, -89.99, 0.0, 0.0]]
    lon = np.r_[rng.random(300) * 720 - 360, [10.0, 200.0, 179.99, -179.99]]
    p = spark.createDataFrame([(i, "w", float(a), float(b)) for i, (a, b) in enumerate(zip(lon, lat))], "point_id long, plane string, x double, y double")
    q = p.select(F.col("point_id").alias("site_id"), "plane", (F.col("x") + 360).alias("x"), "y", F.lit(900_000.0).alias("radius"))
    got = set(map(tuple, nearby.strip_sweep_join(p, q, "point_id", "site_id", geographic=True, prefilter=False).collect()))
    a, o = np.radians(lat), np.radians(lon)
    h = np.sin((a[:, None] - a) / 2) ** 2 + np.cos(a[:, None]) * np.cos(a) * np.sin((o[:, None] - o) / 2) ** 2
    d = 2 * nearby.EARTH_M * np.arcsin(np.sqrt(h))
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(d <= 900_000))}


def test_rings_and_projection(spark):
    pts = spark.createDataFrame([(1, 3413, 5.0, 5.0, None, None), (2, 3413, 15.0, 5.0, None, None), (3, 3413, None, None, 90.0, 0.0), (4, 3031, 5.0, 5.0, None, None), (5, 3413, None, None, None, None), (1, 3413, 5.0, 5.0, None, None)], "point_id long, epsg int, x double, y double, latitude double, longitude double")
    st = spark.createDataFrame(
        [(1, "polygon", 3413, None, None, None, None, None, "POLYGON ((-1 -1, 10 -1, 10 10, -1 10, -1 -1))"), (2, "circle", 3413, None, None, 90.0, 12.0, 7.5, None), (3, "polygon", 3413, 0.0, 0.0, None, None, 99.0, "POLYGON ((bad))"), (4, "polygon", 3413, 0.0, 0.0, None, None, 99.0, None)],
        "site_id long, kind string, epsg int, x double, y double, latitude double, longitude double, radius_m double, ring string",
    )
    got = sorted(map(tuple, nearby.points_in_sites(pts, st).collect()))
    assert got == [(1, 1), (1, 1), (1, 2), (1, 2), (3, 1), (3, 2)]


def test_holes_parts_and_tall_regions(spark):
    """Holes and parts by the even-odd rule, any spacing and a third coordinate; one region as tall as all others together."""
    hole = "POLYGON((0 0,10 0,10 10,0 10,0 0),(4 4, 6 4, 6 6, 4 6, 4 4))"
    multi = "MULTIPOLYGON ( ( (20 0 1, 30 0 1, 30 10 1, 20 10 1) ) , ((40 0, 50 0, 50 10, 40 10, 40 0), (44 4, 46 4, 46 6, 44 6)) )"
    tall = "POLYGON ((0 0, 1 0, 1 100, 0 100, 0 0))"
    shapes = {1: [(0, 10, 0, 10, 1), (4, 6, 4, 6, -1)], 2: [(20, 30, 0, 10, 1), (40, 50, 0, 10, 1), (44, 46, 4, 6, -1)], 3: [(0, 1, 0, 100, 1)]}
    rng = np.random.default_rng(6)
    xy = [(i, float(a), float(b)) for i, (a, b) in enumerate(np.c_[rng.random(800) * 55 - 2, rng.random(800) * 12 - 1])] + [(900 + i, 0.5, float(i) + 0.25) for i in range(100)]
    pts = spark.createDataFrame([(i, 1, a, b) for i, a, b in xy], "point_id long, plane int, x double, y double")
    st = spark.createDataFrame([(1, 1, hole), (2, 1, multi), (3, 1, tall), (4, 1, "POLYGON ((1 1, 2 x, 3 3))"), (5, 1, "POLYGON EMPTY"), (6, 1, "")] + [(10 + i, 1, f"POLYGON ((60 {i}, 61 {i}, 61 {i + 1}))") for i in range(60)], "site_id long, plane int, ring string")
    st = st.selectExpr("*", "cast(null as double) x", "cast(null as double) y", "cast(null as double) radius")
    want = sorted((i, k) for i, a, b in xy for k, boxes in shapes.items() if sum(s for x0, x1, y0, y1, s in boxes if x0 < a < x1 and y0 < b < y1) > 0)
    for kw in ({}, {"rows_per_task": 40}, {"prefilter": False}):
        assert sorted(map(tuple, nearby.strip_sweep_join(pts, st, "point_id", "site_id", ring="ring", **kw).collect())) == want


# ---- 3 drift


def _drift_input(spark):
    t0 = dt.datetime(2020, 1, 1)
    files, recs, n = [], [], 0
    for s in range(6):
        for k in range(6):
            f = s * 10 + k
            files.append((f, f"s{s}", t0 + dt.timedelta(days=k)))
            if k == 3:
                continue  # a file without records
            for i in range(4):
                d = {"id": i, "h": 100.25 + i, "flag": 7}
                d["sigma" if k < 2 else "geo_sigma"] = 0.01 * (i + 1)
                if k >= 4:
                    d["h"] = str(d["h"])
                    d["note"] = "late"
                if i == 3:
                    d["flag"] = None
                if k == 5:
                    d.pop("flag")
                recs.append((n, f, json.dumps(d)))
                n += 1
    recs += [(n, 0, None), (n + 1, 0, "no json"), (n + 2, None, '{"zz": 1}'), (n + 3, 777, '{"zz": 1}'), (n + 4, 0, "[1]")]
    return spark.createDataFrame(recs, "rec_id long, file_id long, payload string"), spark.createDataFrame(files, "file_id long, stream_id string, acquired_at timestamp").withColumn("key", F.lit("clash"))


DRIFT_TARGET = {"id": "bigint", "h": "double", "flag": "bigint", "sigma": "double"}


def _changes(recs, files, target=DRIFT_TARGET):
    return drift.changes(drift.ingest(recs, target), files, target)


def test_changes(spark):
    recs, files = _drift_input(spark)
    want = [(2, "renamed", "sigma", "geo_sigma"), (4, "added", "", "note"), (4, "retyped", "h", "h"), (5, "removed", "flag", "")]
    # the report is the same whatever part of the fields the target schema knows
    for target in (DRIFT_TARGET, {}, {"geo_sigma": "double", "note": "string", "h": "bigint"}):
        assert sorted(tuple(r) for r in _changes(recs, files, target).collect() if r.file_id < 10) == want
    assert _changes(recs.where("false"), files).count() == 0
    assert _changes(recs, files.where("false")).count() == 0


def test_the_report_reads_the_ingested_table(spark):
    """What ingestion drops is in no report: without the rescued values only typed columns are left to compare."""
    recs, files = _drift_input(spark)
    blind = drift.ingest(recs, DRIFT_TARGET).withColumn("rescued", F.lit(None).cast("string"))
    got = sorted(tuple(r) for r in drift.changes(blind, files, DRIFT_TARGET).collect() if r.file_id < 10)
    assert got == [(2, "removed", "sigma", ""), (4, "removed", "h", ""), (5, "removed", "flag", "")]


def test_contested_partners(spark):
    """Two like fields change names in one file: each gets a partner, the nearer names first."""
    recs = [(f, json.dumps({"time": 1.0 + i, **({"height_a": 5.5 + i, "height_b": 5.6 + i} if f < 2 else {"hgt_a": 5.5 + i, "q_height_a": 5.7 + i})})) for f in range(4) for i in range(6)]
    files = spark.createDataFrame([(f, "s", dt.datetime(2020, 1, 1 + f)) for f in range(4)], "file_id long, stream_id string, acquired_at timestamp")
    got = sorted(tuple(r) for r in _changes(spark.createDataFrame(recs, "file_id long, payload string"), files, {}).collect())
    assert got == [(2, "renamed", "height_a", "q_height_a"), (2, "renamed", "height_b", "hgt_a")]


def test_ingest_and_replay(spark):
    d = spark.createDataFrame([(1, '{"a": 1, "b": "x", "old": 2.5}'), (2, '{"a": "no", "new": 3.5, "n": null}'), (3, "broken"), (4, None), (5, '{"a": 5, "a": 6}'), (6, '{"a": "7", "new": 8, "l": [1, 2]}'), (7, '{"a": 99999999999}')], "rec_id long, payload string").withColumn("a", F.lit("mine"))
    t = drift.ingest(d, {"a": "int", "new": "double", "l": "array<bigint>"})
    rows = {r.rec_id: r for r in t.collect()}
    left = {k: json.loads(r.rescued) if r.rescued else None for k, r in rows.items()}
    assert rows[1].a == 1 and rows[1].record_a == "mine" and left[1] == {"b": "x", "old": 2.5}
    assert rows[2].a is None and left[2] == {"a": "no", "n": None} and rows[2].new == 3.5
    assert left[3] == {"_text": "broken"} and rows[4].rescued is None
    assert rows[5].a is None and rows[5].rescued == '{"a":5,"a":6}'  # a name twice: kept whole
    assert left[6] == {"a": "7", "new": 8} and rows[6].l == [1, 2] and left[7] == {"a": 99999999999} and rows[7].a is None
    p = {r.rec_id: r for r in drift.promote(t, {"new": ("double", ["old"]), "a": ("int", [])}).collect()}
    assert p[1].new == 2.5 and json.loads(p[1].rescued) == {"b": "x"} and p[2].new == 3.5
    assert p[6].a == 7 and p[6].new == 8.0 and p[6].rescued is None and json.loads(p[7].rescued) == {"a": 99999999999} and json.loads(p[2].rescued) == {"a": "no", "n": None}


def test_consistent_table_holds_every_record(spark):
    recs, files = _drift_input(spark)
    t = drift.consistent(recs, files, DRIFT_TARGET)
    got = {r.rec_id: r.asDict() for r in t.collect()}
    assert sorted(got) == sorted(r.rec_id for r in recs.collect())
    # the name most values stand under; the other one is replayed into it
    names = {"sigma", "geo_sigma"} & set(t.columns)
    assert len(names) == 1
    name = names.pop()
    for r in recs.collect():
        try:
            d = json.loads(r.payload)
        except (TypeError, ValueError):
            d = None
        if not isinstance(d, dict):
            continue
        row, left = got[r.rec_id], json.loads(got[r.rec_id]["rescued"] or "{}")
        assert row[name] == d.get("sigma", d.get("geo_sigma"))
        # nothing is lost: a value is in its column, replayed there from text too, or rescued as it was
        for k, v in d.items():
            c = name if k in ("sigma", "geo_sigma") else k
            assert (k in left and left[k] == v) or (row.get(c) is not None and str(row[c]) == str(v)), (k, v)
        if "h" in d:
            assert row["h"] == float(d["h"])
    broken = [r for r in got.values() if r["rescued"] and "no json" in r["rescued"]]
    assert len(broken) == 1


def test_families_of_names():
    f = drift.families([("Wfm", "list", 5), ("wfm", "list", 9), ("n", "integer", 9), ("n", "number", 2), ("N", "text", 1), ("rec_id", "integer", 3), ("a b", None, 0)], [("Wfm", "wfm")], ["rec_id"])
    assert f == {"wfm": ("string", ["wfm", "Wfm"]), "n": ("double", ["n"]), "rec_id_2": ("bigint", ["rec_id"]), "N_2": ("string", ["N"]), "a_b": ("string", ["a b"])}


# ---- 5 instants

LOG = "log_id long, instrument string, station_id int, time_text string, delta_time double, days_J2k double, Day int, Second int, Micsec int, written_at timestamp_ntz"
STATIONS = [(1, "Europe/Oslo", "dmy"), (2, "America/Anchorage", "mdy"), (3, "Asia/Kolkata", "dmy"), (4, "UTC", "ymd"), (5, None, None)]


def _log(spark, rows):
    full = [(i, ins, st, *(v if isinstance(v, tuple) else (v, None, None, None, None, None)), w) for i, ins, st, v, w in rows]
    st = spark.createDataFrame(STATIONS, "station_id int, zone string, date_order string").withColumn("name", F.lit("x"))
    return spark.createDataFrame(full, LOG), st


def test_every_form_gives_the_instant(spark):
    t = dt.datetime(2021, 7, 5, 13, 45, 6, 250000, tzinfo=dt.timezone.utc)
    oslo, anc, kol = (t.astimezone(ZoneInfo(z)) for z in ("Europe/Oslo", "America/Anchorage", "Asia/Kolkata"))
    us = round(t.timestamp() * 1e6)
    days = (t - dt.datetime(2000, 1, 1, tzinfo=dt.timezone.utc)) / dt.timedelta(days=1)
    tai = (t - dt.datetime(2000, 1, 1, tzinfo=dt.timezone.utc)).total_seconds() + 37
    w = dt.datetime(2021, 7, 5, 14, 0)
    forms = [
        (1, t.strftime("%Y-%m-%dT%H:%M:%S.250000Z")), (1, oslo.strftime("%d/%m/%Y %H:%M:%S")), (2, anc.strftime("%m/%d/%Y %I:%M:%S %p")), (1, oslo.strftime("%Y-%m-%d %H:%M:%S.250")),
        (1, oslo.strftime("%Y-%m-%d %H:%M:%S.250+0200")), (3, kol.strftime("%d %b %Y %H:%M:%S IST")), (2, anc.strftime("%d %b %Y %H:%M:%S AKDT")), (4, t.strftime("%Y%m%dT%H%M%SZ")),
        (4, t.strftime("%Y-%jT%H:%M:%S.250Z")), (4, f"{us // 1000}"), (4, f"{us / 1e6:.2f}"), (4, t.strftime("%Y/%m/%d %H:%M:%S")), (5, t.strftime("%Y-%m-%d %H:%M:%S")),
        (1, (None, us / 1e6 - 1514764800, None, None, None, None)), (1, (None, None, days, None, None, None)), (1, (None, None, None, int(tai // 86400), int(tai % 86400), 250000)),
    ]
    log, st = _log(spark, [(i, "a", s, v, w) for i, (s, v) in enumerate(forms)])
    got = {r.log_id: r for r in instants.resolve(log.withColumn("zone", F.lit("clash")), st).collect()}
    assert len(got) == len(forms)
    for i, r in got.items():
        assert us - 1_000_000 < r.us <= us + 10 and r.us + r.grain_us >= us - 10, (forms[i], r)
    pairs = instants.within(instants.resolve(log, st)).count()
    assert pairs == len(forms) * (len(forms) - 1) // 2


def test_autumn_hour_unknown_order_and_ambiguity(spark):
    fold = "2021-10-31 02:30:00"  # twice in Oslo: 00:30 and 01:30 UTC
    sure = [(100 + i, "a", 1, f"2021-10-{d:02d} 12:00:00", dt.datetime(2021, 10, d, 10, 5)) for i, d in enumerate(range(1, 29))]
    rows = [
        *sure,
        (1, "a", 1, fold, dt.datetime(2021, 10, 31, 0, 36)),
        (2, "a", 1, fold, dt.datetime(2021, 10, 31, 1, 35)),
        (3, "a", 1, fold, None),
        (4, "a", 5, "05/06/2021 10:00:00", dt.datetime(2021, 6, 5, 10, 7)),
        (5, "a", 5, "25/06/2021 10:00:00", None),
        (6, "a", 1, "nonsense", None),
        (7, "a", 1, "", None),
        (8, "a", 1, (None, float("nan"), None, None, None, None), None),
        (9, None, 1, "31/12/2021 25:00:00", None),
    ]
    log, st = _log(spark, rows)
    got = {r.log_id: r for r in instants.resolve(log, st).collect()}
    utc = lambda *a: int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp() * 1e6)
    assert got[1].us == utc(2021, 10, 31, 0, 30) and got[2].us == utc(2021, 10, 31, 1, 30)
    assert got[3].ambiguous and got[3].us in (utc(2021, 10, 31, 0, 30), utc(2021, 10, 31, 1, 30))
    assert got[4].us == utc(2021, 6, 5, 10) and not got[4].ambiguous
    assert got[5].us == utc(2021, 6, 25, 10)
    assert not {6, 7, 8} & got.keys()


def test_the_mixture_decides(spark):
    """A source without known order: its unambiguous entries show how it writes, though nothing is known of the delays."""
    rows = [(i, "a", 5, f"{13 + i}/06/2021 10:00:00", None) for i in range(12)] + [(i + 20, "b", 5, f"06/{13 + i}/2021 10:00:00", None) for i in range(12)]
    rows += [(50, "a", 5, "03/04/2021 10:00:00", None), (51, "b", 5, "03/04/2021 10:00:00", None), (52, "c", 5, "03/04/2021 10:00:00", None)]
    # the sheet of station 1 says day first; that yields only where it gives an instant after the writing
    rows += [(60, "d", 1, "03/04/2021 10:00:00", dt.datetime(2021, 4, 3, 8, 10)), (61, "d", 1, "03/04/2021 10:00:00", dt.datetime(2021, 3, 4, 9, 10)), (62, "d", 1, "03/04/2021 10:00:00", None)]
    # letters shared by zones: the station's own meaning, another only where that is impossible
    rows += [(70, "e", 3, "03 Apr 2021 10:00:00 IST", None), (71, "e", 4, "03 Apr 2021 10:00:00 IST", dt.datetime(2021, 4, 3, 4, 40))]
    log, st = _log(spark, rows)
    got = {r.log_id: r for r in instants.resolve(log, st).collect()}
    utc = lambda *a: int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp() * 1e6)
    assert got[50].us == utc(2021, 4, 3, 10) and got[51].us == utc(2021, 3, 4, 10) and not got[50].ambiguous and not got[51].ambiguous
    assert got[52].ambiguous
    assert got[60].us == got[62].us == utc(2021, 4, 3, 8) and got[61].us == utc(2021, 3, 4, 9)
    assert got[70].us == got[71].us == utc(2021, 4, 3, 4, 30)


def test_mixture_weights():
    """The same readings are judged by the company they keep; without company the prior decides."""
    two = [("dmy", -2, 1.0), ("mdy", -2, 1.0)]
    assert instants.mixture([(two, 1), ([("mdy", -2, 1.0)], 30)], {})[0][0] == 1
    assert instants.mixture([(two, 1), ([("dmy", -2, 1.0)], 30)], {})[0] == (0, pytest.approx(1, abs=0.05))
    assert instants.mixture([(two, 1)], {}) == [(0, pytest.approx(0.5))]
    assert instants.mixture([([("dmy", -1, instants.TRUST), ("mdy", 3, 1.0)], 1)], {3: 1.0})[0][0] == 1
    assert instants.mixture([], {}) == []


def test_no_log(spark):
    log, st = _log(spark, [])
    assert instants.resolve(log, st).count() == 0 and instants.within(instants.resolve(log, st)).count() == 0


def test_pairs_at_bucket_edges(spark):
    rng = np.random.default_rng(4)
    us = np.sort(rng.integers(0, 20_000_000, 60))
    d = spark.createDataFrame([(int(i), "a" if i % 2 else "b", int(u)) for i, u in enumerate(us)] + [(99, None, 5)], "log_id long, instrument string, us long")
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if i % 2 == j % 2 and us[j] - us[i] <= 1_000_000}
    got = [tuple(r) for r in instants.within(d).collect()]
    assert len(got) == len(set(got)) and set(got) == want


# ---- 6 spikes


def _flags(spark, rows, **kw):
    d = spark.createDataFrame(rows, "point_id long, rgt int, pass int, t double, h double").withColumn("src", F.lit("clash")).withColumn("v", F.lit(0))
    got = spikes.flag_readings(d, row_id="point_id", value="h", source=["rgt"], within=["rgt", "pass"], order=["t"], low=-500, high=9000, fills=(3.4028235e38,), **kw)
    return {r.point_id: r.reason for r in got.collect()}


def test_spikes_steps_and_stuck(spark):
    rng = np.random.default_rng(7)
    rows, want, n = [], {}, 0
    for p in range(8):
        h = 1000 + 0.05 * np.arange(120) + rng.normal(0, 0.2, 120)
        h[60:] += 15  # a lasting step is no case
        bad = {20: h[20] + 9, 21: h[21] - 12, 90: h[90] - 8, 0: h[0] + 10, 119: h[119] - 10, 40: 50_000.0, 41: -5000.0}
        for i, v in bad.items():
            h[i] = v
        h[100:107] = h[100]
        h[30:35] = h[30]  # only five alike
        for i in range(120):
            v = h[i]
            rows.append((n, 1, p, float(i), float(v)))
            if i in bad:
                want[n] = "limit" if i in (40, 41) else "spike"
            if 100 <= i < 107:
                want[n] = "stuck"
            if i == 20:
                rows.append((n + 100_000, 1, p, float(i), float(v)))  # sent twice
                want[n + 100_000] = "spike"
            n += 1
        rows += [(200_000 + p * 10 + j, 1, p, 50.5 + j / 10, v) for j, v in enumerate((None, float("nan"), 3.4028235e38))]
    rows += [(300_000, 2, 1, 0.0, 5.0), (300_001, 2, 1, 1.0, 5.0), (300_002, None, None, None, 7.0)]
    assert _flags(spark, rows) == want


def test_long_pass_is_cut(spark, monkeypatch):
    monkeypatch.setattr(spikes, "BLOCK", 200)
    rng = np.random.default_rng(3)
    h = np.cumsum(rng.normal(0, 0.05, 3000)) + rng.normal(0, 0.1, 3000)
    bad = set(range(17, 3000, 97))
    rows = [(i, 1, 1, float(i), float(v + (6 if i in bad else 0))) for i, v in enumerate(h)]
    assert set(_flags(spark, rows)) == bad
    # unevenly spaced, and one reading a third of all rows
    hot = [(100_000 + j, 1, 1, float(17**1.5), rows[17][4]) for j in range(1500)]
    uneven = [(i, a, b, t**1.5, v) for i, a, b, t, v in rows] + hot + [(200_000 + i, 2, 5, float(i), float(h[i])) for i in range(150)]
    assert set(_flags(spark, uneven)) == bad | {r[0] for r in hot}
    flat = [(i, 1, 1, float(i), 5.0 if 700 <= i < 720 else float(h[i])) for i in range(3000)]
    assert {i for i, why in _flags(spark, flat).items() if why == "stuck"} == set(range(700, 720))


def test_cuts_make_no_difference(spark, monkeypatch):
    """A pass of 30,000 readings gives the same in blocks of 500 as in one, with outliers, steps and runs at the cuts."""
    rng = np.random.default_rng(8)
    n = 30_000
    h = np.cumsum(rng.normal(0, 0.02, n)) + rng.normal(0, 0.2, n)
    bad = {i + d for i in range(500, n, 500) for d in (0, -1, 3)} | set(range(40, n, 271))
    for i in bad:
        h[i] += 9
    for i in range(0, n, 2777):
        h[i:] += rng.normal(0, 8)
    h[9997:10004] = h[9997]
    rows = [(i, 1, 1, float(i), float(v)) for i, v in enumerate(h)]
    got = []
    for block in (500, 100_000):
        monkeypatch.setattr(spikes, "BLOCK", block)
        got.append(_flags(spark, rows))
    assert got[0] == got[1] and {i for i, why in got[0].items() if why == "stuck"} == set(range(9997, 10004))
    far = {i for i in bad if all(abs(i - k) > 6 for k in range(0, n, 2777)) and not 9990 < i < 10010}
    assert far <= set(got[0]) and len(set(got[0]) - bad) < 20


def test_the_autoregression_decides():
    """With the coefficients of its source an outlier of a noisy pass is found, without them it is not; a lasting shift is none."""
    rng = np.random.default_rng(1)
    n = 400
    v = 0.5 * np.arange(n) ** 0.5 + rng.normal(0, 1.0, n)
    v[100] += 8.5
    v[200:] += 25
    v[300:303] -= 12
    phi = np.array([[-(6 - k) / 6 for k in range(1, 6)]])
    own = 1.08  # scatter of the residuals with them
    y, size = spikes.clean(v, np.array([0]), phi, np.array([own]))
    assert set(np.flatnonzero(np.abs(size) > spikes.SPIKE * own)) == {100, 300, 301, 302}
    raw = 1.4826 * np.median(np.abs(np.diff(v)))
    _, none = spikes.clean(v, np.array([0]), 0 * phi, np.array([raw]))
    assert 100 not in np.flatnonzero(np.abs(none) > spikes.SPIKE * raw)
    assert abs(y[300] - v[299] + 25) < 5 and abs(y[100] - y[99]) < 4


def test_suspects():
    """Short levels and their neighbourhood are doubtful, lasting ones are not."""
    at = lambda *k: np.isin(np.arange(30), k)
    got = lambda spike, shift: np.flatnonzero(spikes.suspects(spike, shift)).tolist()
    assert got(at(), at()) == []
    assert got(at(), at(10, 13)) == [10, 11, 12] and got(at(), at(10, 20)) == []
    assert got(at(10, 12), at(14)) == [10, 11, 12, 13] and got(at(5), at(20)) == [5]
    assert got(at(), at(2, 28)) == [0, 1, 28, 29]


def test_both_sides():
    """A burst of unlike outliers is found reading by reading; a good reading amid them and the edge of a lasting step are not."""
    phi = np.array([-(6 - k) / 6 for k in range(1, 6)])
    v = np.array([1374.98, 1375.24, 1375.03, 1374.73, 1370.63, 1371.9, 1367.47, 1365.83, 1374.34, 1374.42, 1379.74, 1374.08, 1373.85, 1373.58, 1373.33])
    doubt = np.arange(15) > 3
    doubt[11:] = False
    assert np.flatnonzero(np.abs(spikes.both_sides(v, doubt, phi, 0.25)) > spikes.SPIKE * 0.25).tolist() == [4, 5, 6, 7, 10]
    step = np.r_[np.full(8, 5.0), 9, 9, 40, np.full(8, 9.0)] + np.tile([0, 0.1], 10)[:19]
    doubt = np.isin(np.arange(19), (8, 9, 10))
    assert np.flatnonzero(np.abs(spikes.both_sides(step, doubt, phi, 0.1)) > 0.64).tolist() == [10]
    assert not spikes.both_sides(v, np.ones(15, bool), phi, 0.25).any()


def test_copies_make_no_run(spark):
    rows = [(i, 1, 1, float(i // 3), float(i // 3 % 2)) for i in range(60)] + [(100 + i, 1, 2, 1.0, 3.0) for i in range(8)]
    assert _flags(spark, rows) == {}


def test_no_readings(spark):
    assert _flags(spark, []) == {}
    assert _flags(spark, [(1, 1, 1, 0.0, None)]) == {}


# ---- 7 compaction

SAME = ['{"b": 1.50, "a": [1, 2.0]}', '{"a":[1,2],"b":1.5}', '{ "a" : [ 1.0 , 2 ], "b" : 15e-1 }']
OTHER = ['{"a":[1,2],"b":"1.5"}', '{"a":[1,2]}', '{"a":[1,2],"b":null}', '{"a":[2,1],"b":1.5}', '{"a":[1,2],"b":1.5,"c":null}', "no json", "", '{"a":1,"a":2}', '{"x":"\\u0041"}', '{"x":12345678901234567890.5}']


def test_canonical_json(spark):
    d = spark.createDataFrame([(t,) for t in SAME + OTHER + [None, '{"x":"A"}', '{"x":12345678901234567890.50}']], "p string")
    got = [r.c for r in d.select(canonical(F.col("p")).alias("c")).collect()]
    assert len(set(got[:3])) == 1 and len(set(got[:13])) == 11 and got[13] is None
    assert got[11] == got[14] and got[12] == got[15]
    assert [canonical_text(t) for t in SAME] == [got[0]] * 3


def test_repeated_records(spark, tmp_path):
    rows = [(i, i % 4, i, SAME[i % 3]) for i in range(9)] + [(20 + i, 1, i, t) for i, t in enumerate(OTHER)] + [(50, 1, 0, None), (51, 1, 0, None), (52, 99, 0, SAME[0]), (53, None, 0, SAME[0])]
    spark.createDataFrame(rows, "rec_id long, file_id long, rec_no int, payload string").repartition(7).write.parquet(str(tmp_path / "in"))
    files = spark.createDataFrame([(0, "x"), (1, "x"), (2, "y"), (3, "y")], "file_id long, stream_id string").withColumn("fp_a", F.lit(1))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    table = compact_files(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "log"), prepare=fingerprinted, files_per_batch=3)
    assert table.count() == len(rows)
    assert sorted(r.rec_id for r in repeated(table, files).collect()) == [1, 3, 4, 5, 6, 7, 8]
    assert settled(table, files).count() == len(rows) - 7
