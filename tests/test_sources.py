import numpy as np
import pytest
from pyspark.sql import functions as F

from firnline import sources
from firnline.functions import geodesy
from firnline.plans import catalogue
from firnline.sources import altimetry, arrays, cryosat, geotiff, glas, granules, packed, qi


def test_polar_example(spark):
    # published example of the projection method: EPSG 9829 with another origin is checked through its inverse
    x, y = geodesy.polar_forward(F.lit(-75.0), F.lit(120.0), 3031)
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    lat, lon = geodesy.polar_inverse(F.lit(r.x), F.lit(r.y), 3031)
    b = spark.range(1).select(lat.alias("a"), lon.alias("b")).first()
    assert (b.a, b.b) == pytest.approx((-75.0, 120.0), abs=1e-9)
    assert spark.range(1).select(geodesy.polar_forward(F.lit(10.0), F.lit(0.0), F.lit(4326))[0].alias("x")).first().x is None


def test_ellipsoid_round_trip():
    lat = np.array([0.0, 45.0, -80.0, 90.0])
    a, h = glas.change_ellipsoid(lat, np.full(4, 100.0))
    b, k = glas.change_ellipsoid(a, h, glas.WGS84, glas.TOPEX)
    assert b == pytest.approx(lat, abs=1e-9) and k == pytest.approx(np.full(4, 100.0), abs=1e-6)
    assert h[0] == pytest.approx(100 + glas.TOPEX[0] - glas.WGS84[0])


@pytest.mark.parametrize("words", [10, 12, 14])
@pytest.mark.parametrize("order", [">", "<"])
def test_qi(spark, tmp_path, words, order):
    rec = np.zeros((5, words), order + "i4")
    rec[:, 0] = [0, 1000, 2000, 3000, 4000]
    rec[:, 1], rec[:, 2], rec[:, 3] = -75_000_000, 120_000_000, 1_234_567
    rec[:, -1] = 123_456_500  # 12:34:56.5
    first = np.zeros(words, order + "i4")
    first[0] = words * 4
    head = np.full((2, words), -1, order + "i4")
    p = tmp_path / "ILATM1B_20161012_120000.qi"
    p.write_bytes(first.tobytes() + head.tobytes() + rec.tobytes())
    rows = sources.read(spark, "qi", str(p)).orderBy("row_number").collect()
    assert len(rows) == 5 and rows[1].rel_time == 1.0 and rows[0].latitude == -75.0 and rows[0].elevation == pytest.approx(1234.567)
    day = (np.datetime64("2016-10-12") - np.datetime64("2000-01-01")).astype(int)
    assert rows[0].days_J2k == pytest.approx(day + (12 * 3600 + 34 * 60 + 56.5 - 17) / 86400, abs=1e-9)
    assert len(qi.decode(str(p), p.read_bytes(), (1, 3))) == 3


def test_icessn(spark, tmp_path):
    p = tmp_path / "ILATM2_20131119_000000_smooth_nadir3seg_50pt.csv"
    p.write_text(
        "# frame ITRF08\n# UTC_Seconds_Of_Day, Latitude(deg), Longitude(deg), WGS84_Ellipsoid_Height(m), South-to-North_Slope, West-to-East_Slope, RMS_Fit(cm), Number_Of_ATM_Measurments_Used, Number_Of_ATM_Measurements_Removed, Distance_Of_Block_To_The_Right_Of_Aircraft(m), Track_Identifier\n"
        "43200.0, -75.1, 120.2, 2345.6, 0.01, 0.02, 7.5, 100, 2, 50, 1\n\nnot,numbers\n"
    )
    r = sources.read(spark, "icessn", str(p)).collect()
    assert len(r) == 1 and r[0].z == 2345.6 and r[0].sigma == 7.5 and r[0].frame == "ITRF08"
    assert r[0].days_J2k == (np.datetime64("2013-11-19") - np.datetime64("2000-01-01")).astype(int) + 0.5


@pytest.mark.parametrize("baseline", ["AB", "C"])
@pytest.mark.parametrize("headed", [False, True])
def test_cryosat_l2(spark, tmp_path, baseline, headed):
    one, corr, many = cryosat.L2[baseline]
    dt = np.dtype([("a", packed.dtype(one)), ("c", packed.dtype(corr)), ("m", packed.dtype(many), (20,))])
    assert dt.itemsize == {"AB": 980, "C": 1392}[baseline]
    rec = np.zeros(3, dt)
    rec["a"]["Day"], rec["a"]["Second"], rec["a"]["N_valid"] = 6300, 43200 + 37, [20, 20, 5]
    rec["m"]["Lat"], rec["m"]["Freeboard"] = -750_000_000, 321
    raw = rec.tobytes()
    if headed:
        text = 'PRODUCT="CS_X"\nABS_ORBIT=+01234\nASCENDING_FLAG=A\nDS_NAME="SIR_SAR_L2"\nDS_TYPE=M\nDS_OFFSET=+{:010d}<bytes>\nDS_SIZE=+1\nNUM_DSR=+0000000003\nDSR_SIZE=+{:010d}<bytes>\n'
        n = len(text.format(0, dt.itemsize))
        raw = text.format(n, dt.itemsize).encode() + raw
    p = tmp_path / "x.DBL"
    p.write_bytes(raw)
    rows = sources.read(spark, "cs2_l2", str(p), baseline=baseline).collect()
    assert len(rows) == 45 and rows[0].m_Lat == pytest.approx(-75.0) and rows[0].m_Freeboard == pytest.approx(0.321)
    assert rows[0].days_J2k == pytest.approx(6300.5, abs=1e-9)
    assert rows[0].Abs_Orbit == (1234 if headed else None)
    assert cryosat.baseline_of("CS_OFFL_SIR_SAR_2__20160105T190732_20160105T191000_C001.DBL") == "C"


@pytest.mark.parametrize("baseline,mode", [("AB", "LRM"), ("AB", "SAR"), ("C", "SIN")])
def test_cryosat_l1b(baseline, mode):
    loc, (one, many) = cryosat.L1B_LOCATION[baseline], cryosat.l1b_waveforms(baseline, mode)
    dt = np.dtype([("l", packed.dtype(loc), (20,)), ("d", packed.dtype(cryosat.L1B_DATA), (20,)), ("g", packed.dtype(cryosat.L1B_GEOMETRY)), ("o", packed.dtype(one)), ("w", packed.dtype(many), (20,))])
    rec = np.zeros(2, dt)
    rec["l"]["Day"], rec["w"]["Waveform"] = 5000, 7
    d = cryosat.decode_l1b("x", rec.tobytes(), baseline, mode)
    assert len(d) == 40 and len(d.w_Waveform[0]) == cryosat.SAMPLES[baseline, mode] and set(d.w_Waveform[3]) == {7}


def test_geotiff_round_trip(spark, tmp_path):
    z = np.arange(2 * 6 * 5, dtype=float).reshape(2, 6, 5)
    z[0, 2, 3] = -9999
    p = tmp_path / "g.tif"
    p.write_bytes(geotiff.write_array(z, 100.0, 10.0, 50.0, 10.0, epsg=3031, nodata=-9999.0))
    got, m = geotiff.read_array(p.read_bytes())
    assert (got == z).all() and (m["x0"], m["y0"], m["nodata"]) == (100.0, 50.0, -9999.0)
    d = sources.read(spark, "geotiff", str(p), bounds=(110.0, 130.0, 60.0, 80.0), bands=[0])
    assert {(r.x, r.y): r.z for r in d.collect()} == {(100 + 10.0 * c, 50 + 10.0 * r): z[0, r, c] for r in (1, 2, 3) for c in (1, 2, 3) if z[0, r, c] != -9999}
    assert sources.read(spark, "geotiff", str(p), skip=2).count() == 2 * 3 * 3


def test_guarded_formats(spark, tmp_path):
    for module, call in (("h5py", lambda: sources.read(spark, "hdf5", str(tmp_path), fields={"": ["x"]})), ("netCDF4", lambda: sources.read(spark, "netcdf", str(tmp_path), field="z"))):
        try:
            __import__(module)
        except ImportError:
            with pytest.raises(RuntimeError, match=module):
                call()
    with pytest.raises(ValueError):
        sources.read(spark, "nothing", "x")
    assert arrays.decode(np.array([1.0, -9999.0]), -9999.0, 2.0, 1.0)[0] == 3.0
    d = spark.createDataFrame([(5.0,), (-9999.0,)], "v double").select(arrays.decoded(F.col("v"), -9999.0, 0.1, 1.0).alias("v"))
    assert [r.v for r in d.collect()] == [1.5, None]


def test_icessn_files_of_two_headers(spark, tmp_path):
    """Each file is read by its own header; one without header by the standard one; further names are kept aside."""
    a = "# Latitude(deg), Longitude(deg), UTC_Seconds_Of_Day, WGS84_Ellipsoid_Height(m), South-to-North_Slope, West-to-East_Slope, RMS_Fit(cm), Number_Of_ATM_Measurments_Used, Number_Of_ATM_Measurements_Removed, Distance_Of_Block_To_The_Right_Of_Aircraft(m), Track_Identifier, Extra(m)\n-75.5, 120.5, 100.0, 11.5, 0, 0, 7.5, 100, 2, 50, 1, 42\n"
    b = "# RMS_Fit(cm), UTC_Seconds_Of_Day, Latitude(deg), Longitude(deg), WGS84_Ellipsoid_Height(m), a, b, c, d\n8.5, 200.0, -76.5, 121.5, 12.5, 0, 0, 0, 0\n"
    c = "300.0 -77.5 122.5 13.5 0 0 9.5 100 2 50 1\n"
    for n, t in (("ILATM2_20131119_000000_a", a), ("ILATM2_20131120_000000_b", b), ("ILATM2_20131121_000000_c", c)):
        (tmp_path / n).write_text(t)
    rows = sorted(sources.read(spark, "icessn", str(tmp_path)).collect(), key=lambda r: r.z)
    assert [(r.latitude, r.longitude, r.utc_seconds_of_day, r.z, r.sigma) for r in rows] == [(-75.5, 120.5, 100.0, 11.5, 7.5), (-76.5, 121.5, 200.0, 12.5, 8.5), (-77.5, 122.5, 300.0, 13.5, 9.5)]
    assert rows[0].other == {"extra": 42.0} and rows[1].track_identifier is None and not rows[2].other


def test_long_product_headers():
    """Headers of any length are read to their end, and no further than the records."""
    lines = [b'PRODUCT="CS_X"'] + [b"NOTE_%05d=" % i + b"x" * 40 for i in range(2000)] + [b"ABS_ORBIT=+01234", b'DS_NAME="L2"', b"NUM_DSR=+3"]
    fields, sets = cryosat.headers(b"\n".join(lines) + b"\n" + bytes(range(128, 256)) * 100 + b"\nABS_ORBIT=+9\n")
    assert fields["ABS_ORBIT"] == "+01234" and fields["NOTE_01999"] == "x" * 40 and sets == [{"DS_NAME": "L2", "NUM_DSR": "+3"}]


def test_granules_by_field_path(spark):
    name = "/a/ATL06_20200101000000_01230411_005_01.h5"
    d = spark.createDataFrame([(name, 7.0, 1.5, 7.0, 100.0), (name, 8.0, 3.4028234663852886e38, None, None)], "source_file string, `gt1l/land_ice_segments/segment_id` double, `gt1l/land_ice_segments/h_li` double, `gt3r/land_ice_segments/segment_id` double, `gt3r/land_ice_segments/ground_track/x_atc` double")
    rows = {(r.BP, r.beam, r.segment_id): r for r in granules.beam_rows(d).collect()}
    assert sorted(rows) == [(1, "l", 7), (1, "l", 8), (3, "r", 7)]
    assert rows[1, "l", 7].h_li == 1.5 and rows[3, "r", 7].x_atc == 100.0 and rows[3, "r", 7].h_li is None and {(r.rgt, r.cycle_number) for r in rows.values()} == {(123, 4)}
    derived = {r.segment_id: r for r in altimetry.derive_segments(granules.beam_rows(d, pairs=(1,))).collect()}
    assert derived[8].h_li is None and derived[7].LR == 0 and derived[7].sigma_geo_r == 0.03
    assert granules.beam_rows(d, pairs=(2,)).count() == 0 and granules.beam_rows(d.where("false")).count() == 0


def test_segments_from_parquet(spark, tmp_path):
    d = spark.createDataFrame([(7.0, 1.5, 0.0), (8.0, 2.5, 20.0)], "`gt1l/land_ice_segments/segment_id` double, `gt1l/land_ice_segments/h_li` double, `gt1l/land_ice_segments/ground_track/x_atc` double")
    d.write.parquet(str(tmp_path / "ATL06_20200101000000_01230411_005_01.parquet"))
    rows = sorted(sources.read(spark, "segments", str(tmp_path / "*.parquet")).collect(), key=lambda r: r.segment_id)
    assert [(r.segment_id, r.h_li, r.beam) for r in rows] == [(7, 1.5, "l"), (8, 2.5, "l")]


def test_shots(spark):
    d = spark.createDataFrame([(70.0, 10.0, 0.7, 0.2, 0.5, 0.01, 0.3, 1, 2), (71.0, 10.0, 0.7, None, 0.5, 0.01, 0.3, 1, 6), (72.0, 10.0, 0.7, 0.2, 0.5, 0.9, 0.3, 1, 6)], "`D/d_lat` double, `D/d_elev` double, `G/d_deltaEllip` double, `G/d_ocElv` double, `E/d_satElevCorr` double, `E/d_IceSVar` double, `R/d_reflctUC` double, `W/i_numPk` int, campaign int")
    got = {r.latitude: r.z for r in granules.shots(d).collect()}
    assert got == {70.0: pytest.approx(10 - 0.7 - 0.2 + 0.5 - 0.017), 71.0: pytest.approx(10 - 0.7 + 0.5 + 0.011)}
    assert granules.shots(d, latitudes=(70.5, 80)).count() == 1


def test_large_files_are_packed_in_parts(spark, monkeypatch):
    rows = spark.range(5000).select((F.col("id") % 2).alias("f"), "id").unionByName(spark.createDataFrame([(None, 9)], "f long, id long"))
    cut = packed.parted(rows, ["f"], ["id"], most=500)
    assert cut.columns == ["f", "id", "part"] and sorted(map(tuple, cut.select("f", "id").collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    assert max(r["count"] for r in cut.groupBy("f", "part").count().collect()) < 750
    sizes = []
    encode = packed.encode_binary
    monkeypatch.setattr(packed, "encode_binary", lambda rows, file, *a: sizes.append(file) or encode(rows, file, *a))
    for name in ("packed_qi", "packed_l2"):
        catalogue.queries()[name](spark, "/root/testdata/sf0.001")
    assert all("part" in f for f in sizes)


def test_rasters_are_packed_in_tiles(spark, monkeypatch):
    far = spark.createDataFrame([(0, 0, 0, 1.5), (0, 3_000_000, 2_000_000, 2.5)], "band long, row long, col long, z double")
    monkeypatch.setattr(catalogue, "cells", lambda s, d: far)
    got = sorted(map(tuple, catalogue.queries()["geotiff_cells"](spark, "").collect()))
    assert got == [(0, 0, 0, 5.0, 2.5, 1.5), (0, 3_000_000, 2_000_000, 20_000_005.0, 15_000_002.5, 2.5)]
