"""Radar altimeter products: ASCII product headers and packed level-2 and level-1b records."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from firnline.functions.times import GPS_LEAPS
from firnline.sources.packed import Field, columns, dtype, layout, read_binary, schema

BLOCKS = 20
# fixed values: record layouts in file order (name, type, scale to SI)
_TIME = "Day i4, Second i4, Micsec i4"
_CORR = """dryTrop i2 1e-3, wetTrop i2 1e-3, InvBar i2 1e-3, DAC i2 1e-3, Iono i2 1e-3, SSB i2 1e-3, ocTideElv i2 1e-3, lpeTideElv i2 1e-3, olTideElv i2 1e-3,
seTideElv i2 1e-3, gpTideElv i2 1e-3, Spare1 i2, Surf_type u8, MSS_Geoid i4 1e-3, ODLE i4 1e-3, Ice_conc i2 1e-2, Snow_depth i2 1e-3, Snow_density i2, Spare2 i2,
C_status u4, SWH i2 1e-3, Wind_speed u2 1e-3, Spare3 i2, Spare4 i2, Spare5 i2, Spare6 i2"""
L2 = {
    "AB": (
        layout(f"{_TIME}, Siral_mode u8, Lat_1Hz i4 1e-7, Lon_1Hz i4 1e-7, Alt_1Hz i4 1e-3, Mispointing i2 1e-3, N_valid i2"),
        layout(_CORR),
        layout("""D_time_mics i4, Lat i4 1e-7, Lon i4 1e-7, Elev i4 1e-3, SSHA_interp i2 1e-3, SSHA_interp_count i2, SSHA_interp_RMS i2 1e-3, Sig0 i2 1e-2, Peakiness u2 1e-2,
            Freeboard i2 1e-3, N_avg i2, Spare1 i2, Quality_flag u4, Spare2 i2, Spare3 i2, Spare4 i2, Spare5 i2"""),
    ),
    "C": (
        layout(f"{_TIME}, Siral_mode u8, Lat_1Hz i4 1e-7, Lon_1Hz i4 1e-7, Alt_1Hz i4 1e-3, Roll i4 1e-7, Pitch i4 1e-7, Yaw i4 1e-7, Spare i2, N_valid i2"),
        layout(_CORR),
        layout("""D_time_mics i4, Lat i4 1e-7, Lon i4 1e-7, Elev_1 i4 1e-3, Elev_2 i4 1e-3, Elev_3 i4 1e-3, Sig0_1 i2 1e-2, Sig0_2 i2 1e-2, Sig0_3 i2 1e-2, Freeboard i2 1e-3,
            SSHA_interp i2 1e-3, SSHA_interp_count i2, SSHA_interp_RMS i2 1e-3, Peakiness u2 1e-2, N_avg i2, Spare1 i2, Quality_flag u4, Corrections_flag u4, Quality_1 i4, Quality_2 i4, Quality_3 i4"""),
    ),
}
_LOC = """Day i4, Second u4, Micsec u4, USO_Corr i4 1e-15, Mode_ID u2, SSC u2, Inst_config u4, Rec_Count u4, Lat i4 1e-7, Lon i4 1e-7, Alt i4 1e-3, Alt_rate i4 1e-3,
Sat_velocity i4*3 1e-3, Real_beam i4*3 1e-6, Baseline i4*3 1e-6"""
L1B_LOCATION = {"AB": layout(f"{_LOC}, MCD u4"), "C": layout(f"{_LOC}, ST_ID i2, Roll i4 1e-7, Pitch i4 1e-7, Yaw i4 1e-7, MCD u4, Spares i2*2")}
L1B_DATA = layout("""TD i8 1e-12, H_0 i4 4.88e-11, COR2 i4 3.05e-12, LAI i4 1.25e-8, FAI i4 4.8828125e-11, AGC_CH1 i4 1e-2, AGC_CH2 i4 1e-2, TR_gain_CH1 i4 1e-2, TR_gain_CH2 i4 1e-2,
TX_Power i4 1e-6, Doppler_range i4 1e-3, TR_inst_range i4 1e-3, R_inst_range i4 1e-3, TR_inst_gain i4 1e-2, R_inst_gain i4 1e-2, Internal_phase i4 1e-6, External_phase i4 1e-6,
Noise_power i4 1e-2, Phase_slope i4 1e-6, Spares1 i1*4""")
L1B_GEOMETRY = layout("""dryTrop i4 1e-3, wetTrop i4 1e-3, InvBar i4 1e-3, DAC i4 1e-3, Iono_GIM i4 1e-3, Iono_model i4 1e-3, ocTideElv i4 1e-3, lpeTideElv i4 1e-3, olTideElv i4 1e-3,
seTideElv i4 1e-3, gpTideElv i4 1e-3, Surf_type u4, Spare1 i1*4, Corr_status u4, Corr_error u4, Spare2 i1*4""")
# fixed values: samples of the averaged and of the 20 Hz waveforms by baseline and mode
SAMPLES_1HZ = {"LRM": 128, "SAR": 128, "SIN": 512}
SAMPLES = {("AB", "LRM"): 128, ("AB", "SAR"): 128, ("AB", "SIN"): 512, ("C", "LRM"): 128, ("C", "SAR"): 256, ("C", "SIN"): 1024}


def l1b_waveforms(baseline: str, mode: str) -> tuple[list[Field], list[Field]]:
    """Layouts of the averaged waveform and of one 20 Hz waveform."""
    n = SAMPLES[baseline, mode]
    echo = "Linear_Wfm_Multiplier i4, Power2_Wfm_Multiplier i4, N_avg_echoes u2, Flags u2"
    one = layout(f"Day i4, Second u4, Micsec u4, Lat i4 1e-7, Lon i4 1e-7, Alt i4 1e-3, TD i8 1e-12, Waveform u2*{SAMPLES_1HZ[mode]}, {echo}")
    beam = "Beam_SD u2, Beam_Center u2, Beam_Amplitude i2, Beam_Skewness i2, Beam_Kurtosis i2"
    beam += ", Beam_Spare i2*45" if baseline == "AB" else ", Beam_SD_boresight_angle u2, Beam_Center_boresight_angle i2, Beam_Spare i2*43"
    many = f"Waveform u2*{n}, {echo}" + (f", {beam}" if mode != "LRM" else "") + (f", Coherence i2*{n}, Phase_diff i4*{n}" if mode == "SIN" else "")
    return one, layout(many)


_PAIR = re.compile(rb'^([A-Z0-9_]+)=(?:"([^"]*)"?|(.*))$')


def headers(content: bytes) -> tuple[dict[str, str], list[dict[str, str]]]:
    """(product fields, data-set descriptors) of the ASCII part; empty for a file without headers."""
    if not content.startswith(b"PRODUCT="):
        return {}, []
    fields: dict[str, str] = {}
    sets: list[dict[str, str]] = []
    at = 0
    while at < len(content):
        # line by line, until the packed records begin
        end = content.find(b"\n", at)
        line = content[at : end if end >= 0 else len(content)]
        at += len(line) + 1
        m = _PAIR.match(line.strip())
        if not m:
            if any(c > 126 or c < 9 for c in line[:4096]):
                break
            continue
        k = m[1].decode()
        v = (m[2] if m[2] is not None else m[3]).decode("ascii", "replace").strip()
        if k == "DS_NAME":
            sets.append({k: v})
        elif sets and k in ("DS_TYPE", "FILENAME", "DS_OFFSET", "DS_SIZE", "NUM_DSR", "DSR_SIZE", "BYTE_ORDER"):
            sets[-1][k] = v
        else:
            fields.setdefault(k, v)
    return fields, sets


def _number(text: str) -> int:
    return int(re.search(r"[-+]?\d+", text)[0])


def body(content: bytes, record: int) -> tuple[dict[str, str], bytes]:
    """Product fields and the bytes of the measurement records."""
    if len(content) % record == 0 and not content.startswith(b"PRODUCT="):
        return {}, content
    fields, sets = headers(content)
    mine = next((s for s in sets if s.get("DSR_SIZE") and _number(s["DSR_SIZE"]) == record), None)
    if mine is None:
        raise ValueError("no data set of this record size")
    a, n = _number(mine["DS_OFFSET"]), _number(mine["NUM_DSR"])
    if a + n * record > len(content):
        raise OSError("file shorter than its header says")
    return fields, content[a : a + n * record]


def baseline_of(path: str) -> str:
    """``C`` for baseline C files by their name, else ``AB``."""
    m = re.search(r"_\d{8}T\d+_\d{8}T\d+_([A-Z])\d+", path)
    return "C" if m and m[1] == "C" else "AB"


def decode_l2(path: str, content: bytes, baseline: str, unpack: bool = True, only: list[str] | None = None) -> pd.DataFrame:
    """One row per valid 20 Hz measurement, with the 1 Hz and correction fields of its record and ``days_J2k``.

    ``only`` names the columns to make, in their order; none else is unpacked.
    """
    one, corr, many = L2[baseline]
    dt = np.dtype([("a", dtype(one)), ("c", dtype(corr)), ("m", dtype(many), (BLOCKS,))])
    fields, data = body(content, dt.itemsize)
    rec = np.frombuffer(data, dt)
    keep = np.arange(BLOCKS)[None, :] < rec["a"]["N_valid"][:, None]
    r, b = np.nonzero(keep)
    use = lambda fields, prefix="": [f for f in fields if only is None or prefix + f.name in only]
    out = columns(rec["a"][r], use(one), unpack) | columns(rec["c"][r], use(corr, "corr_"), unpack, "corr_") | columns(rec["m"][r, b], use(many, "m_"), unpack, "m_")
    d = pd.DataFrame(out, index=range(len(r)))
    tai = rec["a"]["Day"][r] * 86400.0 + rec["a"]["Second"][r] + (rec["a"]["Micsec"][r].astype(float) + rec["m"]["D_time_mics"][r, b]) / 1e6
    gps = tai + 7300.0 * 86400 - 19
    d["days_J2k"] = (gps - np.searchsorted(np.array(GPS_LEAPS, float), gps, "right")) / 86400 - 7300
    d["block"] = b.astype("int32")
    d["Abs_Orbit"] = int(fields["ABS_ORBIT"]) if "ABS_ORBIT" in fields else None
    d["Ascending_flag"] = fields.get("ASCENDING_FLAG") == "A" if fields else None
    return d if only is None else d[only]


def encode_l2(d: pd.DataFrame, baseline: str) -> bytes:
    """Level-2 records without headers from rows with ``Day, Second, Micsec`` and ``m_``-fields in units of the packed layout.

    Consecutive rows share a record of twenty; its time is that of the first.
    """
    one, corr, many = L2[baseline]
    n = -(-len(d) // BLOCKS)
    rec = np.zeros(n, np.dtype([("a", dtype(one)), ("c", dtype(corr)), ("m", dtype(many), (BLOCKS,))]))
    for f in ("Day", "Second", "Micsec"):
        rec["a"][f] = d[f].to_numpy()[::BLOCKS]
    rec["a"]["N_valid"] = np.minimum(BLOCKS, len(d) - BLOCKS * np.arange(n))
    r, b = np.divmod(np.arange(len(d)), BLOCKS)
    for f in many:
        if f"m_{f.name}" in d.columns:
            rec["m"][f.name][r, b] = d[f"m_{f.name}"].to_numpy()
    return rec.tobytes()


def read_l2(spark: SparkSession, path: str, baseline: str, unpack: bool = True) -> DataFrame:
    one, corr, many = L2[baseline]
    cols = ", ".join([schema(one, unpack), schema(corr, unpack, "corr_"), schema(many, unpack, "m_"), "`days_J2k` double", "`block` int", "`Abs_Orbit` bigint", "`Ascending_flag` boolean"])
    return read_binary(spark, path, lambda p, c: decode_l2(p, c, baseline, unpack), cols)


def decode_l1b(path: str, content: bytes, baseline: str, mode: str, unpack: bool = True) -> pd.DataFrame:
    """One row per 20 Hz waveform with its location and measurement fields and ``days_J2k``."""
    loc, one_many = L1B_LOCATION[baseline], l1b_waveforms(baseline, mode)
    dt = np.dtype([("l", dtype(loc), (BLOCKS,)), ("d", dtype(L1B_DATA), (BLOCKS,)), ("g", dtype(L1B_GEOMETRY)), ("o", dtype(one_many[0])), ("w", dtype(one_many[1]), (BLOCKS,))])
    _, data = body(content, dt.itemsize)
    rec = np.frombuffer(data, dt)
    r, b = np.divmod(np.arange(len(rec) * BLOCKS), BLOCKS)
    out = columns(rec["l"][r, b], loc, unpack) | columns(rec["d"][r, b], L1B_DATA, unpack, "d_") | columns(rec["g"][r], L1B_GEOMETRY, unpack, "g_") | columns(rec["w"][r, b], one_many[1], unpack, "w_")
    d = pd.DataFrame(out)
    gps = rec["l"]["Day"][r, b] * 86400.0 + rec["l"]["Second"][r, b] + rec["l"]["Micsec"][r, b] / 1e6 + 7300.0 * 86400 - 19
    d["days_J2k"] = (gps - np.searchsorted(np.array(GPS_LEAPS, float), gps, "right")) / 86400 - 7300
    d["block"] = b.astype("int32")
    return d


def read_l1b(spark: SparkSession, path: str, baseline: str, mode: str, unpack: bool = True) -> DataFrame:
    loc, (_, many) = L1B_LOCATION[baseline], l1b_waveforms(baseline, mode)
    cols = ", ".join([schema(loc, unpack), schema(L1B_DATA, unpack, "d_"), schema(L1B_GEOMETRY, unpack, "g_"), schema(many, unpack, "w_"), "`days_J2k` double", "`block` int"])
    return read_binary(spark, path, lambda p, c: decode_l1b(p, c, baseline, mode, unpack), cols)
