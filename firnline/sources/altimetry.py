"""Laser altimetry along-track products as tables: default fields and derived columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.functions.semantics import nan_to_null
from firnline.functions.times import delta_time_to_matlab
from firnline.operators.crossover import cube, tile_fields
from firnline.operators.tracks import along_track_residuals

# fixed values: default fields of the segment product, by group
SEGMENT_FIELDS = {
    "land_ice_segments": ["delta_time", "h_li", "h_li_sigma", "latitude", "longitude", "atl06_quality_summary", "segment_id", "sigma_geo_h"],
    "land_ice_segments/ground_track": ["x_atc", "y_atc", "seg_azimuth", "sigma_geo_at", "sigma_geo_xt"],
    "land_ice_segments/fit_statistics": ["dh_fit_dx", "dh_fit_dx_sigma", "h_mean", "dh_fit_dy", "h_rms_misfit", "h_robust_sprd", "n_fit_photons", "signal_selection_source", "snr_significance", "w_surface_window_final"],
    "land_ice_segments/geophysical": ["bsnow_conf", "bsnow_h", "cloud_flg_asr", "cloud_flg_atm", "r_eff", "tide_ocean"],
    "derived": ["valid", "BP", "LR", "cycle_number", "rgt"],
}
# fixed values: default fields of the repeat-track product, per point and per cycle
POINT_FIELDS = ["ref_pt", "latitude", "longitude", "dem_h", "x_atc", "fit_quality"]
CYCLE_FIELDS = ["h_corr", "h_corr_sigma", "h_corr_sigma_systematic", "delta_time", "quality_summary"]
FILL_F32 = 3.4028234663852886e38
SEGMENT_METRES = 20.0


def mask_fills(df: DataFrame, fields: list[str], fill: float = FILL_F32) -> DataFrame:
    """Fill values and NaN of floating fields to null."""
    v = lambda f: nan_to_null(F.col(f).cast("double"))
    return df.withColumns({f: F.when(F.abs(v(f)) < fill * 0.999, v(f)) for f in fields})


def granule_numbers(name: Column) -> tuple[Column, Column]:
    """(ground track, cycle) from ``..._TTTTCCRR_...`` in a granule's name."""
    part = lambda a, n: F.regexp_extract(name, r"_(\d{4})(\d{2})(\d{2})_", a).try_cast("int")
    return part(1, 4), part(2, 2)


def derive_segments(df: DataFrame, *, beam: str = "beam", strong: str = "l") -> DataFrame:
    """Fills to null and the derived columns of a granule.

    ``LR`` (0 left, 1 right), ``valid`` (true until a filter says otherwise),
    ``n_pixels`` (16 for the strong beam, 4 for the weak one), ``sigma_geo_r``
    (0.03 where a version has none), ``matlab_time``, and the residuals to the
    neighbours ``min_dh`` and ``rss_dh``.
    """
    out = mask_fills(df, [c for c in ("h_li", "h_li_sigma", "sigma_geo_r") if c in df.columns])
    geo = F.coalesce(F.col("sigma_geo_r"), F.lit(0.03)) if "sigma_geo_r" in df.columns else F.lit(0.03)
    out = out.withColumns({"LR": F.when(F.col(beam) == "l", 0).when(F.col(beam) == "r", 1), "valid": F.lit(True), "n_pixels": F.when(F.col(beam) == strong, 16).when(F.col(beam).isin("l", "r"), 4), "sigma_geo_r": geo, "matlab_time": delta_time_to_matlab(F.col("delta_time"))})
    return along_track_residuals(out, ["rgt", "cycle_number", beam], "segment_id", "h_li", "dh_fit_dx", "x_atc")


def beams_wide(df: DataFrame, keys: list[str], fields: list[str], beam: str = "beam") -> DataFrame:
    """Long beam rows to one row per key with ``<f>_l`` and ``<f>_r``."""
    at = lambda f, b: F.max(F.when(F.col(beam) == b, F.col(f)))
    return df.groupBy(*keys).agg(*[at(f, b).alias(f"{f}_{b}") for f in fields for b in "lr"])


def repeat_track_matrix(per_point: DataFrame, cycles: DataFrame, values: DataFrame, point: str = "ref_pt", cycle: str = "cycle_number") -> DataFrame:
    """Points x cycles with the values of each pair (null where a point was not measured in a cycle)."""
    full = tile_fields(per_point, cycles, cycles.columns)
    return full.join(values, [point, cycle], "left")


def crossover_rows(along: DataFrame, crossing: DataFrame, fields: list[str], point: str = "ref_pt", cycle: str = "cycle_number") -> DataFrame:
    """Long rows with ``side`` 0 (the track itself) and 1 (the crossing one), only of points that have crossings."""
    keep = along.join(crossing.select(point).distinct(), point, "left_semi")
    a = keep.select(point, cycle, F.lit(0).alias("side"), *fields)
    return a.unionByName(crossing.select(point, cycle, F.lit(1).alias("side"), *fields))


def crossover_cube(along: DataFrame, crossing: DataFrame, fields: list[str], point: str = "ref_pt", cycle: str = "cycle_number") -> DataFrame:
    return cube(crossover_rows(along, crossing, fields, point, cycle), [point, cycle], "side", fields)
