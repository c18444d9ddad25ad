"""Laser altimetry records (GLAS): corrections, filters, campaign numbers and biases, change of ellipsoid."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.functions.semantics import nan_to_null

# fixed values: campaigns in the order of their numbers, from 1
CAMPAIGNS = ("1A", "2A", "2B", "2C", "3A", "3B", "3C", "3D", "3E", "3F", "3G", "3H", "3I", "3J", "3K", "2D", "2E", "2F")
# fixed values: fields by group
FIELDS = {
    "Elevation_Corrections": ["d_GmC", "d_satElevCorr"],
    "Elevation_Surfaces": ["d_elev", "d_IceSVar"],
    "Geolocation": ["d_lat", "d_lon"],
    "Geophysical": ["d_DEM_elv", "d_deltaEllip", "d_ocElv"],
    "Quality": ["elev_use_flg", "sigma_att_flg"],
    "Reflectivity": ["d_reflctUC"],
    "Time": ["d_UTCTime_40"],
    "Waveform": ["i_numPk"],
}
# fixed values: semi-major axis and flattening
TOPEX, WGS84 = (6378136.3, 1 / 298.257), (6378137.0, 1 / 298.257223563)


def tidy_names(df: DataFrame) -> DataFrame:
    """Field names without the ``d_`` prefix; lat and lon written out; ``time`` from the UTC field."""
    name = lambda c: {"d_lat": "latitude", "d_lon": "longitude"}.get(c, c[2:] if c.startswith("d_") else c)
    out = df.select(*[F.col(c).alias(name(c)) for c in df.columns])
    return out.withColumn("time", F.col("UTCTime_40")) if "UTCTime_40" in out.columns else out


def latitude_range(df: DataFrame, lo: float, hi: float) -> DataFrame:
    return df.where((F.col("latitude") > lo) & (F.col("latitude") < hi))


def apply_corrections(df: DataFrame) -> DataFrame:
    """``z`` = elevation on WGS84 without ocean tide and with the saturation correction; missing terms count 0."""
    term = lambda c: F.coalesce(nan_to_null(F.col(c)), F.lit(0.0))
    return df.withColumn("z", F.col("elev") - F.col("deltaEllip") - term("ocElv") + term("satElevCorr"))


def apply_filters(df: DataFrame) -> DataFrame:
    """Quality conditions; a missing value fails its condition."""
    v = lambda c: nan_to_null(F.col(c))
    return df.where((v("IceSVar") < 0.035) & (v("reflctUC") > 0.05) & (v("satElevCorr") < 1) & (F.col("i_numPk") == 1))


def campaign_number(name: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(c) for c in CAMPAIGNS]), name)
    return F.when(at > 0, at)


def campaign_bias(number: Column) -> Column:
    """Metres to add: laser 2 lower, laser 3 higher; laser 1 unchanged."""
    second = [i + 1 for i, c in enumerate(CAMPAIGNS) if c[0] == "2"]
    third = [i + 1 for i, c in enumerate(CAMPAIGNS) if c[0] == "3"]
    return F.when(number.isin(second), -0.017).when(number.isin(third), 0.011).otherwise(0.0)


def change_ellipsoid(lat: np.ndarray, h: np.ndarray, a: tuple[float, float] = TOPEX, b: tuple[float, float] = WGS84, rounds: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Geodetic latitude and height on ellipsoid ``b``: Newton steps on the reduced latitude, all points at once."""
    (a1, f1), (a2, f2) = a, b
    b2 = a2 * (1 - f2)
    e1, e2 = f1 * (2 - f1), f2 * (2 - f2)
    p = np.radians(np.clip(lat, -90, 90))
    n = a1 / np.sqrt(1 - e1 * np.sin(p) ** 2)
    r, z = (n + h) * np.cos(p), (n * (1 - e1) + h) * np.sin(p)
    u = np.arctan2(z * a2, r * b2)
    for _ in range(rounds):
        # distance along the tangent is zero at the foot point
        f = (a2 * a2 - b2 * b2) * np.sin(u) * np.cos(u) - a2 * r * np.sin(u) + b2 * z * np.cos(u)
        g = (a2 * a2 - b2 * b2) * np.cos(2 * u) - a2 * r * np.cos(u) - b2 * z * np.sin(u)
        step = f / g
        u = u - step
        if np.nanmax(np.abs(step), initial=0.0) < 1e-14:
            break
    phi = np.arctan2(np.sin(u) * a2, np.cos(u) * b2)
    m = a2 / np.sqrt(1 - e2 * np.sin(phi) ** 2)
    height = r * np.cos(phi) + z * np.sin(phi) - a2 * a2 / m
    return np.degrees(phi), height


def convert_ellipsoid(df: DataFrame, lat: str = "latitude", h: str = "elev") -> DataFrame:
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        p, z = change_ellipsoid(x.to_numpy(float), y.to_numpy(float))
        return pd.DataFrame({"p": p, "z": z})

    both = F.pandas_udf(run, "p double, z double")(F.col(lat), F.col(h))
    return df.withColumn("_e", both).withColumns({lat: F.col("_e.p"), h: F.col("_e.z")}).drop("_e")
