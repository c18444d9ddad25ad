"""Which projection a table is in, and its attributes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.functions.geodesy import POLAR, WGS84_A, WGS84_F, mercator_forward, mercator_inverse, polar_forward, polar_inverse, utm_forward, utm_inverse


def choose(explicit: str | int | None = None, proj4: str | None = None, epsg: int | None = None, own_proj4: str | None = None, own_epsg: int | None = None) -> str | int | None:
    """The first that is given: an explicit argument, a proj4 string, an EPSG code, then what the data carry."""
    return next((c for c in (explicit, proj4, epsg, own_proj4, own_epsg) if c is not None), None)


def epsg_of(crs: str | int) -> int:
    """EPSG code of the two polar projections, from a code, ``EPSG:n`` or a proj4 string."""
    if isinstance(crs, int):
        code = crs
    elif m := re.fullmatch(r"(?:EPSG:)?(\d+)", crs.strip(), re.I):
        code = int(m[1])
    else:
        p = dict(re.findall(r"\+(\w+)=(\S+)", crs))
        have = (float(p.get("lat_0", 0)), float(p.get("lat_ts", 0)), float(p.get("lon_0", 0)))
        code = next((c for c, (s, ts, lon) in POLAR.items() if p.get("proj") == "stere" and have == (90.0 * s, ts * s, lon)), 0)
    if code not in POLAR:
        raise ValueError(f"projection {crs!r} is neither EPSG:3413 nor EPSG:3031")
    return code


def proj4_of(epsg: int) -> str:
    sign, ts, lon = POLAR[epsg]
    return f"+proj=stere +lat_0={90 * sign} +lat_ts={ts * sign:g} +lon_0={lon:g} +k=1 +x_0=0 +y_0=0 +datum=WGS84 +units=m +no_defs"


def attributes(crs: str | int) -> dict[str, str | float]:
    """Grid-mapping attributes by the CF conventions."""
    code = epsg_of(crs)
    sign, ts, lon = POLAR[code]
    return {
        "grid_mapping_name": "polar_stereographic", "latitude_of_projection_origin": 90.0 * sign, "standard_parallel": ts * sign, "straight_vertical_longitude_from_pole": lon,
        "false_easting": 0.0, "false_northing": 0.0, "semi_major_axis": WGS84_A, "inverse_flattening": 1 / WGS84_F, "spatial_epsg": code, "spatial_proj4": proj4_of(code),
    }


def _code(crs: str | int) -> int:
    if isinstance(crs, str) and "+proj=utm" in crs:
        p = dict(re.findall(r"\+(\w+)(?:=(\S+))?", crs))
        return (32700 if "south" in p else 32600) + int(p["zone"])
    m = crs if isinstance(crs, int) else re.fullmatch(r"(?:EPSG:)?(\d+)", crs.strip(), re.I)
    code = m if isinstance(m, int) else int(m[1]) if m else epsg_of(crs)
    if code not in POLAR and code not in (3857, 4326) and not (32601 <= code <= 32660 or 32701 <= code <= 32760):
        raise ValueError(f"projection {crs!r}: known are EPSG:3413, 3031, 3857, 4326 and the UTM zones 326xx, 327xx")
    return code


def forward(lat: Column, lon: Column, crs: str | int) -> tuple[Column, Column]:
    """(x, y) of a place in a polar stereographic, UTM, web map or plain latitude/longitude system."""
    code = _code(crs)
    if code in POLAR:
        return polar_forward(lat, lon, code)
    if code == 3857:
        return mercator_forward(lat, lon)
    return (lon, lat) if code == 4326 else utm_forward(lat, lon, code % 100, code < 32700)


def inverse(x: Column, y: Column, crs: str | int) -> tuple[Column, Column]:
    """(latitude, longitude) of a place in such a system."""
    code = _code(crs)
    if code in POLAR:
        return polar_inverse(x, y, code)
    if code == 3857:
        return mercator_inverse(x, y)
    return (y, x) if code == 4326 else utm_inverse(x, y, code % 100, code < 32700)


def add_xy(df: DataFrame, crs: str | int, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    x, y = forward(F.col(lat).cast("double"), F.col(lon).cast("double"), crs)
    return df.withColumns({"x": x, "y": y})


def add_latlon(df: DataFrame, crs: str | int, x: str = "x", y: str = "y") -> DataFrame:
    lat, lon = inverse(F.col(x), F.col(y), crs)
    return df.withColumns({"latitude": lat, "longitude": lon})
