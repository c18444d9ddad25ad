"""Map projection and datum formulas as column expressions (WGS84)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: WGS84 ellipsoid
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
WGS84_E = math.sqrt(WGS84_F * (2 - WGS84_F))
# fixed values: EPSG code -> (sign of hemisphere, latitude of true scale, central meridian)
POLAR = {3413: (1, 70.0, -45.0), 3031: (-1, 71.0, 0.0)}


def _t(phi: Column, e: float) -> Column:
    s = F.sin(phi) * e
    return F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(e / 2))


def _rho_scale(lat_ts: float, e: float = WGS84_E, a: float = WGS84_A) -> float:
    """Radius per unit of t that gives true scale at ``lat_ts``."""
    p = math.radians(lat_ts)
    s = e * math.sin(p)
    t = math.tan(math.pi / 4 - p / 2) / ((1 - s) / (1 + s)) ** (e / 2)
    return a * math.cos(p) / math.sqrt(1 - s * s) / t


def polar_forward(lat: Column, lon: Column, epsg: Column | int) -> tuple[Column, Column]:
    """(x, y) in metres; null for an epsg that is neither 3413 nor 3031 or a latitude outside [-90, 90].

    ``epsg`` may be a column: one expression then serves both hemispheres.
    """
    code = F.lit(epsg) if isinstance(epsg, int) else epsg
    case = lambda f: F.when(code == 3413, F.lit(f(3413))).when(code == 3031, F.lit(f(3031)))
    sign = case(lambda c: float(POLAR[c][0]))
    scale = case(lambda c: _rho_scale(POLAR[c][1]))
    lon0 = case(lambda c: POLAR[c][2])
    rho = scale * _t(F.radians(F.when(F.abs(lat) <= 90, lat) * sign), WGS84_E)
    d = F.radians(lon - lon0)
    return rho * F.sin(d), -sign * rho * F.cos(d)


def polar_inverse(x: Column, y: Column, epsg: int) -> tuple[Column, Column]:
    """(latitude, longitude) in degrees, by the series in the conformal latitude."""
    sign, lat_ts, lon0 = POLAR[epsg]
    e2 = WGS84_E**2
    t = F.sqrt(x * x + y * y) / _rho_scale(lat_ts)
    chi = F.lit(math.pi / 2) - 2 * F.atan(t)
    a = e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360
    b = 7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520
    c = 7 * e2**3 / 120 + 81 * e2**4 / 1120
    d = 4279 * e2**4 / 161280
    phi = chi + a * F.sin(2 * chi) + b * F.sin(4 * chi) + c * F.sin(6 * chi) + d * F.sin(8 * chi)
    lon = F.degrees(F.atan2(x, -sign * y)) + lon0
    lon = F.when(lon > 180, lon - 360).when(lon < -180, lon + 360).otherwise(lon)
    return F.degrees(phi) * sign, lon


def mercator_forward(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(x, y) of the web map projection (spherical, EPSG:3857); null at the poles and beyond."""
    p = F.radians(F.when(F.abs(lat) < 90, lat))
    return F.radians(lon) * WGS84_A, F.log(F.tan(F.lit(math.pi / 4) + p / 2)) * WGS84_A


def mercator_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(2 * F.atan(F.exp(y / WGS84_A)) - math.pi / 2), F.degrees(x / WGS84_A)


# fixed values: series of the transverse Mercator projection in the third flattening n: [forward], [inverse], [latitude from conformal latitude]
_N = WGS84_F / (2 - WGS84_F)
_RECT = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_TM_FORWARD = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280,
)
_TM_INVERSE = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280,
)
_TM_LATITUDE = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630,
)
UTM_SCALE, UTM_EAST, UTM_SOUTH = 0.9996, 500_000.0, 10_000_000.0


def utm_forward(lat: Column, lon: Column, zone: int, north: bool = True) -> tuple[Column, Column]:
    """(easting, northing) in a UTM zone; null beyond 84 degrees from its meridian or outside [-90, 90]."""
    d = F.radians(F.pmod(lon - (6 * zone - 183) + 180, F.lit(360.0)) - 180)
    p = F.radians(F.when((F.abs(lat) <= 90) & (F.abs(d) < math.radians(84)), lat))
    s = F.sin(p)
    t = F.sinh(F.atanh(s) - WGS84_E * F.atanh(WGS84_E * s))
    xi, eta = F.atan2(t, F.cos(d)), F.asinh(F.sin(d) / F.sqrt(t * t + F.cos(d) * F.cos(d)))
    north_ = xi + sum((a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(_TM_FORWARD, 1)), F.lit(0.0))
    east = eta + sum((a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(_TM_FORWARD, 1)), F.lit(0.0))
    k = UTM_SCALE * _RECT
    return east * k + UTM_EAST, north_ * k + (0.0 if north else UTM_SOUTH)


def utm_inverse(x: Column, y: Column, zone: int, north: bool = True) -> tuple[Column, Column]:
    k = UTM_SCALE * _RECT
    xi, eta = (y - (0.0 if north else UTM_SOUTH)) / k, (x - UTM_EAST) / k
    xi1 = xi - sum((b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(_TM_INVERSE, 1)), F.lit(0.0))
    eta1 = eta - sum((b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(_TM_INVERSE, 1)), F.lit(0.0))
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi + sum((c * F.sin(2 * j * chi) for j, c in enumerate(_TM_LATITUDE, 1)), F.lit(0.0))
    lon = F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))) + (6 * zone - 183)
    return F.degrees(phi), lon


def polar_scale(lat: Column, north: bool) -> Column:
    """Length on the ellipsoid per length on the polar stereographic map of that hemisphere.

    A parallel of radius r is drawn as a circle of radius rho, so the ratio is
    r / rho; both vanish at the pole, where their rates of change take over.
    """
    per_t = _rho_scale(POLAR[3413 if north else 3031][1])
    phi = F.abs(F.radians(lat))
    s = WGS84_E * F.sin(phi)
    parallel = WGS84_A * F.cos(phi) / F.sqrt(1 - s * s)
    at_pole = WGS84_A / math.sqrt(1 - WGS84_E**2) / (per_t / 2 * ((1 + WGS84_E) / (1 - WGS84_E)) ** (WGS84_E / 2))
    return F.when(math.pi / 2 - phi < 1e-8, F.lit(at_pole)).otherwise(parallel / (per_t * _t(phi, WGS84_E)))


def to_cartesian(lat: Column, lon: Column, h: Column) -> tuple[Column, Column, Column]:
    p, q = F.radians(lat), F.radians(lon)
    n = WGS84_A / F.sqrt(1 - WGS84_E**2 * F.sin(p) * F.sin(p))
    return (n + h) * F.cos(p) * F.cos(q), (n + h) * F.cos(p) * F.sin(q), (n * (1 - WGS84_E**2) + h) * F.sin(p)


def to_geodetic(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """(latitude, longitude, height); closed form in the reduced latitude, accurate to well below a millimetre near the surface."""
    a, e2 = WGS84_A, WGS84_E**2
    b = a * (1 - WGS84_F)
    p = F.sqrt(x * x + y * y)
    beta = F.atan2(z * a, p * b)
    sb, cb = F.sin(beta), F.cos(beta)
    phi = F.atan2(z + e2 / (1 - e2) * b * sb * sb * sb, p - e2 * a * cb * cb * cb)
    n = a / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi))
    h = p * F.cos(phi) + z * F.sin(phi) - a * a / n
    return F.degrees(phi), F.degrees(F.atan2(y, x)), h


# fixed values: frame changes (from, to) -> shifts x, y, z (m), scale (ppm), their yearly rates, reference year
HELMERT = {
    (2014, 2020): (0.0014, 0.0009, -0.0014, 0.00042, 0.0, 0.0001, -0.0002, 0.0, 2015.0),
    (2008, 2014): (-0.0016, -0.0019, -0.0024, 0.00002, 0.0, 0.0, 0.0001, -0.00003, 2015.0),
    (2005, 2014): (-0.0026, -0.001, 0.0023, -0.00092, -0.0003, 0.0, 0.0001, -0.00003, 2010.0),
    (2005, 2020): (-0.0027, -0.0001, 0.0014, -0.00065, -0.0003, 0.0001, -0.0001, -0.00003, 2000.0),
    (2008, 2020): (-0.0002, -0.001, -0.0033, 0.00029, 0.0, -0.0001, -0.0001, -0.00003, 2015.0),
}


def change_frame(lat: Column, lon: Column, h: Column, year: Column, frames: tuple[int, int] | Column = (2014, 2020), inverse: bool | Column = False) -> tuple[Column, Column, Column]:
    """Coordinates in another realisation of the terrestrial frame (no rotations).

    ``frames`` is a pair of ``HELMERT``, or a column with the nine figures of one per row.
    """
    tx, ty, tz, s, dx, dy, dz, ds, t0 = (frames[i] for i in range(9)) if isinstance(frames, Column) else map(F.lit, HELMERT[frames])
    back = inverse if isinstance(inverse, Column) else F.lit(inverse)
    dt = year - t0
    k = (s + ds * dt) * 1e-6
    out = []
    for v, t, d in zip(to_cartesian(lat, lon, h), (tx, ty, tz), (dx, dy, dz)):
        shift = t + d * dt
        out.append(F.when(back, (v - shift) / (1 + k)).otherwise(v * (1 + k) + shift))
    return to_geodetic(*out)
