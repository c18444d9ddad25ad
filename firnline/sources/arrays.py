"""HDF5 and netCDF files as rows, where their libraries are installed.

The bytes of a file are opened in the task that reads it; without ``h5py`` or
``netCDF4`` the readers raise a clear error before a job starts.
"""

from __future__ import annotations

import bz2
import gzip
import importlib
import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.sources.packed import read_binary


def need(module: str):
    try:
        return importlib.import_module(module)
    except ImportError as missing:
        raise RuntimeError(f"reading this format needs the Python package {module}, which is not installed; convert the files to Parquet instead") from missing


def unpacked(content: bytes) -> bytes:
    """gzip and bzip2 wrappers taken off."""
    if content[:2] == b"\x1f\x8b":
        return gzip.decompress(content)
    return bz2.decompress(content) if content[:3] == b"BZh" else content


def decode(v: np.ndarray, fill=None, scale: float | None = None, offset: float | None = None) -> np.ndarray:
    """Fill to NaN for floating types, then scale, then offset."""
    out = np.array(v)
    if fill is not None and out.dtype.kind == "f":
        out = np.where(out == fill, np.nan, out)
    if scale is not None:
        out = out * scale
    return out + offset if offset is not None else out


def decoded(c: Column, fill: float | None = None, scale: float | None = None, offset: float | None = None) -> Column:
    """The same for a column of a table."""
    v = c.cast("double")
    v = F.when(v != fill, v) if fill is not None else v
    v = v * scale if scale is not None else v
    return v + offset if offset is not None else v


def read_hdf5(spark: SparkSession, path: str, fields: dict[str, list[str]], rows: tuple[int, int] | None = None) -> DataFrame:
    """Columns of ``{group: [names]}`` (missing ones null); ``rows`` is a closed range of row numbers."""
    need("h5py")
    names = [n for g in fields.values() for n in g]

    def run(_: str, content: bytes) -> pd.DataFrame:
        h5 = need("h5py").File(io.BytesIO(unpacked(content)), "r")
        part = slice(rows[0], rows[1] + 1) if rows else slice(None)
        out = {}
        for group, members in fields.items():
            for n in members:
                key = f"{group}/{n}".strip("/")
                if key in h5:
                    d = h5[key]
                    one = lambda a: d.attrs[a].item() if hasattr(d.attrs.get(a), "item") else d.attrs.get(a)  # noqa: E731, B023
                    out[n] = decode(d[part], one("_FillValue"), one("scale_factor"), one("add_offset")).astype(float)
        size = max((len(v) for v in out.values()), default=0)
        return pd.DataFrame({n: out.get(n, np.full(size, np.nan)) for n in names})

    return read_binary(spark, path, run, ", ".join(f"`{n}` double" for n in names))


def read_netcdf(spark: SparkSession, path: str, field: str, *, x: str = "x", y: str = "y", time: str | None = None, bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Cells ``band, row, col, x, y, t, <field>`` of rasters, y turned to ascending; invalid cells are absent."""
    need("netCDF4")

    def run(_: str, content: bytes) -> pd.DataFrame:
        ds = need("netCDF4").Dataset("memory", memory=unpacked(content))
        v = ds[field]
        axes = [d for d in (time, y, x) if d in v.dimensions]
        z = np.ma.filled(np.ma.asarray(v[:], float), np.nan).transpose([v.dimensions.index(a) for a in axes])
        z = z if z.ndim == 3 else z[None]
        xs, ys = np.array(ds[x][:], float), np.array(ds[y][:], float)
        ts = np.array(ds[time][:], float) if time in v.dimensions else np.full(len(z), np.nan)
        if len(ys) > 1 and ys[0] > ys[-1]:
            z, ys = z[:, ::-1], ys[::-1]
        b, r, c = np.nonzero(np.isfinite(z))
        d = pd.DataFrame({"band": b, "row": r, "col": c, "x": xs[c], "y": ys[r], "t": ts[b], field: z[b, r, c]})
        return d[(d.x >= bounds[0]) & (d.x <= bounds[1]) & (d.y >= bounds[2]) & (d.y <= bounds[3])] if bounds else d

    return read_binary(spark, path, run, f"`band` bigint, `row` bigint, `col` bigint, `x` double, `y` double, `t` double, `{field}` double")


def write_netcdf(z: np.ndarray, x: np.ndarray, y: np.ndarray, path: str, field: str = "z", t: np.ndarray | None = None, attributes: dict | None = None) -> None:
    """One raster ``(bands, rows, columns)`` with its axes and the attributes of its grid mapping."""
    ds = need("netCDF4").Dataset(path, "w")
    axes = {"y": y, "x": x} if t is None else {"time": t, "y": y, "x": x}
    for n, v in axes.items():
        ds.createDimension(n, len(v))
        ds.createVariable(n, "f8", (n,))[:] = v
    v = ds.createVariable(field, "f8", tuple(axes), zlib=True, fill_value=np.nan)
    v[:] = z if t is not None else np.asarray(z).reshape(len(y), len(x))
    if attributes:
        m = ds.createVariable(attributes["grid_mapping_name"], "S1", ())
        m.setncatts(attributes)
        v.grid_mapping = attributes["grid_mapping_name"]
    ds.close()


def write_hdf5(columns: dict[str, np.ndarray], path: str, group: str = "/", attributes: dict | None = None) -> None:
    """One data set per column, gzip-packed and extensible."""
    with need("h5py").File(path, "a") as f:
        g = f.require_group(group)
        for n, v in columns.items():
            if n in g:
                del g[n]
            g.create_dataset(n, data=v, compression="gzip", chunks=True, maxshape=(None, *np.shape(v)[1:]))
        for k, v in (attributes or {}).items():
            g.attrs[k] = v
