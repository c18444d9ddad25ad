"""GeoTIFF rasters without native libraries: striped or tiled, uncompressed or deflate, one or more bands.

Reading runs in the tasks (one file per row of ``binaryFile``); writing packs
one tile, which is what a task or the driver holds.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from firnline.sources.packed import decode_binary

# fixed values: TIFF field types (bytes, format) and tags
_TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
_KINDS = {1: "u", 2: "i", 3: "f"}


def read_tags(b: bytes) -> tuple[str, dict[int, tuple]]:
    o = "<" if b[:2] == b"II" else ">"
    if b[:2] not in (b"II", b"MM") or struct.unpack(o + "H", b[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack(o + "I", b[4:8])[0]
    tags = {}
    for i in range(struct.unpack(o + "H", b[at : at + 2])[0]):
        tag, kind, n, raw = struct.unpack(o + "HHI4s", b[at + 2 + 12 * i : at + 14 + 12 * i])
        size, f = _TYPES.get(kind, (1, "B"))
        pos = struct.unpack(o + "I", raw)[0]
        data = raw if size * n <= 4 else b[pos : pos + size * n]
        tags[tag] = (data[:n].rstrip(b"\0").decode("latin-1"),) if f == "s" else struct.unpack(o + f * n, data[: size * n])
    return o, tags


def read_array(b: bytes) -> tuple[np.ndarray, dict]:
    """(bands, rows from the south, columns) and the geometry ``x0, dx, y0, dy, nodata``."""
    o, t = read_tags(b)
    nx, ny, bands = t[256][0], t[257][0], t.get(277, (1,))[0]
    kind = np.dtype(f"{o}{_KINDS[t.get(339, (1,))[0]]}{t[258][0] // 8}")
    if t.get(284, (1,))[0] != 1 and bands > 1:
        raise ValueError("only interleaved bands are read")
    pack = t.get(259, (1,))[0]
    if pack not in (1, 8, 32946):
        raise ValueError(f"compression {pack} is not read")
    tiled = 322 in t
    w, h = (t[322][0], t[323][0]) if tiled else (nx, t.get(278, (ny,))[0])
    out = np.zeros((ny, nx, bands), kind.newbyteorder("="))
    across = -(-nx // w)
    for i, (p, n) in enumerate(zip(t[324] if tiled else t[273], t[325] if tiled else t[279])):
        raw = b[p : p + n] if pack == 1 else zlib.decompress(b[p : p + n])
        r, c = i // across * h, i % across * w
        rows = h if tiled else min(h, ny - r)
        block = np.frombuffer(raw, kind, rows * w * bands).reshape(rows, w, bands)
        if t.get(317, (1,))[0] == 2:
            block = np.cumsum(block, axis=1, dtype=block.dtype.newbyteorder("="))
        out[r : r + rows, c : c + w] = block[: ny - r, : nx - c]
    sx, sy = t[33550][:2] if 33550 in t else (1.0, 1.0)
    i0, j0, _, x, y, _ = t[33922][:6] if 33922 in t else (0, 0, 0, 0.0, 0.0, 0)
    nodata = float(t[42113][0]) if 42113 in t and t[42113][0].strip() else None
    # cell centres, rows turned so that y grows
    meta = {"x0": x + (0.5 - i0) * sx, "dx": sx, "y0": y - (ny - 0.5 - j0) * sy, "dy": sy, "nx": nx, "ny": ny, "nodata": nodata}
    return np.moveaxis(out[::-1], 2, 0), meta


def read_geotiff(spark: SparkSession, path: str, *, bounds: tuple[float, float, float, float] | None = None, bands: list[int] | None = None, skip: int = 1, min_res: float | None = None, field: str = "z") -> DataFrame:
    """Cells of every raster below ``path``; see ``decode_geotiff``."""
    return decode_geotiff(spark.read.format("binaryFile").load(path), bounds=bounds, bands=bands, skip=skip, min_res=min_res, field=field)


def decode_geotiff(files: DataFrame, *, bounds: tuple[float, float, float, float] | None = None, bands: list[int] | None = None, skip: int = 1, min_res: float | None = None, field: str = "z") -> DataFrame:
    """Cells ``band, row, col, x, y, <field>`` of rasters given as ``path, content``; nodata and NaN cells are absent.

    ``bounds`` (x0, x1, y0, y1, closed), ``bands`` and every ``skip``-th cell
    (or the step that reaches ``min_res``) are applied before rows are made.
    """

    def decode(_: str, content: bytes) -> pd.DataFrame:
        z, m = read_array(content)
        k = max(1, int(np.ceil(min_res / m["dx"]))) if min_res else skip
        r, c = np.arange(0, m["ny"], k), np.arange(0, m["nx"], k)
        x, y = m["x0"] + c * m["dx"], m["y0"] + r * m["dy"]
        if bounds:
            i, j = (x >= bounds[0]) & (x <= bounds[1]), (y >= bounds[2]) & (y <= bounds[3])
            c, x, r, y = c[i], x[i], r[j], y[j]
        use = [b for b in range(len(z)) if bands is None or b in bands]
        v = z[use][:, r][:, :, c].astype(float)
        bad = ~np.isfinite(v) | ((v == m["nodata"]) if m["nodata"] is not None else False)
        b, i, j = np.nonzero(~bad)
        return pd.DataFrame({"band": np.array(use, np.int64)[b], "row": r[i].astype(np.int64), "col": c[j].astype(np.int64), "x": x[j], "y": y[i], field: v[b, i, j]})

    return decode_binary(files, decode, f"`band` bigint, `row` bigint, `col` bigint, `x` double, `y` double, `{field}` double")


def write_array(z: np.ndarray, x0: float, dx: float, y0: float, dy: float, *, epsg: int | None = None, nodata: float | None = None) -> bytes:
    """A deflate-packed GeoTIFF of float64 ``(bands, rows from the south, columns)``."""
    z = np.asarray(z, "<f8")
    z = z[None] if z.ndim == 2 else z
    bands, ny, nx = z.shape
    data = zlib.compress(np.ascontiguousarray(np.moveaxis(z, 0, 2)[::-1]).tobytes())
    tags: list[tuple[int, int, int, bytes]] = []

    def put(tag: int, kind: int, *v) -> None:
        tags.append((tag, kind, len(v), struct.pack("<" + _TYPES[kind][1] * len(v), *v)))

    put(256, 4, nx), put(257, 4, ny), put(258, 3, *[64] * bands), put(259, 3, 8), put(262, 3, 1), put(273, 4, 0), put(277, 3, bands), put(278, 4, ny), put(279, 4, len(data)), put(339, 3, *[3] * bands)
    put(33550, 12, dx, dy, 0.0), put(33922, 12, 0.0, 0.0, 0.0, x0 - dx / 2, y0 + (ny - 0.5) * dy, 0.0)
    if epsg:
        put(34735, 3, 1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, epsg)
    if nodata is not None:
        s = f"{nodata!r}\0".encode()
        tags.append((42113, 2, len(s), s))
    head = 8 + 2 + 12 * len(tags) + 4
    extra, rows, pos = b"", b"", head
    large = sum(len(v) for *_, v in tags if len(v) > 4)
    for tag, kind, n, v in tags:
        if tag == 273:
            v = struct.pack("<I", head + large)
        if len(v) > 4:
            rows += struct.pack("<HHII", tag, kind, n, pos)
            extra, pos = extra + v, pos + len(v)
        else:
            rows += struct.pack("<HHI", tag, kind, n) + v.ljust(4, b"\0")
    return b"II*\0" + struct.pack("<IH", 8, len(tags)) + rows + struct.pack("<I", 0) + extra + data
