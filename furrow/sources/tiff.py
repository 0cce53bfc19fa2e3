"""Reading and writing the plain kinds of GeoTIFF: strips or tiles, raw or deflate, any number type."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

#: Bytes by field type, and tags.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8}
CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, BANDS, STRIP_ROWS, STRIP_SIZES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, FORMAT, SCALE, TIEPOINT, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 42113


@dataclass
class Raster:
    """values: (bands, rows, columns) doubles, NaN for no data; xmin and ymax of the corner, cell size."""

    values: np.ndarray
    xmin: float = 0.0
    ymax: float = 0.0
    res: float = 1.0


def _tags(raw: bytes) -> tuple[str, dict[int, tuple]]:
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack_from(f"{order}H", raw, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(f"{order}I", raw, 4)
    (n,) = struct.unpack_from(f"{order}H", raw, at)
    out = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HHI", raw, at + 2 + 12 * k)
        size = SIZES.get(kind, 1) * count
        start = at + 10 + 12 * k if size <= 4 else struct.unpack_from(f"{order}I", raw, at + 10 + 12 * k)[0]
        if kind == 2:
            out[tag] = (raw[start : start + count].split(b"\0")[0].decode("latin-1"),)
        elif kind in CODES:
            out[tag] = struct.unpack_from(f"{order}{count}{CODES[kind]}", raw, start)
    return order, out


def read_tiff(raw: bytes) -> Raster:
    order, t = _tags(raw)
    width, height, bands = t[WIDTH][0], t[HEIGHT][0], t.get(BANDS, (1,))[0]
    bits, kind, packing = t.get(BITS, (1,))[0], t.get(FORMAT, (1,))[0], t.get(COMPRESSION, (1,))[0]
    if packing not in (1, 8, 32946) or t.get(PREDICTOR, (1,))[0] != 1 or bits % 8:
        raise ValueError(f"this kind of TIFF isn't read: compression {packing}, {bits} bits")
    dtype = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[kind] }{bits // 8}")
    tiled, planar = TILES in t, t.get(PLANAR, (1,))[0] == 2
    bw, bh = (t[TILE_WIDTH][0], t[TILE_HEIGHT][0]) if tiled else (width, min(t.get(STRIP_ROWS, (height,))[0], height))
    places, sizes = (t[TILES], t[TILE_SIZES]) if tiled else (t[STRIPS], t[STRIP_SIZES])
    across, down, own = -(-width // bw), -(-height // bh), 1 if planar else bands
    out = np.full((bands, height, width), np.nan)
    for k, (at, size) in enumerate(zip(places, sizes, strict=True)):
        plane, cell = divmod(k, across * down)
        y, x = cell // across * bh, cell % across * bw
        block = raw[at : at + size]
        data = np.frombuffer(block if packing == 1 else zlib.decompress(block), dtype)
        rows = len(data) // (bw * own)
        part = data[: rows * bw * own].reshape(rows, bw, own).transpose(2, 0, 1)[:, : height - y, : width - x]
        out[plane if planar else slice(None), y : y + part.shape[1], x : x + part.shape[2]] = part[0] if planar else part
    if NODATA in t:
        out[out == float(t[NODATA][0].strip())] = np.nan
    scale, tie = t.get(SCALE, (1.0, 1.0, 0.0)), t.get(TIEPOINT, (0.0,) * 6)
    return Raster(out, tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0])


def write_tiff(r: Raster) -> bytes:
    """A deflate-compressed band-by-band float64 file."""
    bands, height, width = r.values.shape
    blocks = [zlib.compress(np.ascontiguousarray(b, "<f8").tobytes()) for b in r.values]
    tags = {
        WIDTH: ("I", [width]), HEIGHT: ("I", [height]), BITS: ("H", [64] * bands), COMPRESSION: ("H", [8]), PHOTOMETRIC: ("H", [1]),
        STRIPS: ("I", [0] * bands), BANDS: ("H", [bands]), STRIP_ROWS: ("I", [height]), STRIP_SIZES: ("I", [len(b) for b in blocks]),
        PLANAR: ("H", [2]), FORMAT: ("H", [3] * bands), SCALE: ("d", [r.res, r.res, 0.0]), TIEPOINT: ("d", [0.0, 0.0, 0.0, r.xmin, r.ymax, 0.0]),
    }
    kinds = {v: k for k, v in CODES.items()}
    rest = 8 + 2 + 12 * len(tags) + 4
    extra = sum(SIZES[kinds[c]] * len(v) for c, v in tags.values() if SIZES[kinds[c]] * len(v) > 4)
    at = rest + extra
    for k, b in enumerate(blocks):
        tags[STRIPS][1][k] = at
        at += len(b)
    head, more = b"", b""
    for tag in sorted(tags):
        code, v = tags[tag]
        body = struct.pack(f"<{len(v)}{code}", *v)
        if len(body) > 4:
            body, more = struct.pack("<I", rest + len(more)), more + body
        head += struct.pack("<HHI", tag, kinds[code], len(v)) + body.ljust(4, b"\0")
    return b"II*\0" + struct.pack("<IH", 8, len(tags)) + head + b"\0\0\0\0" + more + b"".join(blocks)
