"""GeoTIFF reading and Cloud Optimized GeoTIFF writing in numpy: classic little- or big-endian files,
strips or tiles, chunky samples, no compression or deflate."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 16: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIEPOINT, NODATA = 33550, 33922, 42113
#: The directory of geographic keys and its numbers and texts; keys within it (fixed values of the GeoTIFF format).
GEO_KEYS, GEO_DOUBLES, GEO_TEXTS = 34735, 34736, 34737
MODEL_TYPE, RASTER_TYPE, GEOGRAPHIC_CODE, PROJECTED_CODE = 1024, 1025, 2048, 3072
#: Tags of the source that describe its own layout and are not carried over.
LAYOUT_TAGS = frozenset({WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, FORMAT})
DTYPES = {("u", 1): "uint8", ("u", 2): "uint16", ("i", 2): "int16", ("i", 4): "int32", ("f", 4): "float32", ("f", 8): "float64"}


class TiffError(ValueError):
    """The bytes are no TIFF that this module reads."""


@dataclass
class Layout:
    width: int
    height: int
    samples: int
    dtype: np.dtype
    tags: dict[int, tuple[int, tuple]]


def read_tags(data: bytes) -> tuple[str, dict[int, tuple[int, tuple]]]:
    """Byte order and the first directory: tag -> (type, values)."""
    if len(data) < 8 or data[:2] not in (b"II", b"MM"):
        raise TiffError("no TIFF header")
    order = "<" if data[:2] == b"II" else ">"
    magic, at = struct.unpack(order + "HI", data[2:8])
    if magic != 42:
        raise TiffError(f"magic {magic} is not that of a classic TIFF")
    try:
        (count,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for i in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            form = TYPES.get(kind)
            if form is None:
                continue
            length = struct.calcsize(order + form) * n
            place = at + 10 + 12 * i if length <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
            if kind == 2:
                values: tuple = (data[place : place + n],)
            else:
                values = struct.unpack_from(f"{order}{n * len(form)}{form[0]}", data, place)
            tags[tag] = (kind, values)
    except struct.error as e:
        raise TiffError(f"truncated directory: {e}") from None
    return order, tags


def read_layout(data: bytes) -> Layout:
    order, tags = read_tags(data)
    one = lambda tag, default=None: tags[tag][1][0] if tag in tags else default
    if WIDTH not in tags or HEIGHT not in tags:
        raise TiffError("no dimensions")
    bits, form = one(BITS, 1), {1: "u", 2: "i", 3: "f"}.get(one(FORMAT, 1))
    if len(set(tags.get(BITS, (3, (bits,)))[1])) > 1 or (form, bits // 8) not in DTYPES and (form, bits // 8) != ("i", 1):
        raise TiffError(f"unsupported samples of {bits} bits")
    return Layout(one(WIDTH), one(HEIGHT), one(SAMPLES, 1), np.dtype(f"{order}{form}{bits // 8}"), tags)


def geo_keys(code: int, geographic: bool) -> dict[int, tuple[int, tuple]]:
    """The tag that names an EPSG system."""
    keys = ((MODEL_TYPE, 0, 1, 2 if geographic else 1), (RASTER_TYPE, 0, 1, 1), (GEOGRAPHIC_CODE if geographic else PROJECTED_CODE, 0, 1, code))
    return {GEO_KEYS: (3, (1, 1, 0, len(keys), *(x for key in keys for x in key)))}


def epsg_of(tags: dict[int, tuple[int, tuple]]) -> int | None:
    """The EPSG code that the geographic keys name: the projected system's, else the geographic one's."""
    flat = tags.get(GEO_KEYS, (3, ()))[1]
    named = {flat[i]: flat[i + 3] for i in range(4, len(flat) - 3, 4) if flat[i + 1] == 0}
    return named.get(PROJECTED_CODE) or named.get(GEOGRAPHIC_CODE)


def carried(tags: dict[int, tuple[int, tuple]]) -> dict[int, tuple[int, tuple]]:
    """A source's tags that say nothing of its own layout or place."""
    return {k: v for k, v in tags.items() if k not in LAYOUT_TAGS and k not in (PIXEL_SCALE, TIEPOINT, NODATA)}


def decode(data: bytes) -> tuple[np.ndarray, Layout]:
    """Pixels (height x width x samples, native order) and the layout."""
    at = read_layout(data)
    tags = at.tags
    one = lambda tag, default=None: tags[tag][1][0] if tag in tags else default
    if one(PLANAR, 1) != 1 and at.samples > 1:
        raise TiffError("planar layout is not read")
    if one(PREDICTOR, 1) != 1:
        raise TiffError("predictors are not read")
    method = one(COMPRESSION, 1)
    if method not in (1, 8, 32946):
        raise TiffError(f"compression {method} is not read")
    tiled = TILE_OFFSETS in tags
    w, h = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (at.width, min(one(ROWS_PER_STRIP, at.height), at.height))
    offsets, sizes = tags.get(TILE_OFFSETS if tiled else STRIP_OFFSETS, (0, ()))[1], tags.get(TILE_BYTES if tiled else STRIP_BYTES, (0, ()))[1]
    across, down = -(-at.width // w), -(-at.height // h)
    if len(offsets) < across * down or len(sizes) < across * down:
        raise TiffError("chunks are missing")
    out = np.zeros((at.height, at.width, at.samples), dtype=at.dtype.newbyteorder("="))
    for k in range(across * down):
        y, x = k // across * h, k % across * w
        rows = h if tiled else min(h, at.height - y)
        chunk = data[offsets[k] : offsets[k] + sizes[k]]
        if method != 1:
            try:
                chunk = zlib.decompress(chunk)
            except zlib.error as e:
                raise TiffError(f"broken chunk: {e}") from None
        need = rows * w * at.samples * at.dtype.itemsize
        if len(chunk) < need:
            raise TiffError("truncated chunk")
        block = np.frombuffer(chunk[:need], dtype=at.dtype).reshape(rows, w, at.samples)
        out[y : y + h, x : x + w] = block[: at.height - y, : at.width - x]
    return out, at


def encode(pixels: np.ndarray, block: int | None = None, compression: str = "deflate", scale: tuple[float, float] | None = None, origin: tuple[float, float] | None = None, nodata: str | None = None, extra: dict[int, tuple[int, tuple]] | None = None) -> bytes:
    """A file with its directory at byte 8, then the long values, then the blocks, row by row.

    block: edge of the internal tiles (strips of whole rows otherwise). extra: tags to carry over.
    """
    if pixels.ndim == 2:
        pixels = pixels[:, :, None]
    height, width, samples = pixels.shape
    if block and (height % block or width % block):
        raise TiffError("dimensions are no multiples of the block")
    pixels = np.ascontiguousarray(pixels, dtype=pixels.dtype.newbyteorder("<"))
    pack = zlib.compress if compression == "deflate" else bytes
    if block:
        chunks = [pack(pixels[y : y + block, x : x + block].tobytes()) for y in range(0, height, block) for x in range(0, width, block)]
    else:
        chunks = [pack(pixels.tobytes())]
    form = {"u": 1, "i": 2, "f": 3}[pixels.dtype.kind]
    tags: dict[int, tuple[int, tuple]] = {k: v for k, v in (extra or {}).items() if k not in LAYOUT_TAGS}
    tags |= {WIDTH: (4, (width,)), HEIGHT: (4, (height,)), BITS: (3, (pixels.dtype.itemsize * 8,) * samples), COMPRESSION: (3, (8 if compression == "deflate" else 1,)), PHOTOMETRIC: (3, (1,)), SAMPLES: (3, (samples,)), PLANAR: (3, (1,)), FORMAT: (3, (form,) * samples)}
    if block:
        tags |= {TILE_WIDTH: (4, (block,)), TILE_HEIGHT: (4, (block,)), TILE_OFFSETS: (4, (0,) * len(chunks)), TILE_BYTES: (4, tuple(map(len, chunks)))}
    else:
        tags |= {ROWS_PER_STRIP: (4, (height,)), STRIP_OFFSETS: (4, (0,)), STRIP_BYTES: (4, (len(chunks[0]),))}
    if scale:
        tags[PIXEL_SCALE] = (12, (abs(scale[0]), abs(scale[1]), 0.0))
    if origin:
        tags[TIEPOINT] = (12, (0.0, 0.0, 0.0, origin[0], origin[1], 0.0))
    if nodata is not None:
        tags[NODATA] = (2, (nodata.encode() + b"\0",))

    def body(kind: int, values: tuple) -> tuple[int, bytes]:
        if kind == 2:
            return len(values[0]), values[0]
        form = TYPES[kind]
        return len(values) // len(form), struct.pack(f"<{len(values)}{form[0]}", *values)

    long_at = 8 + 2 + 12 * len(tags) + 4
    sizes = sum(len(b) + len(b) % 2 for _, b in (body(*v) for v in tags.values()) if len(b) > 4)
    data_at, offsets = long_at + sizes, []
    for c in chunks:
        offsets.append(data_at)
        data_at += len(c)
    tags[TILE_OFFSETS if block else STRIP_OFFSETS] = (4, tuple(offsets))
    directory, longer = [struct.pack("<H", len(tags))], []
    for tag in sorted(tags):
        n, raw = body(*tags[tag])
        if len(raw) <= 4:
            directory.append(struct.pack("<HHI", tag, tags[tag][0], n) + raw.ljust(4, b"\0"))
        else:
            directory.append(struct.pack("<HHII", tag, tags[tag][0], n, long_at))
            raw += b"\0" * (len(raw) % 2)
            long_at += len(raw)
            longer.append(raw)
    return b"".join([b"II*\0", struct.pack("<I", 8), *directory, struct.pack("<I", 0), *longer, *chunks])
