"""Pixels over HTTP: the request for a tile, a source that posts it, and NPY payloads."""

from __future__ import annotations

import io
import json
import urllib.error
import urllib.request
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.functions import tiles as fn
from tilewright.operators.tiling import Grid
from tilewright.sources import tiff
from tilewright.sources.pixels import SourceError

#: Field names of a request, as the service's wire format has them (fixed values).
FORMATS = ("GEO_TIFF", "NPY")
AFFINE = (("scaleX", "scale_x"), ("shearX", "shear_x"), ("translateX", "translate_x"), ("shearY", "shear_y"), ("scaleY", "scale_y"), ("translateY", "translate_y"))
#: Longest part of an answer's body that an error message keeps.
BODY = 500


def request_body(expression: str, grid: Grid, col_px: Column, row_px: Column, width_px: Column, height_px: Column, file_format: str = "GEO_TIFF") -> Column:
    """The request for each tile as JSON text: expression, format, dimensions, affine at the tile's corner, CRS."""
    own = {**grid.affine, **fn.tile_affine(grid.affine, col_px, row_px)}
    affine = F.struct(*((own[k] if isinstance(own[k], Column) else F.lit(float(own[k]))).cast("double").alias(name) for name, k in AFFINE))
    dimensions = F.struct(width_px.cast("int").alias("width"), height_px.cast("int").alias("height"))
    rest = F.to_json(F.struct(F.lit(file_format).alias("fileFormat"), F.struct(dimensions.alias("dimensions"), affine.alias("affineTransform"), F.lit(grid.crs).alias("crsCode")).alias("grid")))
    return F.concat(F.lit('{"expression":' + json.dumps(json.loads(expression), separators=(",", ":")) + ","), F.substring(rest, 2, 1 << 30))


def request(expression: str, grid: Grid, tile: dict, file_format: str = "GEO_TIFF") -> dict:
    """The same request for one tile inside a task."""
    a, x, y = grid.affine, tile["col_px"], tile["row_px"]
    at = a | {"translate_x": a["translate_x"] + x * a["scale_x"] + y * a["shear_x"], "translate_y": a["translate_y"] + x * a["shear_y"] + y * a["scale_y"]}
    return {"expression": json.loads(expression), "fileFormat": file_format, "grid": {"dimensions": {"width": tile["width_px"], "height": tile["height_px"]}, "affineTransform": {name: at[k] for name, k in AFFINE}, "crsCode": grid.crs}}


def error_message(status: int, body: str) -> str:
    """What a failed answer says: a hint first where the caller isn't let in, then the body, shortened."""
    if status == 401 or status == 403 and any(w in body.lower() for w in ("auth", "credential")):
        return f"the service refused the credentials; renew them and run again. Its answer ended: {body[-200:]}"
    return body[:BODY]


class HttpSource:
    """Posts a tile's request and gives the answer as GeoTIFF bytes; NPY answers are encoded.

    headers: a dict, or a picklable function that gives one for each request (for tokens that expire).
    """

    def __init__(self, url: str, expression: str, grid: Grid, headers: dict[str, str] | Callable[[], dict[str, str]] | None = None, file_format: str = "GEO_TIFF", timeout: float = 90.0):
        if file_format not in FORMATS:
            raise ValueError(f"file_format must be one of {', '.join(FORMATS)}")
        self.url, self.expression, self.grid, self.headers, self.file_format, self.timeout = url, expression, grid, headers, file_format, timeout

    def answer(self, tile: dict) -> bytes:
        own = self.headers() if callable(self.headers) else self.headers or {}
        body = json.dumps(request(self.expression, self.grid, tile, self.file_format)).encode()
        post = urllib.request.Request(self.url, body, {"Content-Type": "application/json", **own}, method="POST")
        try:
            with urllib.request.urlopen(post, timeout=self.timeout) as got:
                return got.read()
        except urllib.error.HTTPError as e:
            raise SourceError(e.code, error_message(e.code, e.read().decode("utf-8", "replace"))) from None
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            raise SourceError(-1, str(e)) from None

    def fetch(self, tile: dict) -> bytes:
        data = self.answer(tile)
        if self.file_format == "GEO_TIFF":
            return data
        bands = bands_first(np.load(io.BytesIO(data)), (tile["height_px"], tile["width_px"]))
        return tiff.encode(np.ascontiguousarray(np.moveaxis(bands, 0, -1)))


def bands_first(pixels: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """An array payload as bands x height x width: named fields and last axes become bands where they must be."""
    if pixels.dtype.names:
        pixels = np.stack([pixels[name] for name in pixels.dtype.names])
    elif pixels.ndim == 2:
        pixels = pixels[None]
    elif pixels.ndim == 3 and pixels.shape[1:] != shape and pixels.shape[:2] == shape:
        pixels = np.moveaxis(pixels, -1, 0)
    if pixels.ndim != 3 or pixels.shape[1:] != shape:
        raise ValueError(f"an array of shape {pixels.shape} holds no tile of {shape[0]} x {shape[1]}")
    return pixels
