"""Where a tile's pixels come from, and fetching them with classified errors and bounded retry."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tilewright.schema import FETCHED, TILE_COLUMNS
from tilewright.sources import tiff


class SourceError(Exception):
    """A tile could not be had: an HTTP status (-1: none) and a body."""

    def __init__(self, status: int, body: str = ""):
        super().__init__(f"HTTP {status}: {body[:500]}")
        self.status, self.body = status, body


class PixelSource(Protocol):
    """Anything picklable that gives a tile (its columns as a dict) as GeoTIFF bytes."""

    def fetch(self, tile: dict) -> bytes: ...


class Synthetic:
    """Pixels from a function of absolute column, row and band arrays."""

    def __init__(self, value: Callable[[np.ndarray, np.ndarray, int], np.ndarray], dtype: str = "float32", bands: int = 1):
        self.value, self.dtype, self.bands = value, dtype, bands

    def fetch(self, tile: dict) -> bytes:
        y, x = np.mgrid[tile["row_px"] : tile["row_px"] + tile["height_px"], tile["col_px"] : tile["col_px"] + tile["width_px"]]
        return tiff.encode(np.stack([self.value(x, y, b) for b in range(self.bands)], axis=2).astype(self.dtype))


def classify(status: int, body: str) -> str:
    """The kind of an error; twin of functions.tiles.error_kind for use inside tasks."""
    text = (body or "").lower()
    if status == 400:
        if "memory limit" in text or "memory capacity" in text:
            return "MEMORY_EXCEEDED"
        return "COMPUTATION_TIMEOUT" if "timed out" in text or "deadline exceeded" in text else "FATAL_REQUEST"
    if status == 401 or status == 403 and ("auth" in text or "credential" in text):
        return "AUTH_ERROR"
    if status in (403, 404):
        return "FATAL_REQUEST"
    return "RATE_LIMITED" if status == 429 else "RETRYABLE_SERVER" if 500 <= status <= 599 else "UNKNOWN"


def may_retry(status: int) -> bool:
    return status in (429, 503) or status >= 500 or status == -1


def fetch_one(source: PixelSource, tile: dict, attempts: int, budget: float, pause: Callable[[float], None], clock: Callable[[], float]) -> dict:
    began, last = clock(), SourceError(-1, "no attempt was made")
    made = 0
    for n in range(1, attempts + 1):
        if n > 1 and clock() - began > budget:
            break
        made = n
        try:
            return tile | {"payload": source.fetch(tile), "error_kind": None, "error_message": None, "http_status": None, "attempts": n}
        except SourceError as e:
            last = e
            if not may_retry(e.status):
                break
        except Exception as e:  # noqa: BLE001  whatever a source raises becomes a journal row
            last = SourceError(-1, f"{type(e).__name__}: {e}")
        if n < attempts:
            wait = min((2.0 if last.status == 503 else 1.0) * 2 ** (n - 1), 10.0)
            pause(wait * (1 + random.random() * 0.2))
    return tile | {"payload": None, "error_kind": classify(last.status, last.body), "error_message": str(last)[:500], "http_status": last.status if last.status > 0 else None, "attempts": made}


def fetch(tiles: DataFrame, source: PixelSource, partitions: int | None = None, threads: int = 8, attempts: int = 6, budget: float = 180.0, pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """Tiles with payload, or an error kind. Spread round-robin first, so that a source of one partition
    doesn't serialise the fetches; threads overlap the waits within a task. Persist or stage the result
    before branching on it, else the fetches run again."""
    spread = tiles.select(*TILE_COLUMNS).repartition(partitions or int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(frames):
        with ThreadPoolExecutor(threads) as pool:
            for frame in frames:
                rows = [{k: ([] if v is None else list(map(int, v))) if k == "lineage" else int(v) for k, v in r.items()} for r in frame.to_dict("records")]
                for i in range(0, len(rows), 4 * threads):
                    done = list(pool.map(lambda t: fetch_one(source, t, attempts, budget, pause, time.monotonic), rows[i : i + 4 * threads]))
                    out = pd.DataFrame(done)
                    out["http_status"], out["attempts"] = out["http_status"].astype("Int32"), out["attempts"].astype("int32")
                    yield out

    return spread.mapInPandas(run, FETCHED)
