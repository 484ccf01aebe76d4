"""The sidecar that an export leaves, and the check that a retry matches it."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.sources import store

FILE = "_export_meta.json"
MOST_MICROS = 10**17


class MetaMismatch(ValueError):
    """A retry's arguments differ from the export's."""


@dataclass
class Meta:
    crs: str
    pixel_size: float
    tile_size: int
    output_tile_size: int | None
    project: str
    expression: str
    snapshot_time: int
    grid: dict
    nodata: float | None = None
    band_count: int = 1
    data_type: str = "float32"
    compression: str = "deflate"
    region: dict | None = None
    labels: dict = field(default_factory=dict)
    schema_version: int = 1

    @property
    def expression_sha256(self) -> str:
        return hashlib.sha256(self.expression.encode()).hexdigest()


def write_meta(meta: Meta, output: str) -> None:
    store.put(output, FILE, json.dumps(asdict(meta), indent=1).encode())


def read_meta(output: str) -> Meta:
    """Raises FileNotFoundError where there is none; times in nanoseconds are read as microseconds."""
    raw = json.loads(store.read(f"{output.rstrip('/')}/{FILE}"))
    if raw.get("snapshot_time", 0) > MOST_MICROS:
        raw["snapshot_time"] //= 1000
    return Meta(**{k: v for k, v in raw.items() if k in Meta.__dataclass_fields__})


def verify(meta: Meta, **args) -> None:
    """Raises with every argument (not None, or nodata) that differs."""
    told = []
    for name, value in args.items():
        if value is None and name != "nodata" or getattr(meta, name) == value:
            continue
        was, now = (short_hash(getattr(meta, name)), short_hash(value)) if name == "expression" else (repr(getattr(meta, name)), repr(value))
        told.append(f"{name} was {was} and is now {now}")
    if told:
        raise MetaMismatch("this retry differs from the export it continues: " + "; ".join(told))


def short_hash(text: str) -> str:
    """An expression is too long for a message; the start of its hash tells two apart."""
    return f"one with hash {hashlib.sha256(text.encode()).hexdigest()[:12]}"


def mismatches(was: dict[str, Column], now: dict[str, Column]) -> Column:
    """Names of the fields that differ (two nulls are equal), table-wide."""
    return F.array_compact(F.array(*(F.when(~was[k].eqNullSafe(now[k]), F.lit(k)) for k in was)))
