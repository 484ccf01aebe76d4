"""Column functions over tiles, failures and figures; all of them JVM expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.schema import PIXEL_BYTES, RETRY_KINDS, SPLIT_KINDS, TERMINAL_KINDS

METERS_PER_DEGREE = 111_320.0


def pixel_size(scale: Column, geographic: Column) -> Column:
    return F.when(geographic, scale / METERS_PER_DEGREE).otherwise(scale)


def floor_to(value: Column, step: int) -> Column:
    """The multiple of ``step`` at or below an integer that may be negative."""
    value = value.cast("bigint")
    return value - F.pmod(value, F.lit(step).cast("bigint"))


def ceil_to(value: Column, step: int) -> Column:
    return -floor_to(-value.cast("bigint"), step)


def snap(minx: Column, miny: Column, maxx: Column, maxy: Column, p: float, tile: int, out: int | None = None) -> dict[str, Column]:
    """Absolute pixel offsets of a region's bounds: starts on the output tile, ends on the compute tile."""
    step = out or tile
    return {
        "col_start": floor_to(F.floor(minx / p), step), "col_end": ceil_to(F.ceil(maxx / p), tile),
        "row_start": floor_to(F.floor(-maxy / p), step), "row_end": ceil_to(F.ceil(-miny / p), tile),
    }


def tile_affine(a: dict[str, float | Column], col: Column, row: Column) -> dict[str, Column]:
    """Affine of a tile at (col, row) of a grid with affine ``a``; the order of operations is fixed."""
    v = {k: F.lit(x) if not isinstance(x, Column) else x for k, x in a.items()}
    return {
        "translate_x": v["translate_x"] + col * v["scale_x"] + row * v["shear_x"],
        "translate_y": v["translate_y"] + col * v["shear_y"] + row * v["scale_y"],
    }


def tile_bbox(a: dict[str, float], col: Column, row: Column, width: Column, height: Column) -> dict[str, Column]:
    """Bounds of a tile of an unsheared grid."""
    sx, sy, tx, ty = (F.lit(float(a[k])) for k in ("scale_x", "scale_y", "translate_x", "translate_y"))
    return {"xmin": tx + col * sx, "ymin": ty + (row + height) * sy, "xmax": tx + (col + width) * sx, "ymax": ty + row * sy}


def filename(out_row: Column, out_col: Column) -> Column:
    return F.format_string("tile_r%04d_c%04d.tif", out_row, out_col)


def filename_key(name: Column, which: str) -> Column:
    """Row or column number in a file name; null for other names."""
    return F.nullif(F.regexp_extract(name, r"^tile_r(\d{4,})_c(\d{4,})\.tif$", 1 if which == "row" else 2), F.lit("")).cast("bigint")


def tile_id(row: Column, col: Column, lineage: Column) -> Column:
    path = F.when(F.size(lineage) > 0, F.concat(F.lit(",q="), F.array_join(lineage, ""))).otherwise("")
    return F.concat(F.lit("tile[r="), row.cast("string"), F.lit(",c="), col.cast("string"), path, F.lit("]"))


def error_kind(status: Column, body: Column) -> Column:
    text = F.lower(F.coalesce(body, F.lit("")))
    has = lambda *words: F.greatest(*(F.contains(text, F.lit(w)) for w in words)) if len(words) > 1 else F.contains(text, F.lit(words[0]))
    return (
        F.when((status == 400) & has("memory limit", "memory capacity"), "MEMORY_EXCEEDED").when((status == 400) & has("timed out", "deadline exceeded"), "COMPUTATION_TIMEOUT")
        .when(status == 400, "FATAL_REQUEST").when(status == 429, "RATE_LIMITED").when(status == 401, "AUTH_ERROR").when((status == 403) & has("auth", "credential"), "AUTH_ERROR")
        .when(status.isin(403, 404), "FATAL_REQUEST").when(status.between(500, 599), "RETRYABLE_SERVER").otherwise("UNKNOWN")
    )


def http_retryable(status: Column) -> Column:
    return F.when(status.isin(429, 503), True).when(status.isin(400, 403, 404), False).otherwise(status >= 500)


def backoff_ms(status: Column, attempt: Column) -> Column:
    """Pause after an attempt (from 1), before jitter."""
    return F.least(F.when(status == 503, 2000).otherwise(1000) * F.pow(F.lit(2.0), attempt - 1), F.lit(10_000.0)).cast("bigint")


def retry_action(kind: Column, depth: Column, max_depth: int) -> Column:
    return (
        F.when(kind.isin(*SPLIT_KINDS) & (depth < max_depth), "split").when(kind.isin(*SPLIT_KINDS), "depth_cap")
        .when(kind.isin(*RETRY_KINDS), "retry_same").when(kind.isin(*TERMINAL_KINDS), "terminal").otherwise("unknown_kind")
    )


def quadrants(col_px: Column, row_px: Column, width: Column, height: Column, lineage: Column) -> Column:
    """The four children of a tile, quadrant 0 south-west, 1 south-east, 2 north-west, 3 north-east."""
    w, h = (width / 2).cast("int"), (height / 2).cast("int")
    child = lambda q: F.struct(F.lit(q).alias("q"), (col_px + (w if q % 2 else F.lit(0))).cast("int").alias("col_px"), (row_px + (h if q < 2 else F.lit(0))).cast("int").alias("row_px"), w.alias("width_px"), h.alias("height_px"), F.concat(lineage, F.array(F.lit(q))).alias("lineage"))
    return F.array(*(child(q) for q in range(4)))


def nodata_text(x: Column) -> Column:
    """A nodata value as its tag has it: nan, no fraction for whole numbers below 10^15, else the shortest form."""
    return F.when(F.isnan(x), "nan").when((x == F.rint(x)) & (F.abs(x) < 1e15), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def scaled(x: Column, digits: int) -> Column:
    """x * 10^digits (digits 0 to 2, x >= 0) rounded to a whole number by the exact binary value, ties to even.

    The product is a sum of exact multiples by powers of two, so its rounding error is known (two-sum).
    """
    high, low = x, F.lit(0.0)
    for k in ((), (8.0, 2.0), (64.0, 32.0, 4.0))[digits]:
        term = x * k
        if k in (8.0, 64.0):
            high = term
            continue
        total = high + term
        part = total - high
        low = low + ((high - (total - part)) + (term - part))
        high = total
    whole = F.floor(high)
    half = whole + 0.5
    up = (high > half) | ((high == half) & ((low > 0) | ((low == 0) & (whole % 2 == 1))))
    return (whole + F.when(up, 1).otherwise(0)).cast("bigint")


def fixed(x: Column, digits: int, whole: Callable[[Column], Column] = lambda n: n.cast("string")) -> Column:
    """x >= 0 (below 10^13) with so many decimals, as C's printf writes it; null for null."""
    n = scaled(x, digits)
    if digits == 0:
        return whole(n)
    return F.concat(whole(F.floor(n / 10**digits)), F.lit("."), F.lpad((n % 10**digits).cast("string"), digits, "0"))


def bytes_text(n: Column) -> Column:
    kb = 1024.0
    return F.when(n < kb, F.concat(n.cast("string"), F.lit(" B"))).when(n < kb**2, F.concat(fixed(n / kb, 1), F.lit(" KB"))).when(n < kb**3, F.concat(fixed(n / kb**2, 1), F.lit(" MB"))).otherwise(F.concat(fixed(n / kb**3, 2), F.lit(" GB")))


def duration_text(s: Column) -> Column:
    s = s.cast("double")
    text = F.when(s < 60, F.concat(fixed(s, 0), F.lit(" s"))).when(s < 3600, F.concat(fixed(s / 60, 1), F.lit(" min"))).otherwise(F.concat(fixed(s / 3600, 1), F.lit(" h")))
    return F.concat(F.lit("~"), text)


def usd_text(x: Column) -> Column:
    return F.when((x > 0) & (x < 0.005), "<$0.01").otherwise(F.concat(F.when(x < 0, "$-").otherwise("$"), fixed(F.abs(x.cast("double")), 2, lambda n: F.format_number(n, 0))))


def raw_bytes(tiles: Column, tile: Column, data_type: Column, bands: Column) -> Column:
    size = F.coalesce(*(F.when(data_type == k, F.lit(v)) for k, v in PIXEL_BYTES.items()), F.lit(4))
    return (tiles.cast("bigint") * tile * tile * size * bands).cast("bigint")


def machine_vcpus(machine: Column) -> Column:
    """vCPUs of a *-standard-N machine type; 4 for any other."""
    return F.coalesce(F.nullif(F.regexp_extract(machine, r"-standard-(\d+)$", 1), F.lit("")).cast("int"), F.lit(4))
