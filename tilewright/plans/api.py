"""Exports, retries and validation as whole jobs."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators import assembly, retrying, tiling, validation
from tilewright.plans import pinning
from tilewright.plans.config import ExportConfig, InputError, input_errors
from tilewright.plans.meta import Meta, read_meta, verify, write_meta
from tilewright.schema import TILE_COLUMNS
from tilewright.sources import files, store
from tilewright.sources.pixels import PixelSource, fetch

JOURNAL, TILES = "_failures.json", "_tiles.ndjson"


def plain_region(region: object) -> dict | None:
    """GeoJSON from a dict, its text, or anything with ``__geo_interface__``."""
    if region is None:
        return None
    region = getattr(region, "__geo_interface__", region)
    return json.loads(region) if isinstance(region, str) else region


def plain_expression(expression: object) -> str:
    """An expression's JSON from its text, or from its tree."""
    return expression if isinstance(expression, str) else json.dumps(expression)


@dataclass
class ExportResult:
    output: str
    tiles: int
    files: int
    failed: int
    dry_run: bool = False


@dataclass
class RetryResult(ExportResult):
    carried: int = 0
    stats: dict = field(default_factory=dict)


@dataclass
class Check:
    name: str
    status: str  # passed, failed, skipped or error
    message: str
    details: list = field(default_factory=list)


@dataclass
class Report:
    checks: list[Check]

    @property
    def all_passed(self) -> bool:
        return not any(c.status in ("failed", "error") for c in self.checks)


def tile(spark: SparkSession, region: dict, scale: float = 30.0, crs: str = "EPSG:4326", tile_size: int = 512, output_tile_size: int | None = None) -> DataFrame:
    """The tiles of a region."""
    return tiling.region_tiles(spark, plain_region(region), scale, crs, tile_size, output_tile_size)[1]


def run(spark: SparkSession, tiles: DataFrame, source: PixelSource, grid: tiling.Grid, config: ExportConfig, carried: DataFrame | None = None, **options) -> tuple[int, int]:
    """Fetches once, writes once, leaves the journal; gives the files written and the fresh failures.

    Both results are staged, since two filters over one lazy fetch would fetch twice.
    """
    at = f"{config.output.rstrip('/')}/_staging/{uuid.uuid4().hex}"
    fetch(tiles, source, **options).write.parquet(f"{at}/fetched")
    fetched = spark.read.parquet(f"{at}/fetched")
    assembly.write(fetched, config.output, grid, config.tile_size, config.output_tile_size, config.merge, config.nodata, config.compression).write.parquet(f"{at}/written")
    written = spark.read.parquet(f"{at}/written")
    fresh = assembly.failures(fetched, written)
    n_files, n_failed = written.where("kind = 'file'").count(), fresh.count()
    files.write_lines(retrying.journal_lines(fresh, carried), f"{config.output.rstrip('/')}/{JOURNAL}")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(at)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    return n_files, n_failed


def export(spark: SparkSession, expression: str, output: str, source: PixelSource, project: str = "", region: dict | None = None, scale: float | None = None, crs: str = "EPSG:4326", grid: tiling.Grid | None = None, tile_size: int = 512, output_tile_size: int | None = None, nodata: float | None = None, band_count: int = 1, data_type: str = "float32", compression: str = "deflate", snapshot_time: int | None = None, labels: dict | None = None, dry_run: bool = False, confirm: Callable[[ExportConfig], bool] | None = None, **options) -> ExportResult:
    """A fresh export of a region at a scale, or of an exact grid (then a region only filters tiles)."""
    expression, region = plain_expression(expression), plain_region(region)
    wrong = input_errors(expression, region, crs)
    if grid is None and region is None:
        wrong.append("a region or a grid is needed")
    if grid is not None and scale is not None:
        wrong.append("scale goes with a region, not with a grid")
    if wrong:
        raise InputError("; ".join(wrong))
    snapshot_time = snapshot_time or time.time_ns() // 1000
    pinned = pinning.pin(expression, snapshot_time)
    if grid is None:
        grid, tiles = tiling.region_tiles(spark, region, scale or 30.0, crs, tile_size, output_tile_size)
    else:
        tiles = tiling.exact_tiles(spark, grid, tile_size, output_tile_size, region)
    config = ExportConfig(pinned, project, output, asdict(grid), tile_size, output_tile_size, band_count, data_type, nodata, compression, False, snapshot_time, region, labels or {})
    n = tiles.count()
    if dry_run or (confirm is not None and not confirm(config)):
        return ExportResult(output, n, 0, 0, True)
    write_meta(Meta(grid.crs, abs(grid.scale_x), tile_size, output_tile_size, project, expression, snapshot_time, asdict(grid), nodata, band_count, data_type, compression, region, labels or {}), output)
    config.write()
    n_files, n_failed = run(spark, tiles, source, grid, config, **options)
    return ExportResult(output, n, n_files, n_failed)


def retry(spark: SparkSession, output: str, source: PixelSource, journal: str | None = None, max_depth: int = 2, dry_run: bool = False, **given) -> RetryResult:
    """Tries the journal's tiles again, merging into the files that stand; nothing to do writes nothing."""
    options = {k: given.pop(k) for k in list(given) if k in ("partitions", "threads", "attempts", "budget", "pause")}
    meta = read_meta(output)
    verify(meta, **({"nodata": meta.nodata} | given))
    plan = retrying.plan(store.stage(files.read_journal(spark, journal or f"{output.rstrip('/')}/{JOURNAL}")), max_depth)
    stats = {r.action: r.n for r in plan.stats.orderBy("action").collect()}
    tiles, carried = store.stage(plan.next_tiles.select(*TILE_COLUMNS)), store.stage(plan.carryover.select(F.col("raw").alias("value")))
    n, n_carried = tiles.count(), carried.count()
    if not n or dry_run:
        return RetryResult(output, n, 0, 0, dry_run, n_carried, stats)
    grid = tiling.Grid(**meta.grid)
    config = ExportConfig(pinning.pin(meta.expression, meta.snapshot_time), meta.project, output, meta.grid, meta.tile_size, meta.output_tile_size, meta.band_count, meta.data_type, meta.nodata, meta.compression, True, meta.snapshot_time, meta.region, meta.labels)
    n_files, n_failed = run(spark, tiles, source, grid, config, carried, **options)
    return RetryResult(output, n, n_files, n_failed, False, n_carried, stats)


def retry_until_done(spark: SparkSession, output: str, source: PixelSource, max_rounds: int = 5, round_backoff: float = 30.0, journal: str | None = None, callback: Callable[[int, RetryResult], None] | None = None, pause_between: Callable[[float], None] = time.sleep, **given) -> tuple[str, list[RetryResult]]:
    """Rounds of ``retry`` until none has work left or ``max_rounds``; an explicit journal serves the first round."""
    results: list[RetryResult] = []
    for k in range(max_rounds):
        if k:
            pause_between(round_backoff)
        results.append(retry(spark, output, source, journal if k == 0 else None, **given))
        if callback:
            callback(k, results[-1])
        if results[-1].tiles == 0:
            return "no_retryable_work", results
    return "max_rounds", results


def validate(spark: SparkSession, output: str, source: PixelSource | None = None, sample: int = 20, region: dict | None = None) -> Report:
    """Checks the folder of an export; whatever a check raises becomes its error.

    The tiles expected are those of the sidecar's grid that meet its region (or ``region``); where the folder holds a
    tile list (``_tiles.ndjson``), they are its.
    """
    meta = read_meta(output)
    grid, at = tiling.Grid(**meta.grid), output.rstrip("/")
    if region is None and store.exists(f"{at}/{TILES}"):
        tiles = files.read_tiles(spark, f"{at}/{TILES}")
        if tiles.isEmpty():
            raise InputError(f"the tile list {TILES} is empty")
    else:
        tiles = tiling.exact_tiles(spark, grid, meta.tile_size, meta.output_tile_size, plain_region(region) or meta.region)
    journal = f"{at}/{JOURNAL}"
    failed = files.failure_keys(spark, journal) if store.exists(journal) else spark.createDataFrame([], "row int, col int")

    def integrity() -> Check:
        bad = validation.integrity(spark, tiles, output, grid, failed, meta.band_count, meta.data_type)
        n = bad.count()
        return Check("integrity", "failed" if n else "passed", f"{n} problems", [r.asDict() for r in bad.orderBy("problem", "out_row", "out_col").limit(20).collect()])

    def pixels() -> Check:
        if source is None:
            return Check("pixels", "skipped", "no source")
        rows = validation.pixel_differences(tiles, output, source, meta.output_tile_size or meta.tile_size, sample, failed).collect()
        compared = [r for r in rows if r.max_abs is not None]
        off = [r.asDict() for r in rows if not r.agrees]
        return Check("pixels", "failed" if off else "passed" if compared else "skipped", f"{len(compared)} compared, {len(off)} differ", off[:10])

    checks = []
    for name, check in (("integrity", integrity), ("pixels", pixels)):
        try:
            checks.append(check())
        except Exception as e:  # noqa: BLE001
            checks.append(Check(name, "error", f"{type(e).__name__}: {e}"[:500]))
    return Report(checks)
