"""Checks of an output folder: expected files against found ones, headers, and sampled pixels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.functions import geo
from tilewright.functions import tiles as fn
from tilewright.operators.tiling import Grid, units
from tilewright.schema import TILE_COLUMNS
from tilewright.sources import store, tiff
from tilewright.sources.pixels import PixelSource

EPSILON, ORIGIN_NEAR = 1e-4, 1e-6
#: A file of one deflated block of zeros with its directory is larger than this. Bytes read for a directory: of ours, all of
#: it up to some 100,000 blocks.
LEAST_BYTES, HEAD_BYTES = 200, 1 << 20


def found_files(spark: SparkSession, output: str) -> DataFrame:
    """out_row, out_col, length and head (the first bytes) of the output files in a folder."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "tile_r*_c*.tif").load(output)
    name = F.element_at(F.split("path", "/"), -1)
    keyed = raw.select(*(fn.filename_key(name, k).cast("int").alias(f"out_{k}") for k in ("row", "col")), "length", F.substring("content", 1, HEAD_BYTES).alias("head"))
    return keyed.dropna(subset=["out_row", "out_col"])


def missing(expected: DataFrame, found: DataFrame, excused: DataFrame) -> DataFrame:
    """Keys of expected files that aren't found and not excused."""
    return expected.select("out_row", "out_col").join(found, ["out_row", "out_col"], "left_anti").join(excused, ["out_row", "out_col"], "left_anti")


def unexpected(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Keys of found files that aren't expected."""
    return found.select("out_row", "out_col").distinct().join(expected, ["out_row", "out_col"], "left_anti")


def live(tiles: DataFrame, failed: DataFrame) -> DataFrame:
    """Tiles that no journal names."""
    return tiles.join(failed.select("row", "col").distinct(), ["row", "col"], "left_anti")


def first_of(rows: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def known_failed(tiles: DataFrame, failed: DataFrame) -> DataFrame:
    """Output keys of which every member tile is journaled."""
    marked = tiles.join(failed.select("row", "col").distinct().withColumn("lost", F.lit(True)), ["row", "col"], "left")
    return marked.groupBy("out_row", "out_col").agg(F.bool_and(F.coalesce("lost", F.lit(False))).alias("all_lost")).where("all_lost").select("out_row", "out_col")


def sample_evenly(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The rows at n evenly spaced ranks (half to even), first and last among them; all rows where there are no more than n.

    Ranks come from counts by range partition, so no window runs over all rows in one task.
    """
    if n <= 0:
        return df.limit(0)
    ranked = with_rank(df, order)
    total = ranked.count()
    if total <= n or n == 1:
        return ranked.where(F.col("rank") < n).drop("rank")
    # the inverse of rint(k * step), tried at the nearest k: no list of ranks has to meet the rows
    step = (total - 1) / (n - 1)
    k = F.rint(F.col("rank") / F.lit(step))
    return ranked.where(F.rint(k * F.lit(step)) == F.col("rank")).drop("rank")


def with_rank(df: DataFrame, order: list[str]) -> DataFrame:
    """``rank`` from 0 in ``order``: rows are numbered within range partitions and shifted by those before.

    The ranged rows are staged once, with their numbers. Bounds are sampled and partitions may be merged, so a second
    plan of the same shuffle, as for their counts, could deal rows out differently.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at, first, before, size = ("__rank_at", "__rank_first", "__rank_before", "__rank_size")
    parts = store.stage(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftright(at, 33)  # the number's upper bits are the partition's, the lower ones count from 0
    sizes = parts.groupBy(part.alias(first)).agg(F.count("*").alias(size))
    shift = sizes.withColumn(before, F.coalesce(F.sum(size).over(Window.orderBy(first).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = parts.join(F.broadcast(shift.select(first, before)), part == F.col(first))  # a row for each partition
    return ranked.withColumn("rank", F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + F.col(before)).drop(at, first, before)


def header_issues(found: DataFrame, expected: DataFrame, grid: Grid, bands: int, data_type: str) -> DataFrame:
    """out_row, out_col, issues of each file that is expected: size, bands, type, origin."""
    wanted = expected.select("out_row", "out_col", "origin_col_px", "origin_row_px", "width_px", "height_px")
    joined = wanted.join(found, ["out_row", "out_col"])
    wanted_code = geo.epsg(grid.crs)

    def run(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples():
                issues = []
                try:
                    if r.length < LEAST_BYTES:
                        issues.append(f"{r.length} bytes are too few for a file")
                    at = tiff.read_layout(r.head)
                    if (at.width, at.height) != (r.width_px, r.height_px):
                        issues.append(f"dimensions {at.width}x{at.height}, expected {r.width_px}x{r.height_px}")
                    if at.samples != bands:
                        issues.append(f"{at.samples} bands, expected {bands}")
                    if at.dtype.newbyteorder("=") != np.dtype(data_type):
                        issues.append(f"type {at.dtype.name}, expected {data_type}")
                    code = tiff.epsg_of(at.tags)
                    if code != wanted_code:
                        issues.append("no CRS" if code is None else f"CRS EPSG:{code}, expected {grid.crs}")
                    if tiff.TIEPOINT in at.tags:
                        x, y = at.tags[tiff.TIEPOINT][1][3:5]
                        want = grid.translate_x + r.origin_col_px * grid.scale_x, grid.translate_y + r.origin_row_px * grid.scale_y
                        if abs(x - want[0]) > ORIGIN_NEAR or abs(y - want[1]) > ORIGIN_NEAR:
                            issues.append(f"origin ({x}, {y}), expected {want}")
                except tiff.TiffError as e:
                    issues.append(f"unreadable: {e}")
                out.append((r.out_row, r.out_col, issues))
            yield pd.DataFrame(out, columns=["out_row", "out_col", "issues"])

    return joined.mapInPandas(run, "out_row int, out_col int, issues array<string>")


def integrity(spark: SparkSession, tiles: DataFrame, output: str, grid: Grid, failed: DataFrame | None = None, bands: int = 1, data_type: str = "float32") -> DataFrame:
    """A row (problem, out_row, out_col, detail) for each fault: missing, unexpected, header."""
    expected = units(tiles)
    excused = known_failed(tiles, failed) if failed is not None else spark.createDataFrame([], "out_row int, out_col int")
    found = found_files(spark, output)
    named = lambda df, problem: df.select(F.lit(problem).alias("problem"), "out_row", "out_col", F.lit("").alias("detail"))
    lost, extra = named(missing(expected, found, excused), "missing"), named(unexpected(expected, found), "unexpected")
    bad = header_issues(found, expected, grid, bands, data_type).where(F.size("issues") > 0).select(F.lit("header").alias("problem"), "out_row", "out_col", F.array_join("issues", "; ").alias("detail"))
    return lost.unionAll(extra).unionAll(bad.join(excused, ["out_row", "out_col"], "left_anti").select("problem", "out_row", "out_col", "detail"))


def window(pixels: np.ndarray, y: int, x: int, height: int, width: int) -> np.ndarray:
    """A rectangle of an image."""
    return pixels[y : y + height, x : x + width]


def difference(a: np.ndarray, b: np.ndarray, epsilon: float = EPSILON) -> tuple[int, float | None, float | None, bool]:
    """Pixels compared (finite in both), greatest and mean difference (none: nothing to compare), whether they agree."""
    a, b = a.astype(float), b.astype(float)
    if a.shape != b.shape:
        raise ValueError(f"shapes {a.shape} and {b.shape} differ")
    d = np.abs(a - b)[np.isfinite(a) & np.isfinite(b)]
    return (len(d), float(d.max()), float(d.mean()), bool(d.max() <= epsilon)) if len(d) else (0, None, None, True)


def pixel_differences(tiles: DataFrame, output: str, source: PixelSource, edge: int, sample: int = 20, failed: DataFrame | None = None, epsilon: float = EPSILON) -> DataFrame:
    """Sampled tiles with max_abs, mean_abs (null: nothing to compare) and agrees, written pixels against the source."""
    chosen = sample_evenly((tiles if failed is None else live(tiles, failed)).select(*TILE_COLUMNS), ["row_px", "col_px"], sample)

    def run(frames):
        from tilewright.operators.assembly import file_name

        for frame in frames:
            out = []
            for r in frame.to_dict("records"):
                tile = {k: ([] if v is None else list(v)) if k == "lineage" else int(v) for k, v in r.items()}
                have, _ = tiff.decode(store.read(f"{output.rstrip('/')}/{file_name(tile['out_row'], tile['out_col'])}"))
                want, _ = tiff.decode(source.fetch(tile))
                y, x = tile["row_px"] - tile["out_row"] * edge, tile["col_px"] - tile["out_col"] * edge
                _, most, mean, agrees = difference(window(have, y, x, tile["height_px"], tile["width_px"]), want, epsilon)
                out.append((tile["row"], tile["col"], most if most is None else round(most, 8), mean if mean is None else round(mean, 8), agrees))
            yield pd.DataFrame(out, columns=["row", "col", "max_abs", "mean_abs", "agrees"])

    return chosen.mapInPandas(run, "row int, col int, max_abs double, mean_abs double, agrees boolean")

