"""Regions and grids to tiles. Tiles are generated on the executors from ranges; no list is shipped."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import geo
from tilewright.functions import tiles as fn


@dataclass(frozen=True)
class Grid:
    """A north-up or sheared pixel grid."""

    crs: str
    scale_x: float
    translate_x: float
    scale_y: float
    translate_y: float
    width: int
    height: int
    shear_x: float = 0.0
    shear_y: float = 0.0

    def __post_init__(self):
        if self.width <= 0 or self.height <= 0:
            raise ValueError("grid dimensions must be positive")
        if abs(self.scale_x * self.scale_y - self.shear_x * self.shear_y) <= 1e-12:
            raise ValueError("affine transform is singular")

    @property
    def affine(self) -> dict[str, float]:
        return {k: getattr(self, k) for k in ("scale_x", "shear_x", "translate_x", "shear_y", "scale_y", "translate_y")}


def check_sizes(tile: int, out: int | None) -> None:
    if tile <= 0:
        raise ValueError("tile size must be positive")
    if out is not None and (out < tile or out % tile):
        raise ValueError(f"output tile size {out} must be a whole multiple of tile_size {tile}")


def snapped_grid(region: dict, crs: str, scale: float, tile: int = 512, out: int | None = None) -> tuple[Grid, list]:
    """The grid that covers a WGS84 region, aligned with the global origin, and the region in the grid's system."""
    check_sizes(tile, out)
    if scale <= 0:
        raise ValueError("scale must be positive")
    parts = geo.project(geo.polygons(region), crs)
    p = scale / 111_320.0 if geo.is_geographic(crs) else float(scale)
    minx, miny, maxx, maxy = geo.extent(parts)
    step = out or tile
    c0, r0 = int(np.floor(minx / p)) // step * step, int(np.floor(-maxy / p)) // step * step
    c1, r1 = -(-int(np.ceil(maxx / p)) // tile) * tile, -(-int(np.ceil(-miny / p)) // tile) * tile
    return Grid(crs, p, c0 * p, -p, -r0 * p, c1 - c0, r1 - r0), parts


def meeting(tiles: DataFrame, parts: list) -> DataFrame:
    """Tiles (with xmin, ymin, xmax, ymax) that share a point with polygons of their system; touching counts.

    The polygons' extent is a native filter, so only what it leaves crosses to Python.
    """
    minx, miny, maxx, maxy = geo.extent(parts)
    near = tiles.where((F.col("xmin") <= maxx) & (F.col("xmax") >= minx) & (F.col("ymin") <= maxy) & (F.col("ymax") >= miny))

    def keep(batches):
        for b in batches:
            boxes = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("xmin", "ymin", "xmax", "ymax")], axis=1)
            yield b.filter(pa.array(geo.intersects(parts, boxes)))

    return near.mapInArrow(keep, near.schema)


def count_files(tiles: DataFrame) -> DataFrame:
    """n_files: the output files that the tiles make."""
    return tiles.agg(F.countDistinct("out_row", "out_col").alias("n_files"))


def neighbours(tiles: DataFrame, key: str) -> DataFrame:
    """``key`` of each tile with that of the tile to its right and of the one below (null at the edge)."""
    right = tiles.select(F.col(key).alias("right_id"), "row", (F.col("col") - 1).alias("col"))
    below = tiles.select(F.col(key).alias("below_id"), (F.col("row") - 1).alias("row"), "col")
    return tiles.select(key, "row", "col").join(right, ["row", "col"], "left").join(below, ["row", "col"], "left").select(key, "right_id", "below_id")


def grid_tiles(spark: SparkSession, grid: Grid, tile: int = 512, out: int | None = None, parts: list | None = None) -> DataFrame:
    """Tiles of a grid, those alone that meet the polygons ``parts`` (in the grid's system) where given."""
    check_sizes(tile, out)
    if grid.width % tile or grid.height % tile:
        raise ValueError("grid dimensions must be whole multiples of tile_size")
    across, down, step = grid.width // tile, grid.height // tile, out or tile
    n = spark.range(across * down)
    col, row = F.col("id") % across, F.floor(F.col("id") / across)
    tiles = n.select((col * tile).alias("c"), (row * tile).alias("r"))
    if parts is not None:
        size = F.lit(tile)
        tiles = meeting(tiles.select("c", "r", *(v.alias(k) for k, v in fn.tile_bbox(grid.affine, F.col("c"), F.col("r"), size, size).items())), parts).select("c", "r")
    i = lambda e, name: e.cast("int").alias(name)
    return tiles.select(
        i(F.col("c"), "col_px"), i(F.col("r"), "row_px"), i(F.lit(tile), "width_px"), i(F.lit(tile), "height_px"), i(F.floor(F.col("r") / tile), "row"), i(F.floor(F.col("c") / tile), "col"),
        i(F.floor(F.col("r") / step), "out_row"), i(F.floor(F.col("c") / step), "out_col"), F.array().cast("array<int>").alias("lineage"),
    )


def region_tiles(spark: SparkSession, region: dict, scale: float = 30.0, crs: str = "EPSG:4326", tile: int = 512, out: int | None = None) -> tuple[Grid, DataFrame]:
    """Grid and tiles of a region; raises where none remains."""
    grid, parts = snapped_grid(region, crs, scale, tile, out)
    tiles = grid_tiles(spark, grid, tile, out, parts)
    if tiles.isEmpty():
        raise ValueError("the grid does not intersect the region")
    return grid, tiles


def exact_tiles(spark: SparkSession, grid: Grid, tile: int = 512, out: int | None = None, region: dict | None = None) -> DataFrame:
    """Tiles of a grid taken as it is."""
    parts = None if region is None else geo.project(geo.polygons(region), grid.crs)
    tiles = grid_tiles(spark, grid, tile, out, parts)
    if parts is not None and tiles.isEmpty():
        raise ValueError("the grid does not intersect the region")
    return tiles


def units(tiles: DataFrame) -> DataFrame:
    """One row for each output file: its key, origin, size and member tiles."""
    member = F.struct(*(c for c in ("col_px", "row_px", "width_px", "height_px", "row", "col", "lineage")))
    u = tiles.groupBy("out_row", "out_col").agg(
        F.min("col_px").alias("origin_col_px"), F.min("row_px").alias("origin_row_px"), F.max(F.col("col_px") + F.col("width_px")).alias("right"), F.max(F.col("row_px") + F.col("height_px")).alias("bottom"), F.array_sort(F.collect_list(member)).alias("members")
    )
    return u.select("out_row", "out_col", "origin_col_px", "origin_row_px", (F.col("right") - F.col("origin_col_px")).alias("width_px"), (F.col("bottom") - F.col("origin_row_px")).alias("height_px"), "members")
