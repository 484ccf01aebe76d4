"""Fetched tiles to Cloud Optimized GeoTIFFs: one file for each tile, or one for each output key.

Files are written under a temporary name and renamed, so a task that runs twice leaves one whole file.
Whatever fails becomes journal rows; nothing fails the job.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions import geo
from tilewright.operators.tiling import Grid
from tilewright.schema import TILE_COLUMNS
from tilewright.sources import store, tiff

RESULT = "kind string, out_row int, out_col int, tiles int, empty_blocks int, merged boolean, checksum double, col_px int, row_px int, width_px int, height_px int, row int, col int, lineage array<int>, error_kind string, error_message string, http_status int, attempts int"


def tags_of(grid: Grid, source: tiff.Layout) -> dict[int, tuple[int, tuple]]:
    """What a file carries besides its layout: its source's tags, and the grid's system where the source names none."""
    own = tiff.carried(source.tags)
    return own if tiff.GEO_KEYS in own else own | tiff.geo_keys(geo.epsg(grid.crs), geo.is_geographic(grid.crs))


def file_name(out_row: int, out_col: int) -> str:
    return f"tile_r{out_row:04d}_c{out_col:04d}.tif"


def nodata_text(x: float | None) -> str | None:
    if x is None:
        return None
    return "nan" if np.isnan(x) else str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(float(x))


ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "array<int>": pa.list_(pa.int32())}
RESULT_ARROW = pa.schema([(name, ARROW[kind]) for name, kind in (x.split(" ") for x in RESULT.split(", "))])


def result_rows(kind: str, members: list[dict], message: str | None = None, **own) -> list[dict]:
    """Rows of ``RESULT`` for these tiles (without their payloads)."""
    out = []
    for r in members:
        base = {"kind": kind, "tiles": 1, "empty_blocks": 0, "merged": False, "checksum": None, **{c: r[c] for c in ("out_row", "out_col", "col_px", "row_px", "width_px", "height_px", "row", "col")}, "lineage": list(r["lineage"] or [])}
        out.append(base | {"error_kind": "UNKNOWN", "error_message": f"write-stage: {message}"[:500], "http_status": None, "attempts": 1} | own)
    return out


def written_row(member: dict, **own) -> list[dict]:
    return result_rows("file", [member], error_kind=None, error_message=None, attempts=None, **own)


class Canvas:
    """An output tile into which members are drawn one after another.

    before: the file as it stands, the baseline of a merge.
    """

    def __init__(self, key: tuple[int, int], grid: Grid, edge: int, tile: int, before: bytes | None):
        if grid.shear_x or grid.shear_y:
            raise ValueError("a sheared grid has no assembled form")
        self.y, self.x, self.tile, self.before = key[0] * edge, key[1] * edge, tile, before
        self.height, self.width = min(edge, grid.height - self.y), min(edge, grid.width - self.x)
        self.pixels, self.layout = None, None
        self.covered = np.zeros((-(-self.height // tile), -(-self.width // tile)), dtype=np.int64)

    def draw(self, member: dict) -> None:
        pixels, layout = tiff.decode(member["payload"])
        if self.pixels is None:
            self.start(pixels, layout)
        y, x, h, w = member["row_px"] - self.y, member["col_px"] - self.x, member["height_px"], member["width_px"]
        if y < 0 or x < 0 or y + h > self.height or x + w > self.width:
            raise ValueError("a tile lies outside of its output tile")
        if pixels.shape != (h, w, self.pixels.shape[2]) or pixels.dtype != self.pixels.dtype:
            raise ValueError(f"a tile of {h} x {w} came as {pixels.shape} of {pixels.dtype}")
        self.pixels[y : y + h, x : x + w] = pixels
        self.covered[y // self.tile, x // self.tile] += h * w

    def start(self, first: np.ndarray, layout: tiff.Layout) -> None:
        self.layout, shape = layout, (self.height, self.width, first.shape[2])
        if self.before is None:
            self.pixels = np.zeros(shape, dtype=first.dtype)
            return
        was, old = tiff.decode(self.before)
        if was.shape != shape or old.dtype.newbyteorder("=") != layout.dtype.newbyteorder("="):
            raise ValueError("the existing file has another layout")
        self.pixels = was.copy()

    @property
    def empty(self) -> int:
        """Blocks that no member covers; a merge has none."""
        return 0 if self.before is not None else int((self.covered == 0).sum())


def assemble(members: list[dict], key: tuple[int, int], grid: Grid, edge: int, tile: int, before: bytes | None) -> tuple[np.ndarray, int, tiff.Layout]:
    """The canvas of an output tile, the number of its blocks that no member covers, and the first member's layout.

    Deeper tiles go over shallower ones.
    """
    canvas = Canvas(key, grid, edge, tile, before)
    for m in sorted(members, key=lambda m: (len(m["lineage"]), m["row_px"], m["col_px"])):
        canvas.draw(m)
    return canvas.pixels, canvas.empty, canvas.layout


def tiles_of(batches) -> Iterator[dict]:
    """Rows one at a time, so that one payload is held beside the batch."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def write_assembled(fetched: DataFrame, output: str, grid: Grid, tile: int, out: int | None = None, merge: bool = False, nodata: float | None = None, compression: str = "deflate") -> DataFrame:
    """Rows of kind ``file`` (one for each file written) and ``failed`` (each member of a group that failed).

    Tiles arrive sorted by output tile, shallower ones first, and are drawn as they stream by: a task holds
    one canvas and one batch, however many members an output tile has.
    """
    edge = out or tile

    def write_group(key: tuple[int, int], group: Iterator[dict]) -> list[dict]:
        members: list[dict] = []
        canvas, wrong = None, None
        name = file_name(*key)
        for m in group:
            members.append({k: v for k, v in m.items() if k != "payload"})
            if wrong is None:
                try:
                    if canvas is None:
                        at = f"{output.rstrip('/')}/{name}"
                        canvas = Canvas(key, grid, edge, tile, store.read(at) if merge and store.exists(at) else None)
                    canvas.draw(m)
                except Exception as e:  # noqa: BLE001  whatever goes wrong in a group becomes its tiles' journal rows
                    wrong, canvas = str(e), None
        if wrong is None:
            try:
                block = tile if canvas.height % tile == 0 and canvas.width % tile == 0 else None
                origin = grid.translate_x + key[1] * edge * grid.scale_x, grid.translate_y + key[0] * edge * grid.scale_y
                store.put(output, name, tiff.encode(canvas.pixels, block, compression, (grid.scale_x, grid.scale_y), origin, nodata_text(nodata), tags_of(grid, canvas.layout)))
                return written_row(members[0], tiles=len(members), empty_blocks=canvas.empty, merged=canvas.before is not None, checksum=float(np.nansum(canvas.pixels, dtype=np.float64)))
            except Exception as e:  # noqa: BLE001
                wrong = str(e)
        return result_rows("failed", members, wrong)

    def run(batches):
        for key, group in itertools.groupby(tiles_of(batches), key=lambda m: (m["out_row"], m["out_col"])):
            yield pa.RecordBatch.from_pylist(write_group(key, group), schema=RESULT_ARROW)

    depth = F.size(F.coalesce("lineage", F.array().cast("array<int>")))
    ok = fetched.where("payload is not null").select(*TILE_COLUMNS, "payload")
    return ok.repartition("out_row", "out_col").sortWithinPartitions("out_row", "out_col", depth, "row_px", "col_px").mapInArrow(run, RESULT)


def write_direct(fetched: DataFrame, output: str, grid: Grid, tile: int, nodata: float | None = None, compression: str = "deflate") -> DataFrame:
    """One file for each compute tile, named by row and col; no shuffle."""

    def write_one(m: dict) -> list[dict]:
        plain = {k: v for k, v in m.items() if k != "payload"}
        try:
            if (m["row"], m["col"]) != (m["out_row"], m["out_col"]):
                raise ValueError("a direct tile must be its own output tile")
            pixels, layout = tiff.decode(m["payload"])
            block = tile if pixels.shape[0] % tile == 0 and pixels.shape[1] % tile == 0 else None
            origin = grid.translate_x + m["col_px"] * grid.scale_x, grid.translate_y + m["row_px"] * grid.scale_y
            store.put(output, file_name(m["row"], m["col"]), tiff.encode(pixels, block, compression, (grid.scale_x, grid.scale_y), origin, nodata_text(nodata), tags_of(grid, layout)))
            return written_row(plain, checksum=float(np.nansum(pixels, dtype=np.float64)))
        except Exception as e:  # noqa: BLE001
            return result_rows("failed", [plain], str(e))

    def run(batches):
        for m in tiles_of(batches):
            yield pa.RecordBatch.from_pylist(write_one(m), schema=RESULT_ARROW)

    return fetched.where("payload is not null").select(*TILE_COLUMNS, "payload").mapInArrow(run, RESULT)


def write(fetched: DataFrame, output: str, grid: Grid, tile: int, out: int | None = None, merge: bool = False, nodata: float | None = None, compression: str = "deflate") -> DataFrame:
    """Routes to the direct writer where no tiles need to meet."""
    if (out is not None and out > tile) or merge:
        return write_assembled(fetched, output, grid, tile, out, merge, nodata, compression)
    return write_direct(fetched, output, grid, tile, nodata, compression)


def failures(fetched: DataFrame, written: DataFrame) -> DataFrame:
    """Journal rows of both stages."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    columns = [*TILE_COLUMNS, "error_kind", "error_message", "http_status", "attempts"]
    lost = fetched.where("payload is null").select(*columns).unionByName(written.where("kind = 'failed'").select(*columns))
    return lost.withColumns({"first_seen": now, "last_seen": now, "journal_reason": F.lit("failed")})



def counters(written: DataFrame) -> DataFrame:
    """One row of what a write has done: files, those assembled with blocks missing, merged ones, tiles in them, failed tiles."""
    file = F.col("kind") == "file"
    count = lambda c: F.count(F.when(c, 1))
    return written.agg(
        count(file).alias("output_tiles_written"), count(file & (F.col("empty_blocks") > 0)).alias("output_tiles_partial"), count(file & F.col("merged")).alias("output_tiles_merged"),
        F.coalesce(F.sum(F.when(file, F.col("tiles"))), F.lit(0)).alias("tiles_written"), count(~file).alias("write_failures"),
    )
