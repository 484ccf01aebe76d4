"""Command line: tile, export, retry, validate, demo, status and cost.

Exit codes: 0 fine, 1 failed, 2 a limit was met or there is no configuration.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from dataclasses import asdict
from datetime import UTC, datetime

from tilewright.operators.tiling import Grid

#: What ``demo`` exports: a ramp over a small box.
DEMO_REGION = {"type": "Polygon", "coordinates": [[[7.0, 46.0], [7.02, 46.0], [7.02, 46.02], [7.0, 46.02], [7.0, 46.0]]]}
DEMO_EXPRESSION = '{"result":"0","values":{"0":{"constantValue":1}}}'


def ramp(x, y, band):
    return x + 0.5 * y


def load_inputs(expression_file: str, region_file: str | None = None) -> tuple[str, dict | None]:
    """An expression and a region from their files, or both from a bundle with the fields expression and region."""
    with open(expression_file) as f:
        text = f.read().strip()
    try:
        tree = json.loads(text)
    except ValueError as e:
        raise ValueError(f"{expression_file} holds no JSON: {e}") from None
    bundle = isinstance(tree, dict) and "expression" in tree
    if bundle and region_file:
        raise ValueError(f"{expression_file} brings a region of its own; leave {region_file} out")
    if bundle:
        own = tree["expression"]
        return own if isinstance(own, str) else json.dumps(own), tree.get("region")
    if region_file is None:
        return text, None
    with open(region_file) as f:
        return text, json.load(f)


def snapshot_micros(text: str) -> int:
    """Digits are microseconds; else an ISO time, UTC where it names no zone."""
    if text.isdigit():
        return int(text)
    at = datetime.fromisoformat(text)
    return round((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp() * 1e6)


def exact_grid(transform: str, dimensions: str, crs: str) -> Grid:
    """From 'sx,kx,tx,ky,sy,ty' and 'WxH'."""
    a = [float(x) for x in transform.split(",")]
    w, _, h = dimensions.lower().partition("x")
    if len(a) != 6 or not w.strip().isdigit() or not h.strip().isdigit():
        raise ValueError("a transform has six numbers, dimensions look like 1024x768")
    return Grid(crs, a[0], a[2], a[4], a[5], int(w), int(h), a[1], a[3])


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tilewright")
    sub = p.add_subparsers(dest="command", required=True)

    def tiling(own, default_scale: float | None) -> None:
        own.add_argument("--scale", type=float, default=default_scale)
        own.add_argument("--crs", default="EPSG:4326")
        own.add_argument("--tile-size", type=int, default=512)
        own.add_argument("--output-tile-size", type=int)

    def source(own) -> None:
        own.add_argument("--url", required=True, help="where a tile's request is posted")
        own.add_argument("--header", action="append", default=[], help="NAME=VARIABLE: a header from a variable of the environment")

    t = sub.add_parser("tile", help="the tiles of a GeoJSON region")
    t.add_argument("region")
    t.add_argument("--output", help="a file for the list, instead of the screen")
    tiling(t, 30.0)
    e = sub.add_parser("export", help="export an expression over a region or an exact grid")
    e.add_argument("expression", help="a file with the expression, or with a bundle of expression and region")
    e.add_argument("output")
    e.add_argument("--region")
    e.add_argument("--transform", help="sx,kx,tx,ky,sy,ty of an exact grid")
    e.add_argument("--dimensions", help="WxH of an exact grid")
    e.add_argument("--nodata", type=float)
    e.add_argument("--bands", type=int, default=1)
    e.add_argument("--data-type", default="float32")
    e.add_argument("--snapshot-time", type=snapshot_micros)
    e.add_argument("--label", action="append", default=[], help="NAME=VALUE")
    e.add_argument("--dry-run", action="store_true")
    tiling(e, None)
    source(e)
    r = sub.add_parser("retry", help="try the journal's tiles again")
    r.add_argument("output")
    r.add_argument("--journal")
    r.add_argument("--max-depth", type=int, default=2)
    r.add_argument("--max-rounds", type=int, default=1)
    r.add_argument("--round-backoff", type=float, default=30.0)
    r.add_argument("--dry-run", action="store_true")
    source(r)
    v = sub.add_parser("validate", help="check an export's folder")
    v.add_argument("output")
    d = sub.add_parser("demo", help="export, then validate, a small box of made-up pixels")
    d.add_argument("output")
    s = sub.add_parser("status", help="watch a file of snapshots, a JSON object a line")
    s.add_argument("snapshots")
    s.add_argument("--tiles", type=int, default=0)
    s.add_argument("--max-runtime", type=float)
    c = sub.add_parser("cost", help="estimate an export")
    c.add_argument("tiles", type=int)
    c.add_argument("--tile-size", type=int, default=512)
    c.add_argument("--machine", default="n2-standard-4")
    return p


def pairs(given: list[str]) -> dict[str, str]:
    return dict(x.split("=", 1) for x in given)


def run(spark, args) -> int:
    from pyspark.sql import functions as F

    from tilewright.operators import costs
    from tilewright.plans import api, watch
    from tilewright.plans.meta import read_meta
    from tilewright.sources import files
    from tilewright.sources.http import HttpSource
    from tilewright.sources.pixels import Synthetic

    say = lambda x: print(json.dumps(x, default=str))
    if args.command == "tile":
        with open(args.region) as f:
            tiles = api.tile(spark, json.load(f), args.scale, args.crs, args.tile_size, args.output_tile_size)
        if args.output:
            files.write_tiles(tiles, args.output)
        else:
            for line in tiles.toJSON().toLocalIterator():
                print(line)
        return 0
    if args.command == "cost":
        c = costs.estimate(F.lit(args.tiles), F.lit(args.tile_size), F.lit("float32"), F.lit(1), F.lit(args.machine), F.lit(4), F.lit(100), F.lit(8), F.lit(False), F.lit(True))
        say(spark.range(1).select(*(x.alias(k) for k, x in c.items())).first().asDict())
        return 0
    if args.command == "status":
        with open(args.snapshots) as f:
            state = watch.poll(iter([json.loads(x) for x in f if x.strip()]).__next__, watch.Limits(max_runtime=args.max_runtime), args.tiles, pause=lambda seconds: None)
        say(asdict(state))
        return 2 if state.tripped else 0 if state.status == "done" else 1
    if args.command == "validate":
        report = api.validate(spark, args.output)
        say([asdict(c) for c in report.checks])
        return 0 if report.all_passed else 1
    if args.command == "demo":
        source = Synthetic(ramp)
        say(asdict(api.export(spark, DEMO_EXPRESSION, args.output, source, region=DEMO_REGION, scale=30.0, tile_size=64)))
        report = api.validate(spark, args.output, source)
        say([asdict(c) for c in report.checks])
        return 0 if report.all_passed else 1
    headers = {name: os.environ[variable] for name, variable in pairs(args.header).items()}
    if args.command == "export":
        expression, region = load_inputs(args.expression, args.region)
        grid = exact_grid(args.transform, args.dimensions or "", args.crs) if args.transform else None
        if grid is None and region is not None:
            from tilewright.operators import tiling

            grid_of_source = tiling.snapped_grid(region, args.crs, args.scale or 30.0, args.tile_size, args.output_tile_size)[0]
        else:
            grid_of_source = grid
        source = HttpSource(args.url, expression, grid_of_source, headers) if grid_of_source else None
        result = api.export(spark, expression, args.output, source, region=region, scale=args.scale, crs=args.crs, grid=grid, tile_size=args.tile_size, output_tile_size=args.output_tile_size, nodata=args.nodata, band_count=args.bands, data_type=args.data_type, snapshot_time=args.snapshot_time, labels=pairs(args.label), dry_run=args.dry_run)
        say(asdict(result))
        return 1 if result.failed else 0
    meta = read_meta(args.output)
    source = HttpSource(args.url, meta.expression, Grid(**meta.grid), headers)
    if args.max_rounds > 1 and not args.dry_run:
        why, results = api.retry_until_done(spark, args.output, source, args.max_rounds, args.round_backoff, args.journal, max_depth=args.max_depth)
        say({"ended": why, "rounds": [asdict(r) for r in results]})
        return 1 if results[-1].failed else 0
    result = api.retry(spark, args.output, source, args.journal, args.max_depth, args.dry_run)
    say(asdict(result))
    return 1 if result.failed else 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    try:
        return run(SparkSession.builder.getOrCreate(), args)
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return 2
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
