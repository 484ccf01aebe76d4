"""The raster engine: grids, codec, export, failure, retry, validation, and the catalog against DuckDB."""

import json
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tilewright import catalog
from tilewright.functions import geo
from tilewright.functions import tiles as fn
from tilewright.operators import costs, monitoring, retrying, tiling, validation
from tilewright.plans import api, cli, meta, pinning
from tilewright.plans.config import InputError
from tilewright.sources import files, pixels, tiff
from tilewright.streaming import monitor

SF = "/root/testdata/sf0.001"
EXPRESSION = json.dumps({"result": "0", "values": {"0": {"functionInvocationValue": {"functionName": "Image.load", "arguments": {"id": {"constantValue": "a"}}}}}})


def box(minx, miny, maxx, maxy):
    return {"type": "Polygon", "coordinates": [[[minx, miny], [maxx, miny], [maxx, maxy], [minx, maxy], [minx, miny]]]}


# Grids, counts and offsets that any implementation must give (fixed values).
@pytest.mark.parametrize("region,scale,ts,ots,want", [
    ((-122.5, 37.75, -122.25, 38.0), 30, 512, None, (1536, 1536, 9)), ((0, 0, 0.1, 0.1), 30, 512, None, (512, 512, 1)), ((0, 0, 0.1, 0.1), 30, 256, None, (512, 512, 4)),
    ((0.52, 0.32, 0.98, 0.78), 111.32, 100, 200, (600, 500, 25)), ((-122.52, 37.32, -122.06, 37.78), 90, 256, 512, (768, 1024, 9)), ((-124.4, 32.5, -114.1, 42.0), 500, 16, None, (2320, 2128, 19285)), ((-10, -5, 10, 15), 30, 512, None, (74752, 74752, 21316)),
])
def test_region_grids(spark, region, scale, ts, ots, want):
    grid, tiles = tiling.region_tiles(spark, box(*region), scale, "EPSG:4326", ts, ots)
    assert (grid.width, grid.height, tiles.count()) == want
    if want[2] == 9 and ts == 512:
        assert grid.translate_x == pytest.approx(-122.52676967301473) and grid.translate_y == pytest.approx(38.08264462809917)


def test_exact_grids(spark):
    grid = tiling.Grid("EPSG:32610", 10.0, 500000.0, -10.0, 4200000.0, 1536, 512)
    got = tiling.exact_tiles(spark, grid, 512, 1024).groupBy("out_col").count().collect()
    assert {r.out_col: r["count"] for r in got} == {0: 2, 1: 1}
    for w, h, ts, ots in ((1000, 1024, 512, None), (1024, 700, 512, None), (1024, 1024, 512, 600)):
        with pytest.raises(ValueError, match="multiple"):
            tiling.exact_tiles(spark, tiling.Grid("EPSG:32610", 10.0, 0.0, -10.0, 0.0, w, h), ts, ots)
    with pytest.raises(ValueError, match="intersect"):
        tiling.exact_tiles(spark, tiling.Grid("EPSG:32610", 10.0, 500000.0, -10.0, 4200000.0, 512, 512), 512, None, box(0, 0, 1, 1))
    with pytest.raises(ValueError, match="singular"):
        tiling.Grid("EPSG:4326", 0.0, 0.0, -1.0, 0.0, 1, 1)


def test_shifted_regions_share_tiles(spark):
    def absolute(*b):
        grid, tiles = tiling.region_tiles(spark, box(*b), 100, "EPSG:4326", 64)
        c0, r0 = round(grid.translate_x / grid.scale_x), round(grid.translate_y / grid.scale_y)
        return {(r.col_px + c0, r.row_px + r0) for r in tiles.collect()}

    a, b = absolute(0, 0, 0.5, 0.5), absolute(0.2, 0, 0.7, 0.5)
    assert len(a & b) > 20 and all(x % 64 == 0 and y % 64 == 0 for x, y in a | b)


def test_polygon_and_box():
    parts = geo.polygons({"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]], [[2, 2], [8, 2], [8, 8], [2, 8], [2, 2]]]]}})
    boxes = np.array([[3, 3, 4, 4], [1, 1, 3, 3], [10, 10, 12, 12], [10.1, 0, 11, 1], [-5, -5, 20, 20], [0.5, 0.5, 1, 1], [2, 2, 8, 8]], dtype=float)
    assert geo.intersects(parts, boxes).tolist() == [False, True, True, False, True, True, True]
    for bad in ({"type": "Point", "coordinates": [0, 0]}, {"type": "FeatureCollection", "features": []}):
        with pytest.raises(ValueError):
            geo.polygons(bad)
    with pytest.raises(ValueError):
        geo.epsg("EPSG:9999")


@pytest.mark.parametrize("dtype", ["uint8", "uint16", "int16", "int32", "float32", "float64"])
@pytest.mark.parametrize("bands", [1, 3])
@pytest.mark.parametrize("block,compression", [(None, "none"), (16, "deflate"), (8, "none")])
def test_codec_round_trip(dtype, bands, block, compression):
    a = (np.arange(32 * 48 * bands) % 251).reshape(32, 48, bands).astype(dtype)
    data = tiff.encode(a, block, compression, (2.0, -2.0), (10.0, 20.0), "-9999")
    got, at = tiff.decode(data)
    assert (got == a).all() and data[4:8] == b"\x08\0\0\0" and at.tags[tiff.NODATA][1][0] == b"-9999\0"
    assert at.tags[tiff.TIEPOINT][1][3:5] == (10.0, 20.0)


def test_codec_rejects():
    good = tiff.encode(np.zeros((16, 16), dtype="int16"), 16)
    for bad in (b"", b"nope", b"II+\0" + good[4:], good[:-3], good[:40]):
        with pytest.raises(tiff.TiffError):
            tiff.decode(bad)
    with pytest.raises(tiff.TiffError):
        tiff.encode(np.zeros((17, 16), dtype="int16"), 16)


def value(x, y, band):
    return (x * 13 + y * 7 + band) % 251


class Flaky:
    """Fails the tiles named, by (row, col), until told otherwise."""

    def __init__(self, errors):
        self.errors, self.good = errors, pixels.Synthetic(value, "int16")

    def fetch(self, tile):
        found = self.errors.get((tile["row"], tile["col"]))
        if found and tile["width_px"] >= found[2]:
            raise pixels.SourceError(found[0], found[1])
        return self.good.fetch(tile)


def quiet(seconds):
    return None


@pytest.mark.parametrize("out", [None, 64])
def test_export_retry_validate(spark, tmp_path, out):
    output = str(tmp_path / "o")
    grid = tiling.Grid("EPSG:32610", 10.0, 500000.0, -10.0, 4200000.0, 96, 64)
    errors = {(0, 0): (429, "", 0), (0, 1): (400, "User memory limit exceeded.", 32), (1, 2): (401, "no", 0)}
    r = api.export(spark, EXPRESSION, output, Flaky(errors), "p", grid=grid, tile_size=32, output_tile_size=out, data_type="int16", nodata=-9999.0, snapshot_time=1_715_000_000_000_000, attempts=2, pause=quiet)
    assert (r.tiles, r.failed) == (6, 3)
    assert validated(spark, output, errors)["integrity"] == "passed"
    r = api.retry(spark, output, Flaky({(1, 2): errors[1, 2]}), attempts=2, pause=quiet)
    assert (r.tiles, r.failed, r.carried, r.stats) == (5, 0, 1, {"retry_same": 1, "split": 1, "terminal": 1})
    lines = open(f"{output}/_failures.json").read().splitlines()
    assert len(lines) == 1 and json.loads(lines[0])["journal_reason"] == "terminal"
    edge = out or 32
    canvas = np.zeros((64, 96), dtype="int16")
    for f in files.output_files(spark, output).collect():
        px, at = tiff.decode(open(f"{output}/{f.name}", "rb").read())
        canvas[f.out_row * edge : f.out_row * edge + px.shape[0], f.out_col * edge : f.out_col * edge + px.shape[1]] = px[:, :, 0]
        assert at.tags[tiff.TIEPOINT][1][3:5] == (500000.0 + f.out_col * edge * 10, 4200000.0 - f.out_row * edge * 10)
    y, x = np.mgrid[0:64, 0:96]
    want = value(x, y, 0).astype("int16")
    want[32:64, 64:96] = 0
    assert (canvas == want).all()
    assert validated(spark, output, {(1, 2): errors[1, 2]}) == {"integrity": "passed", "pixels": "passed"}
    why, rounds = api.retry_until_done(spark, output, Flaky({}), pause_between=quiet)
    assert why == "no_retryable_work" and len(rounds) == 1
    with pytest.raises(meta.MetaMismatch, match="tile_size"):
        api.retry(spark, output, Flaky({}), tile_size=64)
    (tmp_path / "o" / "tile_r0099_c0099.tif").write_bytes(b"II*\0" + bytes(2000))
    assert validated(spark, output, {})["integrity"] == "failed"


def validated(spark, output, errors):
    return {c.name: c.status for c in api.validate(spark, output, Flaky(errors)).checks}


def test_export_rejects(spark, tmp_path):
    bad = EXPRESSION.replace("Image.load", "Collection.map")
    for kwargs in ({"expression": bad, "region": box(0, 0, 1, 1)}, {"expression": "{", "region": box(0, 0, 1, 1)}, {"expression": EXPRESSION}, {"expression": EXPRESSION, "region": {"type": "Point"}}):
        with pytest.raises(InputError):
            api.export(spark, output=str(tmp_path), source=None, **kwargs)


def test_pinning():
    call = lambda name, **a: json.dumps({"result": "0", "values": {"0": {"functionInvocationValue": {"functionName": name, "arguments": a}}}})
    once = pinning.pin(EXPRESSION, 5)
    assert '"version":{"constantValue":5}' in once and pinning.pin(once, 5) == once and '"constantValue":5' in pinning.pin(once, 9)
    for bad in (call("FeatureCollection.loadBigQuery"), call("FeatureCollection.runBigQuery", query={"constantValue": "select 1"})):
        with pytest.raises(pinning.PinningError):
            pinning.pin(bad, 5)
    pinning.pin(call("FeatureCollection.runBigQuery", query={"constantValue": "select 1 for system_time as of x"}), 5)
    for t in (0, -1, 10**17 + 1):
        with pytest.raises(pinning.PinningError):
            pinning.pin(EXPRESSION, t)
    with pytest.warns(UserWarning):
        pinning.pin(call("Image.loadGeoTIFF"), 5)


def test_classifier_twins_agree(spark):
    cases = [(s, b) for s in (-1, 200, 400, 401, 403, 404, 429, 500, 503, 504) for b in ("", "User memory limit exceeded.", "Earth memory capacity exceeded", "Computation timed out.", "DEADLINE EXCEEDED", "credential", "AUTH", "memory limit timed out")]
    df = spark.createDataFrame(cases, "status int, body string").select("*", fn.error_kind(F.col("status"), F.col("body")).alias("k"))
    assert all(r.k == pixels.classify(r.status, r.body) for r in df.collect())
    assert pixels.classify(400, "memory limit timed out") == "MEMORY_EXCEEDED" and pixels.classify(500, "deadline exceeded") == "RETRYABLE_SERVER"


def test_fetch_budget():
    now = [0.0]
    waits = []

    class Busy:
        def fetch(self, tile):
            raise pixels.SourceError(503, "upstream")

    def pause(s):
        waits.append(s)
        now[0] += s

    r = pixels.fetch_one(Busy(), {}, 6, 180.0, pause, lambda: now[0])
    assert r["error_kind"] == "RETRYABLE_SERVER" and r["attempts"] == 6 and len(waits) == 5
    assert all(b <= w <= 1.2 * b for w, b in zip(waits, (2, 4, 8, 10, 10), strict=True))


def test_retry_plan(spark):
    kinds = [("MEMORY_EXCEEDED", []), ("RATE_LIMITED", []), ("AUTH_ERROR", []), ("MEMORY_EXCEEDED", [0, 1]), ("SOMETHING_NEW", [])]
    lines = [(json.dumps({"col_px": 0, "row_px": 0, "width_px": 100, "height_px": 100, "row": 7, "col": 11, "lineage": li, "error_kind": k, "attempts": 5}),) for k, li in kinds] + [("",)]
    journal = files.parse_journal(spark.createDataFrame(lines, "value string"))
    p = retrying.plan(journal)
    assert {r.action: r.n for r in p.stats.collect()} == {"split": 1, "retry_same": 1, "terminal": 1, "depth_cap": 1, "unknown_kind": 1}
    tiles = {tuple(r.lineage): (r.col_px, r.row_px, r.width_px, r.row, r.out_col) for r in p.next_tiles.collect()}
    assert tiles == {(): (0, 0, 100, 7, 11), (0,): (0, 50, 50, 7, 11), (1,): (50, 50, 50, 7, 11), (2,): (0, 0, 50, 7, 11), (3,): (50, 0, 50, 7, 11)}
    assert sorted(r.journal_reason for r in p.carryover.collect()) == ["depth_cap", "terminal", "unknown_kind"]


def test_journal_reading(spark, tmp_path):
    good = '{"col_px":0,"row_px":0,"width_px":1,"height_px":1,"row":1,"col":2,"more":3}'
    path = tmp_path / "j.json"
    path.write_text(good + "\n\n")
    assert files.read_journal(spark, str(path)).count() == 1
    for bad in ("{", '{"row":1}', "[1]"):
        path.write_text(good + "\n" + bad + "\n")
        with pytest.raises(files.JournalParseError):
            files.read_journal(spark, str(path))
    assert {tuple(r) for r in files.failure_keys(spark, str(path)).collect()} == {(1, 2)}


def test_sampling(spark):
    df = spark.range(100).toDF("k")
    pick = lambda n: sorted(r.k for r in validation.sample_evenly(df, ["k"], n).collect())
    assert pick(20) == [0, 5, 10, 16, 21, 26, 31, 36, 42, 47, 52, 57, 63, 68, 73, 78, 83, 89, 94, 99]
    assert pick(0) == [] and pick(1) == [0] and pick(200) == list(range(100))


def test_costs_and_watchdog(spark):
    c = costs.estimate(F.lit(1000), F.lit(512), F.lit("float32"), F.lit(1), F.lit("n2-standard-4"), F.lit(4), F.lit(100), F.lit(8), F.lit(True), F.lit(True))
    r = spark.range(1).select(*(x.alias(k) for k, x in c.items())).first()
    assert r.usd_low == pytest.approx(0.06106, rel=1e-3) and r.usd_high == pytest.approx(0.07569, rel=1e-3)
    assert r.shuffle_usd == pytest.approx(1000 * 512**2 * 4 / 1e9 * 0.011)
    s = spark.createDataFrame([("j", 0, 1000, 1), ("j", 600, 1000, 2), ("j", 1200, 1000, 2)], "job string, t bigint, a bigint, b bigint")
    assert [x.trips for x in monitoring.idle(s, "job", "t", ["a", "b"], 300).orderBy("t").collect()] == [False, False, True]
    m = spark.createDataFrame([("j", 1, "Quota. zone a"), ("j", 2, "Workflow failed."), ("j", 3, "Quota. zone bb"), ("j", 4, "Workflow failed. Causes: x")], "job string, n bigint, t string")
    assert {x.message for x in monitoring.failure_summary(m, "job", "n", "t").collect()} == {"Quota. zone bb", "Workflow failed. Causes: x"}


def test_number_texts(spark):
    rng = random.Random(1)
    xs = [rng.randrange(0, 10**7) / rng.choice([1, 2, 4, 8, 10, 20, 60, 100, 1024]) for _ in range(2000)] + [0.25, 0.35, 2.5, 16.95, 0.5, 1.5, 999.995, 1.005]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", *(fn.fixed(F.col("x"), d).alias(f"d{d}") for d in (0, 1, 2)), fn.usd_text(F.col("x")).alias("usd")).collect()
    for r in got:
        assert (r.d0, r.d1, r.d2) == (f"{r.x:.0f}", f"{r.x:.1f}", f"{r.x:.2f}")
        assert r.usd == ("<$0.01" if 0 < r.x < 0.005 else f"${r.x:,.2f}")


def test_command_line_parts():
    assert cli.snapshot_micros("1715000000000000") == 1715000000000000
    assert cli.snapshot_micros("2026-04-30T12:00:00Z") == cli.snapshot_micros("2026-04-30T12:00:00") == cli.snapshot_micros("2026-04-30T14:00:00+02:00")
    g = cli.exact_grid("10,0,500000,0,-10,4200000", "1024x512", "EPSG:32610")
    assert (g.width, g.height, g.scale_y) == (1024, 512, -10.0)
    for bad in (("1,2", "1x1"), ("1,0,0,0,-1,0", "1")):
        with pytest.raises(ValueError):
            cli.exact_grid(*bad, "EPSG:4326")


def test_journal_stream_agrees_with_batch(spark, tmp_path):
    rows = [{"row": i, "error_kind": "UNKNOWN" if i % 3 else "AUTH_ERROR", "last_seen": f"2026-01-01T00:{i:02d}:00Z"} for i in range(30)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    monitor.run_once(monitor.by_window(monitor.failures(spark, str(tmp_path / "in"))), "seen", str(tmp_path / "c")).awaitTermination()
    got = {(r.window.start.minute, r.error_kind): r.n for r in spark.table("seen").collect()}
    want = {}
    for i, r in enumerate(rows):
        want[i // 10 * 10, r["error_kind"]] = want.get((i // 10 * 10, r["error_kind"]), 0) + 1
    assert got == want


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_catalog_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(f"select {', '.join(columns)} from ({catalog.SQL[name]})").fetchall()
    assert sorted(tuple(map(plain, r)) for r in df.select(*columns).collect()) == sorted(tuple(map(plain, r)) for r in want)


def test_formats_equal_sql_on_odd_orders(spark, tmp_path):
    """Products just under a whole number of bytes at a rounding limit; ties; null, negative, tiny and large prices; null and negative keys."""
    limits = [(8298692, 147971.55), (6419409, 328711.1), (1596075, 155975.68), (7665832, 165666.27), (952862, 131543.86), (3148659, 87678.43)]
    odd = [(k, x) for k in (-10, -1, 0, 1, 2, 3, 59, 3600, 2**62) for x in (None, -952.27, -1.0, -0.25, 0.0, 0.0005, 0.0025, 0.25, 1.28, 134217.728, 671088.64, 12345678901.5)] + [(None, 5.5), (None, None)]
    spark.createDataFrame(limits + odd, "o_orderkey bigint, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.sql(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    got, want = catalog.QUERIES["format_bytes_duration_usd"](spark, str(tmp_path)), con.sql(catalog.SQL["format_bytes_duration_usd"])
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(want.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_ranks_of_many_wide_rows(spark):
    n = 1_500_000
    df = spark.range(n).select(F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("k"), F.col("id"), F.repeat(F.lit("x"), 60).alias("wide"), F.sha2(F.col("id").cast("string"), 256).alias("wider"))
    ranked = validation.with_rank(df, ["k", "id"])
    got = ranked.agg(F.count("*").alias("n"), F.countDistinct("rank").alias("d"), F.min("rank").alias("low"), F.max("rank").alias("high")).first()
    assert tuple(got) == (n, n, 0, n - 1)
    back = ranked.select((F.col("k") * 1.0).alias("a"), "rank").orderBy("rank")
    assert back.where("rank % 1000 = 0").count() == n // 1000
    order = ranked.stat.corr("rank", "k")
    assert order > 0.999
    chosen = [r.id for r in validation.sample_evenly(df, ["k", "id"], 37).collect()]
    keys = np.sort(np.array([tuple(r) for r in df.select("k", "id").toPandas().itertuples(index=False)], dtype="i8,i8"))
    want = {int(keys[int(np.rint(i * ((n - 1) / 36)))][1]) for i in range(37)}
    assert set(chosen) == want


def test_even_samples_of_every_size(spark):
    for n, k in ((1, 5), (5, 5), (7, 3), (100, 99), (101, 2), (50, 1), (0, 3)):
        got = sorted(r.id for r in validation.sample_evenly(spark.range(n), ["id"], k).collect())
        want = sorted({int(np.rint(i * ((n - 1) / (k - 1)))) for i in range(k)}) if n > k > 1 else list(range(min(n, k)))
        assert got == want, (n, k)


TRIANGLE = {"type": "Polygon", "coordinates": [[[0.0, 0.0], [0.3, 0.0], [0.0, 0.3], [0.0, 0.0]]]}


def slope(x, y, band):
    return x - 2.0 * y


def test_region_export_validates_and_files_name_their_system(spark, tmp_path):
    out, source = str(tmp_path / "o"), pixels.Synthetic(slope)
    done = api.export(spark, EXPRESSION, out, source, region=TRIANGLE, scale=500.0, tile_size=16, pause=no_wait)
    grid = tiling.Grid(**meta.read_meta(out).grid)
    assert 0 < done.tiles < grid.width * grid.height // 256 and done.failed == 0
    report = api.validate(spark, out, source)
    assert report.all_passed, report
    names = sorted(p.name for p in (tmp_path / "o").glob("tile_*.tif"))
    assert len(names) == done.files == done.tiles
    data = (tmp_path / "o" / names[0]).read_bytes()
    assert tiff.epsg_of(tiff.read_layout(data).tags) == 4326
    assert cli.main(["validate", out]) == 0
    pixels_of, layout = tiff.decode(data)
    origin = layout.tags[tiff.TIEPOINT][1][3:5]
    (tmp_path / "o" / names[0]).write_bytes(tiff.encode(pixels_of, 16, "deflate", (grid.scale_x, grid.scale_y), origin, None, tiff.geo_keys(3857, False)))
    bad = api.validate(spark, out).checks[0]
    assert bad.status == "failed" and bad.details[0]["detail"] == "CRS EPSG:3857, expected EPSG:4326"
    (tmp_path / "o" / names[1]).unlink()
    assert cli.main(["validate", out]) == 1 and cli.main(["validate", str(tmp_path / "none")]) == 2


def test_source_tags_are_carried_over(spark):
    keys = {**tiff.geo_keys(32632, False), 270: (2, (b"about\0",))}
    data = tiff.encode(np.zeros((8, 8), dtype="int16"), extra=keys)
    canvas, _, layout = __import__("tilewright.operators.assembly", fromlist=["assemble"]).assemble([{"payload": data, "lineage": [], "row_px": 0, "col_px": 0, "height_px": 8, "width_px": 8}], (0, 0), tiling.Grid("EPSG:4326", 1.0, 0.0, -1.0, 0.0, 8, 8), 8, 8, None)
    from tilewright.operators.assembly import tags_of

    own = tags_of(tiling.Grid("EPSG:4326", 1.0, 0.0, -1.0, 0.0, 8, 8), layout)
    assert tiff.epsg_of(own) == 32632 and own[270][1] == (b"about\0",) and tiff.WIDTH not in own


def no_wait(seconds):
    return None


class Twice:
    """Fails for some tiles with a fatal error."""

    def fetch(self, tile):
        if (tile["row"] + tile["col"]) % 3 == 0:
            raise pixels.SourceError(400, "Invalid expression")
        return tiff.encode(np.ones((tile["height_px"], tile["width_px"]), dtype="float32"))


def test_carried_lines_keep_fields_of_others(spark, tmp_path):
    out = str(tmp_path / "o")
    done = api.export(spark, EXPRESSION, out, Twice(), region=box(0, 0, 0.3, 0.3), scale=500.0, tile_size=16, pause=no_wait)
    path = tmp_path / "o" / "_failures.json"
    lines = [json.loads(x) for x in path.read_text().splitlines()]
    assert len(lines) == done.failed > 2
    lines[0] |= {"note": {"by": "someone", "n": [1, 2.50]}}
    lines[1] |= {"error_kind": "RATE_LIMITED"}
    del lines[2]["journal_reason"]
    path.write_text("\n".join(map(json.dumps, lines)))
    again = api.retry(spark, out, Twice(), pause=no_wait)
    assert again.tiles == 1 and again.carried == len(lines) - 1
    after = {(x["row"], x["col"]): x for x in map(json.loads, path.read_text().splitlines())}
    first, third = after[lines[0]["row"], lines[0]["col"]], after[lines[2]["row"], lines[2]["col"]]
    assert first == lines[0] | {"journal_reason": "terminal"} and third == lines[2] | {"journal_reason": "terminal"}
    assert len(after) == len(lines) and not (tmp_path / "o" / "_staging").exists() or not list((tmp_path / "o" / "_staging").glob("*/whole"))


def test_tile_lists_round_trip(spark, tmp_path):
    grid = tiling.Grid("EPSG:4326", 0.1, 0.0, -0.1, 0.0, 32, 32)
    tiles = tiling.grid_tiles(spark, grid, 8, 16)
    files.write_tiles(tiles, str(tmp_path / "_tiles.ndjson"))
    got = files.read_tiles(spark, str(tmp_path / "_tiles.ndjson"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, tiles.collect()), key=str)
    (tmp_path / "few.json").write_text('{"col_px":0,"row_px":8,"width_px":8,"height_px":8,"row":1,"col":0,"more":1}\n')
    r = files.read_tiles(spark, str(tmp_path / "few.json")).first()
    assert (r.out_row, r.out_col, r.lineage) == (1, 0, [])
    (tmp_path / "bad.json").write_text("{oops\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_tiles(spark, str(tmp_path / "bad.json")).collect()


@pytest.fixture
def service():
    """A stub that answers requests as a GeoTIFF or as arrays, and refuses some."""
    import io
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    seen = []

    class Answer(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((asked, self.headers.get("X-Key")))
            size, at = asked["grid"]["dimensions"], asked["grid"]["affineTransform"]
            status, data = 200, b""
            a = np.full((size["height"], size["width"]), at["translateX"], dtype="float64")
            if self.path == "/closed":
                status, data = 401, b"x" * 300 + b" login needed"
            elif self.path == "/busy":
                status, data = (429, b"slow down") if len(seen) < 3 else (200, tiff.encode(a))
            elif asked["fileFormat"] == "NPY":
                f = io.BytesIO()
                np.save(f, np.array(list(zip(a.ravel(), 2 * a.ravel(), strict=True)), dtype=[("b1", "f8"), ("b2", "f8")]).reshape(a.shape))
                data = f.getvalue()
            else:
                data = tiff.encode(a)
            self.send_response(status)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            return None

    server = ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen
    server.shutdown()


def test_http_source(spark, service, tmp_path):
    from tilewright.sources import http

    url, seen = service
    grid = tiling.Grid("EPSG:3857", 0.5, 100.0, -0.5, 900.0, 32, 16)
    tile = tiling.grid_tiles(spark, grid, 8).where("row = 1 and col = 2").first().asDict()
    a, _ = tiff.decode(http.HttpSource(f"{url}/", EXPRESSION, grid, {"X-Key": "k"}).fetch(tile))
    assert (a == 108.0).all() and seen[-1][1] == "k"
    assert seen[-1][0] == {"expression": json.loads(EXPRESSION), "fileFormat": "GEO_TIFF", "grid": {"dimensions": {"width": 8, "height": 8}, "affineTransform": {"scaleX": 0.5, "shearX": 0.0, "translateX": 108.0, "shearY": 0.0, "scaleY": -0.5, "translateY": 896.0}, "crsCode": "EPSG:3857"}}
    own = tiling.grid_tiles(spark, grid, 8).where("row = 1 and col = 2")
    column = own.select(http.request_body(EXPRESSION, grid, F.col("col_px"), F.col("row_px"), F.col("width_px"), F.col("height_px"))).first()[0]
    assert json.loads(column) == seen[-1][0]
    b, _ = tiff.decode(http.HttpSource(f"{url}/", EXPRESSION, grid, None, "NPY").fetch(tile))
    assert b.shape == (8, 8, 2) and (b[..., 1] == 216.0).all()
    with pytest.raises(pixels.SourceError, match="refused the credentials.*login needed") as e:
        http.HttpSource(f"{url}/closed", EXPRESSION, grid).fetch(tile)
    assert pixels.classify(e.value.status, e.value.body) == "AUTH_ERROR"
    seen.clear()
    r = pixels.fetch_one(http.HttpSource(f"{url}/busy", EXPRESSION, grid), tile, 6, 60.0, no_wait, lambda: 0.0)
    assert r["payload"] and r["attempts"] == 3
    (tmp_path / "e.json").write_text(json.dumps({"expression": json.loads(EXPRESSION), "region": box(0, 0, 0.1, 0.1)}))
    assert cli.main(["export", str(tmp_path / "e.json"), str(tmp_path / "o"), "--url", f"{url}/", "--scale", "500", "--tile-size", "8", "--data-type", "float64", "--label", "team=a"]) == 0
    assert cli.main(["validate", str(tmp_path / "o")]) == 0 and meta.read_meta(str(tmp_path / "o")).labels == {"team": "a"}
    assert cli.main(["retry", str(tmp_path / "o"), "--url", f"{url}/"]) == 0
    with pytest.raises(ValueError, match="region of its own"):
        cli.load_inputs(str(tmp_path / "e.json"), "r.json")


def test_array_payloads():
    from tilewright.sources.http import bands_first

    assert bands_first(np.zeros((4, 6)), (4, 6)).shape == (1, 4, 6)
    assert bands_first(np.zeros((3, 4, 6)), (4, 6)).shape == (3, 4, 6) == bands_first(np.zeros((4, 6, 3)), (4, 6)).shape
    with pytest.raises(ValueError, match="holds no tile"):
        bands_first(np.zeros((5, 5)), (4, 6))


def test_watching_a_job(tmp_path):
    from tilewright.plans import watch

    def snaps(*rows):
        return iter([{"status": s, "elapsed": t, "counters": {"tiles_written": n, "failures_written": f}} for s, t, n, f in rows]).__next__

    quick = dict(pause=no_wait, tiles=10)
    seen, stopped = [], []
    assert watch.poll(snaps(("running", 0, 0, 0), ("running", 60, 5, 0), ("done", 90, 10, 0)), callback=seen.append, **quick).status == "done" and len(seen) == 3
    state = watch.poll(snaps(("running", 0, 0, 0), ("running", 700, 3, 6)), cancel=lambda: stopped.append(1), **quick)
    assert "6 of 10" in state.tripped and stopped == [1]
    assert "moved" in watch.poll(snaps(("running", 0, 1, 0), ("running", 900, 2, 0), ("running", 2000, 1, 0), ("running", 2200, 2, 0)), **quick).tripped
    assert "runs for" in watch.poll(snaps(("running", 100_000, 1, 0)), **quick).tripped
    (tmp_path / "s").write_text('{"status":"running","elapsed":5,"counters":{}}\n{"status":"failed","elapsed":9}\n')
    assert cli.main(["status", str(tmp_path / "s")]) == 1


def test_demo(spark, tmp_path, capsys):
    assert cli.main(["demo", str(tmp_path / "d")]) == 0
    assert '"passed"' in capsys.readouterr().out


def test_results_of_broken_expressions():
    from tilewright.plans.config import input_errors, result_function

    for tree in ({"values": [1], "result": "0"}, {"values": {"0": 3}, "result": "0"}, {"result": {}}, [], 3, None, {"values": {"0": {"functionInvocationValue": []}}, "result": "0"}):
        assert result_function(json.dumps(tree)) is None and input_errors(json.dumps(tree), None, None) == []


class Shaped:
    __geo_interface__ = {"type": "Polygon", "coordinates": [[[0, 0], [0.1, 0], [0.1, 0.1], [0, 0.1], [0, 0]]]}


def test_regions_by_interface(spark):
    assert api.tile(spark, Shaped(), 500.0, tile_size=16).count() == api.tile(spark, box(0, 0, 0.1, 0.1), 500.0, tile_size=16).count() > 0


def test_object_store_paths(tmp_path):
    from tilewright.sources import store

    store.put(f"file://{tmp_path}/a/b", "x", b"1")
    store.put(f"{tmp_path}/a/b", "x", b"22")
    assert store.read(f"file://{tmp_path}/a/b/x") == b"22" and store.exists(f"{tmp_path}/a/b/x") and not store.exists(f"file:{tmp_path}/a/c")
    assert [p.name for p in (tmp_path / "a" / "b").iterdir()] == ["x"]
