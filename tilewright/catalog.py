"""Queries of the raster engine over the supplied tables, with their DuckDB counterparts.

The tables stand in for the engine's own: each vector of ``embeddings`` is one 8 x 8 tile of floats, laid out
25 to a row; ``events`` are fetch attempts, journal rows and metric snapshots; balances (negative too) are
map coordinates; ``orders`` and ``lineitem`` are expected and found files; ``documents`` are messages.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import tiles as fn
from tilewright.operators import assembly, costs, monitoring, retrying, tiling, validation
from tilewright.plans.config import COLLECTIONS, gives_collection, result_function_column
from tilewright.sources import files, http, pixels, store, tiff

TS, OTS, ACROSS = 8, 32, 25
P = 0.25
CONSTANT = '{"result":"0","values":{"0":{"constantValue":1}}}'
GRID = {"scale_x": 0.5, "shear_x": 0.125, "translate_x": 100.0, "shear_y": 0.0625, "scale_y": -0.5, "translate_y": 900.0}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def big(*pairs) -> list:
    return [(F.col(c) if isinstance(c, str) else c).cast("bigint").alias(n) for c, n in pairs]


def embedding_tiles(spark, sf_dir, *more: str) -> DataFrame:
    """Tiles of the embeddings: row and col by number, 8 px, output tiles of 32 px, no lineage."""
    e = table(spark, sf_dir, "embeddings")
    row, col = F.floor(F.col("vec_id") / ACROSS), F.pmod("vec_id", F.lit(ACROSS))
    i = lambda x: x.cast("int")
    return e.select(
        i(col * TS).alias("col_px"), i(row * TS).alias("row_px"), F.lit(TS).alias("width_px"), F.lit(TS).alias("height_px"), i(row).alias("row"), i(col).alias("col"), i(F.floor(row * TS / OTS)).alias("out_row"), i(F.floor(col * TS / OTS)).alias("out_col"), F.array().cast("array<int>").alias("lineage"), *more,
    )


def mosaic_grid(spark, sf_dir, step: int = TS) -> tiling.Grid:
    """The grid of the embeddings' tiles, edges up to whole multiples of ``step``; one row where there are none."""
    last = table(spark, sf_dir, "embeddings").agg(F.coalesce(F.max("vec_id"), F.lit(0))).first()[0]
    up = lambda n: -(-n // step) * step
    return tiling.Grid("EPSG:3857", 0.5, 100.0, -0.5, 900.0, up(ACROSS * TS), up((last // ACROSS + 1) * TS))


def bounded_tiles(spark, sf_dir) -> DataFrame:
    t = embedding_tiles(spark, sf_dir, "vec_id")
    return t.select("vec_id", *(v.alias(k) for k, v in fn.tile_bbox(GRID, F.col("col_px"), F.col("row_px"), F.col("width_px"), F.col("height_px")).items()))


def ring(*corners) -> list:
    return [[np.array([*corners, corners[0]], dtype=float)]]


def keyed(rows: DataFrame, key: str) -> DataFrame:
    """Rows as output files: the key as out_row of a single column."""
    return rows.select(F.col(key).alias("out_row"), F.lit(0).alias("out_col"))


def stored_tiles(spark, sf_dir) -> DataFrame:
    """The embeddings as fetched tiles (with vec_id), encoded in Arrow batches."""
    t = embedding_tiles(spark, sf_dir, "vec_id", "embedding")
    names = [c for c in t.columns if c != "embedding"]

    def run(batches):
        for b in batches:
            data = [tiff.encode(np.array(v, dtype="float32").reshape(TS, TS)) for v in b.column("embedding").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(data, pa.binary())], [*names, "payload"])

    return t.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in t.drop("embedding").dtypes) + ", payload binary")


def covered(members: list[dict], key: tuple[int, int]) -> np.ndarray:
    """The pixels of an output tile that its members cover."""
    out = np.zeros((OTS, OTS), dtype=bool)
    for m in members:
        y, x = m["row_px"] - key[0] * OTS, m["col_px"] - key[1] * OTS
        out[y : y + m["height_px"], x : x + m["width_px"]] = True
    return out


def canvases(spark, sf_dir, tiles: DataFrame, stats: Callable, schema: str) -> DataFrame:
    """out_row, out_col and what ``stats`` (key, members, grid) gives for each output tile."""
    grid = mosaic_grid(spark, sf_dir, OTS)
    own = "out_row bigint, out_col bigint, " + schema
    names = [x.split(" ")[0] for x in own.split(", ")]

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        members = [{**r, "lineage": list(r["lineage"])} for r in frame.to_dict("records")]
        key = int(key[0]), int(key[1])
        return pd.DataFrame([(*key, *r) for r in stats(key, members, grid)], columns=names)

    return tiles.groupBy("out_row", "out_col").applyInPandas(run, own)


def mosaic(spark, sf_dir, tiles: DataFrame) -> DataFrame:
    """Result rows of an export of the tiles to files in the folder that executors share."""
    return store.stage(assembly.write_assembled(tiles, folder(spark, "mosaic"), mosaic_grid(spark, sf_dir), TS, OTS))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports the embeddings' mosaic to output tiles and reports each file: members, empty blocks, checksum."""
    written = mosaic(spark, sf_dir, stored_tiles(spark, sf_dir))
    return written.select("kind", "out_row", "out_col", "tiles", "empty_blocks", F.round("checksum", 3).alias("checksum"))


TILES = "select vec_id, label, embedding, vec_id // 25 as r, vec_id % 25 as c, (vec_id // 25) * 8 // 32 as o_r, (vec_id % 25) * 8 // 32 as o_c from embeddings"
STATUS_SQL = "case event_type when 'click' then 400 when 'error' then 503 when 'purchase' then 429 when 'signup' then 403 else 500 end"
BODY_SQL = "case cast(user_id % 4 as int) when 0 then 'User memory limit exceeded.' when 1 then 'Computation timed out.' when 2 then 'credential expired' else 'Invalid expression' end"
EVENT_COLUMNS = f"event_id, user_id, ts, value, {STATUS_SQL} as status, {BODY_SQL} as body, cast(user_id % 3 as int) as depth, cast(event_id % 40 as int) * 8 as c_px, cast(event_id % 30 as int) * 8 as r_px"
KIND_SQL = "case when status = 400 and (contains(lower(body), 'memory limit') or contains(lower(body), 'memory capacity')) then 'MEMORY_EXCEEDED' when status = 400 and (contains(lower(body), 'timed out') or contains(lower(body), 'deadline exceeded')) then 'COMPUTATION_TIMEOUT' when status = 400 then 'FATAL_REQUEST' when status = 429 then 'RATE_LIMITED' when status = 401 then 'AUTH_ERROR' when status = 403 and (contains(lower(body), 'auth') or contains(lower(body), 'credential')) then 'AUTH_ERROR' when status in (403, 404) then 'FATAL_REQUEST' when status between 500 and 599 then 'RETRYABLE_SERVER' else 'UNKNOWN' end"
ACTION_SQL = "case when kind in ('MEMORY_EXCEEDED', 'COMPUTATION_TIMEOUT') and depth < 2 then 'split' when kind in ('MEMORY_EXCEEDED', 'COMPUTATION_TIMEOUT') then 'depth_cap' when kind in ('RATE_LIMITED', 'RETRYABLE_SERVER', 'UNKNOWN') then 'retry_same' when kind in ('FATAL_REQUEST', 'AUTH_ERROR') then 'terminal' else 'unknown_kind' end"
JOURNAL_SQL = f"with e as (select {EVENT_COLUMNS} from events), k as (select *, {KIND_SQL} as kind from e), j as (select *, {ACTION_SQL} as action from k)"


def events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*[x.strip() for x in ("event_id", "user_id", "ts", "value", f"{STATUS_SQL} as status", f"{BODY_SQL} as body", "cast(user_id % 3 as int) as depth", "cast(event_id % 40 as int) * 8 as c_px", "cast(event_id % 30 as int) * 8 as r_px")])


def journal(spark, sf_dir) -> DataFrame:
    """Events as journal rows: a 8 px tile each, lineage of ``depth`` zeros."""
    e = events(spark, sf_dir)
    return e.select(
        "event_id", F.col("c_px").alias("col_px"), F.col("r_px").alias("row_px"), F.lit(TS).alias("width_px"), F.lit(TS).alias("height_px"), F.expr("r_px div 8").cast("int").alias("row"), F.expr("c_px div 8").cast("int").alias("col"), F.expr("r_px div 32").cast("int").alias("out_row"), F.expr("c_px div 32").cast("int").alias("out_col"),
        F.array_repeat(F.lit(0), F.col("depth")).alias("lineage"), fn.error_kind(F.col("status"), F.col("body")).alias("error_kind"), F.col("body").alias("error_message"), F.col("status").alias("http_status"), F.lit(1).alias("attempts"), F.col("ts").cast("string").alias("first_seen"), F.col("ts").cast("string").alias("last_seen"), F.lit("failed").alias("journal_reason"),
    )


@query("select r.i as row_id, c.i as col_id, c.i * 8 as col_px, r.i * 8 as row_px, r.i * 8 // 32 as out_row, c.i * 8 // 32 as out_col from (select distinct vec_id // 25 as i from embeddings) r, (select distinct vec_id % 25 as i from embeddings) c")
def tile_grid_exact(spark, sf_dir):
    return tiling.grid_tiles(spark, mosaic_grid(spark, sf_dir), TS, OTS).select(*big(("row", "row_id"), ("col", "col_id"), ("col_px", "col_px"), ("row_px", "row_px"), ("out_row", "out_row"), ("out_col", "out_col")))


@query("""with b as (select c_custkey, least(c_acctbal, c_acctbal + 100) x0, c_acctbal + 37.5 x1, -c_acctbal y0, -c_acctbal + 12.25 y1 from customer)
select c_custkey, cast(floor(floor(x0 / 0.25) / 32.0) * 32 as bigint) col_start, cast(ceil(ceil(x1 / 0.25) / 8.0) * 8 as bigint) col_end, cast(floor(floor(-y1 / 0.25) / 32.0) * 32 as bigint) row_start, cast(ceil(ceil(-y0 / 0.25) / 8.0) * 8 as bigint) row_end from b""")
def tile_grid_snap(spark, sf_dir):
    b = table(spark, sf_dir, "customer").selectExpr("c_custkey", "least(c_acctbal, c_acctbal + 100) x0", "c_acctbal + 37.5 x1", "-c_acctbal y0", "-c_acctbal + 12.25 y1")
    s = fn.snap(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), P, TS, OTS)
    return b.select("c_custkey", *big(*((v, k) for k, v in s.items())))


@query(f"with t as ({TILES}) select o_r as out_row, o_c as out_col, count(*) as n from t group by all")
def two_tier_keys(spark, sf_dir):
    return embedding_tiles(spark, sf_dir).groupBy(*big(("out_row", "out_row"), ("out_col", "out_col"))).agg(F.count("*").alias("n"))


@query(f"with t as ({TILES}) select vec_id, 100.0::double + c * 8 * 0.5::double as xmin, 900.0::double + (r * 8 + 8) * (-0.5)::double as ymin, 100.0::double + (c * 8 + 8) * 0.5::double as xmax, 900.0::double + r * 8 * (-0.5)::double as ymax from t")
def tile_bbox(spark, sf_dir):
    t = embedding_tiles(spark, sf_dir, "vec_id")
    return t.select("vec_id", *(v.alias(k) for k, v in fn.tile_bbox(GRID, F.col("col_px"), F.col("row_px"), F.col("width_px"), F.col("height_px")).items()))


@query(f"with t as ({TILES}) select vec_id, 100.0::double + c * 8 * 0.5::double + r * 8 * 0.125::double as translate_x, 900.0::double + c * 8 * 0.0625::double + r * 8 * (-0.5)::double as translate_y from t")
def tile_affine_shear(spark, sf_dir):
    t = embedding_tiles(spark, sf_dir, "vec_id")
    return t.select("vec_id", *(v.alias(k) for k, v in fn.tile_affine(GRID, F.col("col_px"), F.col("row_px")).items()))


@query(f"with t as ({TILES}), b as (select vec_id, 100.0::double + c * 8 * 0.5 x0, 900.0::double - (r * 8 + 8) * 0.5 y0, 100.0::double + (c * 8 + 8) * 0.5 x1, 900.0::double - r * 8 * 0.5 y1 from t) select vec_id from b where x0 <= 152 and x1 >= 112 and y0 <= 896 and y1 >= 868")
def region_filter_bbox(spark, sf_dir):
    return tiling.meeting(bounded_tiles(spark, sf_dir), ring((112, 868), (152, 868), (152, 896), (112, 896))).select("vec_id")


#: A convex region (a triangle) for the separating-axis filter: its corners.
TRIANGLE = ((110.0, 895.0), (190.0, 880.0), (130.0, 840.0))


@query("with t as (" + TILES + """), b as (select vec_id, 100.0::double + c * 8 * 0.5 x0, 900.0::double - (r * 8 + 8) * 0.5 y0, 100.0::double + (c * 8 + 8) * 0.5 x1, 900.0::double - r * 8 * 0.5 y1 from t),
e(ax, ay, bx, b_y) as (values (110.0::double, 895.0::double, 190.0::double, 880.0::double), (190.0, 880.0, 130.0, 840.0), (130.0, 840.0, 110.0, 895.0)),
p(px, py) as (values (110.0::double, 895.0::double), (190.0, 880.0), (130.0, 840.0)),
ax as (select e.*, -(b_y - ay) nx, (bx - ax) ny, (select min(-(b_y - ay) * px + (bx - ax) * py) from p) lo, (select max(-(b_y - ay) * px + (bx - ax) * py) from p) hi from e)
select b.vec_id from b, ax where x0 <= 190 and x1 >= 110 and y0 <= 895 and y1 >= 840 group by b.vec_id
having bool_and(least(nx * x0, nx * x1) + least(ny * y0, ny * y1) <= hi and greatest(nx * x0, nx * x1) + greatest(ny * y0, ny * y1) >= lo)""")
def region_filter_convex(spark, sf_dir):
    return tiling.meeting(bounded_tiles(spark, sf_dir), ring(*TRIANGLE)).select("vec_id")


@query(f"with t as ({TILES}) select o_r as out_row, o_c as out_col, min(c) * 8 as origin_col_px, min(r) * 8 as origin_row_px, (max(c) + 1) * 8 - min(c) * 8 as width_px, (max(r) + 1) * 8 - min(r) * 8 as height_px, count(*) as members from t group by all")
def output_units(spark, sf_dir):
    u = tiling.units(embedding_tiles(spark, sf_dir))
    return u.select(*big(*((c, c) for c in ("out_row", "out_col", "origin_col_px", "origin_row_px", "width_px", "height_px")), (F.size("members"), "members")))


@query(f"with t as ({TILES}) select count(distinct (o_r, o_c)) as n_files from t")
def expected_output_count(spark, sf_dir):
    return tiling.count_files(embedding_tiles(spark, sf_dir))


@query("select o_orderkey, format('tile_r{:04d}_c{:04d}.tif', o_orderkey, o_custkey) as name from orders")
def tile_filename(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", fn.filename(F.col("o_orderkey"), F.col("o_custkey")).alias("name"))


@query("""with n as (select l_orderkey, l_linenumber, case when l_linenumber = 2 then format('tile_r{:03d}_c{:04d}.tif', l_orderkey, l_partkey) else format('tile_r{:04d}_c{:04d}.tif', l_orderkey, l_partkey) end as name from lineitem)
select l_orderkey, l_linenumber, try_cast(nullif(regexp_extract(name, '^tile_r([0-9]{4,})_c([0-9]{4,})[.]tif$', 1), '') as bigint) as out_row, try_cast(nullif(regexp_extract(name, '^tile_r([0-9]{4,})_c([0-9]{4,})[.]tif$', 2), '') as bigint) as out_col from n""")
def tile_filename_parse(spark, sf_dir):
    name = F.when(F.col("l_linenumber") == 2, F.format_string("tile_r%03d_c%04d.tif", "l_orderkey", "l_partkey")).otherwise(fn.filename(F.col("l_orderkey"), F.col("l_partkey")))
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", name.alias("name"))
    return t.select("l_orderkey", "l_linenumber", fn.filename_key(F.col("name"), "row").alias("out_row"), fn.filename_key(F.col("name"), "col").alias("out_col"))


@query("select event_id, 'tile[r=' || (event_id % 30) || ',c=' || (event_id % 40) || case when user_id % 3 > 0 then ',q=' || repeat('0', cast(user_id % 3 as int)) else '' end || ']' as tile_id from events")
def tile_id_lineage(spark, sf_dir):
    return journal(spark, sf_dir).select("event_id", fn.tile_id(F.col("row"), F.col("col"), F.col("lineage")).alias("tile_id"))


@query(f"with e as (select {EVENT_COLUMNS} from events) select event_id, {KIND_SQL} as error_kind from e")
def error_classify(spark, sf_dir):
    return journal(spark, sf_dir).select("event_id", "error_kind")


@query(f"with e as (select {EVENT_COLUMNS} from events) select event_id, case when status in (429, 503) then true when status in (400, 403, 404) then false else status >= 500 end as retryable from e")
def http_retryable(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", fn.http_retryable(F.col("status")).alias("retryable"))


@query(f"with e as (select {EVENT_COLUMNS} from events) select event_id, a.i as attempt, cast(least(case when status = 503 then 2000 else 1000 end * pow(2, a.i - 1), 10000) as bigint) as pause_ms from e, generate_series(1, 5) a(i)")
def backoff_schedule(spark, sf_dir):
    return events(spark, sf_dir).withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(5)))).select("event_id", F.col("attempt").cast("bigint").alias("attempt"), fn.backoff_ms(F.col("status"), F.col("attempt")).alias("pause_ms"))


@query("""select 'fresh' as origin, '{"event_id":' || event_id || '}' as line from events where event_type = 'error' union all select 'carried', '{"event_id":' || event_id || '}' from events where event_type <> 'error' and value > 50""")
def journal_union_carryover(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    fresh = retrying.journal_lines(e.where("event_type = 'error'").select("event_id"))
    carried = e.where("event_type <> 'error' and value > 50").select(F.format_string('{"event_id":%d}', "event_id").alias("value"))
    both = fresh.withColumn("origin", F.lit("fresh")).unionByName(carried.withColumn("origin", F.lit("carried")))
    return both.select("origin", F.col("value").alias("line"))


@query("""with l as (select event_id, case cast(event_id % 5 as int) when 0 then '' when 1 then '{broken' when 2 then '{"row":1,"col":2}' else '{"col_px":' || (event_id % 40) * 8 || ',"row_px":8,"width_px":8,"height_px":8,"row":1,"col":' || event_id % 40 || '}' end as line from events)
select valid, count(*) as n, cast(sum(col_sum) as bigint) as cols from (select line, json_valid(line) and try_cast(json_extract_string(case when json_valid(line) then line else '{}' end, '$.col_px') as int) is not null as valid, coalesce(try_cast(json_extract_string(case when json_valid(line) then line else '{}' end, '$.col') as int), 0) as col_sum from l where trim(line) <> '') group by valid""")
def journal_parse_valid(spark, sf_dir):
    line = F.expr("""case cast(event_id % 5 as int) when 0 then '' when 1 then '{broken' when 2 then '{"row":1,"col":2}' else concat('{"col_px":', (event_id % 40) * 8, ',"row_px":8,"width_px":8,"height_px":8,"row":1,"col":', event_id % 40, '}') end""")
    records = files.parse_journal(table(spark, sf_dir, "events").select(line.alias("value")))
    return records.groupBy("valid").agg(F.count("*").alias("n"), F.sum(F.coalesce("col", F.lit(0))).alias("cols"))


@query(f"{JOURNAL_SQL} select event_id, action from j")
def retry_decide(spark, sf_dir):
    return retrying.decide(journal(spark, sf_dir)).select("event_id", "action")


@query(f"{JOURNAL_SQL} select event_id, q.i as q, cast(c_px + case when q.i % 2 = 1 then 4 else 0 end as bigint) as col_px, cast(r_px + case when q.i < 2 then 4 else 0 end as bigint) as row_px, 4::bigint as width_px, cast(depth + 1 as bigint) as depth from j, generate_series(0, 3) q(i) where action = 'split'")
def retry_children(spark, sf_dir):
    j = retrying.decide(journal(spark, sf_dir)).where("action = 'split'")
    k = j.withColumn("k", F.explode(fn.quadrants(F.col("col_px"), F.col("row_px"), F.col("width_px"), F.col("height_px"), F.col("lineage"))))
    return k.select("event_id", *big(("k.q", "q"), ("k.col_px", "col_px"), ("k.row_px", "row_px"), ("k.width_px", "width_px"), (F.size("k.lineage"), "depth")))


@query(f"{JOURNAL_SQL} select event_id, p.i * 10 + q.i as path, cast(c_px + case when p.i % 2 = 1 then 4 else 0 end + case when q.i % 2 = 1 then 2 else 0 end as bigint) as col_px, cast(r_px + case when p.i < 2 then 4 else 0 end + case when q.i < 2 then 2 else 0 end as bigint) as row_px from j, generate_series(0, 3) p(i), generate_series(0, 3) q(i) where action = 'split' and depth = 0")
def retry_children_depth2(spark, sf_dir):
    j = retrying.decide(journal(spark, sf_dir)).where("action = 'split' and size(lineage) = 0")
    for _ in range(2):
        j = j.withColumn("k", F.explode(fn.quadrants(F.col("col_px"), F.col("row_px"), F.col("width_px"), F.col("height_px"), F.col("lineage"))))
        j = j.select("event_id", *(F.col(f"k.{c}").alias(c) for c in ("col_px", "row_px", "width_px", "height_px", "lineage")))
    return j.select("event_id", *big((F.col("lineage")[0] * 10 + F.col("lineage")[1], "path"), ("col_px", "col_px"), ("row_px", "row_px")))


@query(f"{JOURNAL_SQL} select action, count(*) as n from j group by action")
def retry_stats(spark, sf_dir):
    return retrying.plan(journal(spark, sf_dir)).stats


@query(f"{JOURNAL_SQL} select c_px::bigint as col_px, r_px::bigint as row_px, kind as error_kind, action as journal_reason, cast(ts as varchar) is not null as dated from j where action in ('depth_cap', 'terminal', 'unknown_kind')")
def carryover_stamp(spark, sf_dir):
    return retrying.plan(journal(spark, sf_dir)).carryover.select(*big(("col_px", "col_px"), ("row_px", "row_px")), "error_kind", "journal_reason", F.col("first_seen").isNotNull().alias("dated"))


@query(f"{JOURNAL_SQL} select action, cast(sum(case when action = 'split' then 4 when action = 'retry_same' then 1 else 0 end) as bigint) as next_tiles from j where action in ('split', 'retry_same') group by action union all select 'all', cast(sum(case when action = 'split' then 4 else 1 end) as bigint) from j where action in ('split', 'retry_same')")
def retry_next_tiles(spark, sf_dir):
    p = retrying.plan(journal(spark, sf_dir)).next_tiles.withColumn("action", F.when(F.col("width_px") == TS, "retry_same").otherwise("split"))
    n = p.groupBy("action").agg(F.count("*").alias("next_tiles"))
    return n.unionByName(n.agg(F.sum("next_tiles").alias("next_tiles")).withColumn("action", F.lit("all")))


FAILED_SQL = f"t as ({TILES}), f as (select distinct r, c from t where vec_id % 3 <> 0 or r < 4)"


def failed_keys(spark, sf_dir):
    return embedding_tiles(spark, sf_dir, "vec_id").where("vec_id % 3 <> 0 or row < 4").select("row", "col").distinct()


@query(f"with {FAILED_SQL} select o_r as out_row, o_c as out_col from t left join f using (r, c) group by all having bool_and((r, c) in (select (r, c) from f))")
def known_failed_units(spark, sf_dir):
    return validation.known_failed(embedding_tiles(spark, sf_dir), failed_keys(spark, sf_dir)).select(*big(("out_row", "out_row"), ("out_col", "out_col")))


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_linenumber > 1)")
def missing_units(spark, sf_dir):
    expected, found = keyed(table(spark, sf_dir, "orders"), "o_orderkey"), keyed(table(spark, sf_dir, "lineitem").where("l_linenumber > 1"), "l_orderkey")
    return validation.missing(expected, found, expected.limit(0)).select(F.col("out_row").cast("bigint").alias("o_orderkey"))


@query("select distinct l_orderkey from lineitem where l_orderkey not in (select o_orderkey from orders where o_totalprice > 1000 and o_custkey % 2 = 0)")
def unexpected_files(spark, sf_dir):
    expected = keyed(table(spark, sf_dir, "orders").where("o_totalprice > 1000 and o_custkey % 2 = 0"), "o_orderkey")
    return validation.unexpected(expected, keyed(table(spark, sf_dir, "lineitem"), "l_orderkey")).select(F.col("out_row").cast("bigint").alias("l_orderkey"))


@query(f"with {FAILED_SQL} select vec_id from t anti join f using (r, c)")
def live_tiles(spark, sf_dir):
    return validation.live(embedding_tiles(spark, sf_dir, "vec_id"), failed_keys(spark, sf_dir)).select("vec_id")


@query("with k as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as i, count(*) over () as n from orders) select o_orderkey from k where i in (select cast(round_even(s * ((n - 1) / 36.0::double), 0) as bigint) from generate_series(0, 36) g(s))")
def sample_evenly(spark, sf_dir):
    return validation.sample_evenly(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 37)


PIXELS_SQL = "p as (select vec_id, label, i, v, (vec_id % 25) * 8 + i % 8 as x, (vec_id // 25) * 8 + i // 8 as y from (select vec_id, label, generate_subscripts(embedding, 1) - 1 as i, cast(unnest(embedding) as double) as v from embeddings))"


@query(f"with {PIXELS_SQL}, d as (select vec_id, abs(v - case when label % 3 = 0 then v when i % 16 = 0 then 'nan'::double else round(v, 2) end) as d from p) select vec_id, max(d) filter (where isfinite(d)) as max_abs, count(*) filter (where isfinite(d)) as compared, coalesce(max(d) filter (where isfinite(d)) <= 0.0001, true) as agrees from d group by vec_id")
def pixel_diff(spark, sf_dir):
    def run(batches):
        for b in batches:
            rows = []
            for i, label, v in zip(b.column("vec_id").to_pylist(), b.column("label").to_pylist(), b.column("embedding").to_pylist(), strict=True):
                have = tiff.decode(tiff.encode(np.array(v, dtype="float32").reshape(TS, TS)))[0].astype(float)
                other = have.copy() if label % 3 == 0 else np.where(np.arange(TS * TS).reshape(TS, TS, 1) % 16 == 0, np.nan, np.round(have, 2))
                n, most, _, agrees = validation.difference(have, other)
                rows.append((i, most, n, agrees))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.float64(), pa.int64(), pa.bool_()), strict=True)], ["vec_id", "max_abs", "compared", "agrees"])

    return table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding").mapInArrow(run, "vec_id bigint, max_abs double, compared bigint, agrees boolean")


@query(f"with {PIXELS_SQL} select y // 32 as out_row, x // 32 as out_col, count(*) as n, min(v) as low, max(v) as high, arg_max(v, y * 1000 + x) as last_value from p group by all")
def canvas_assembly(spark, sf_dir):
    def stats(key, members, grid):
        canvas, _, _ = assembly.assemble(members, key, grid, OTS, TS, None)
        own = canvas[..., 0][covered(members, key)].astype(float)
        last = max(members, key=lambda m: (m["row_px"], m["col_px"]))
        corner = canvas[last["row_px"] + TS - 1 - key[0] * OTS, last["col_px"] + TS - 1 - key[1] * OTS, 0]
        return [(len(own), own.min(), own.max(), float(corner))]

    return canvases(spark, sf_dir, stored_tiles(spark, sf_dir), stats, "n bigint, low double, high double, last_value double")


@query(f"with {PIXELS_SQL}, k as (select * from p where vec_id % 4 <> 1), g as (select o.a as out_row, o.b as out_col, o.b * 32 + c.i as x, o.a * 32 + r.i as y from (select distinct y // 32 as a, x // 32 as b from k) o, generate_series(0, 31) c(i), generate_series(0, 31) r(i)) select out_row, out_col, count(*) as n, count(*) filter (where k.v is null) as filled, max(coalesce(k.v, 0)) as high from g left join k using (x, y) group by all")
def canvas_zero_fill(spark, sf_dir):
    def stats(key, members, grid):
        canvas, _, _ = assembly.assemble(members, key, grid, OTS, TS, None)
        return [(canvas.size, canvas.size - int(covered(members, key).sum()), float(canvas.max()))]

    return canvases(spark, sf_dir, stored_tiles(spark, sf_dir).where("vec_id % 4 <> 1"), stats, "n bigint, filled bigint, high double")


@query(f"with {PIXELS_SQL}, a as (select x, y, v from p where vec_id % 2 = 0), b as (select x, y, v + 1 as v from p where vec_id % 3 = 0) select x, y, coalesce(b.v, a.v) as v from a full join b using (x, y)")
def merge_overlay(spark, sf_dir):
    def stats(key, members, grid):
        old, new = [m for m in members if m["vec_id"] % 2 == 0], [m for m in members if m["vec_id"] % 3 == 0]
        if not old and not new:
            return []
        before = assembly.assemble(old, key, grid, OTS, TS, None)[0].astype("float64") if old else None
        raised = [m | {"payload": tiff.encode(tiff.decode(m["payload"])[0].astype("float64") + 1)} for m in new]
        after = assembly.assemble(raised, key, grid, OTS, TS, None if before is None else tiff.encode(before))[0] if new else before
        return [(key[1] * OTS + int(j), key[0] * OTS + int(i), float(after[i, j, 0])) for i, j in zip(*np.nonzero(covered(old + new, key)), strict=True)]

    return canvases(spark, sf_dir, stored_tiles(spark, sf_dir), stats, "x bigint, y bigint, v double").select("x", "y", "v")


@query(f"with t as ({TILES}), k as (select * from t where vec_id % 5 <> 2), g as (select o_r, o_c, o_r * 4 + a.i as r, o_c * 4 + b.i as c from (select distinct o_r, o_c from k) o, generate_series(0, 3) a(i), generate_series(0, 3) b(i)) select g.o_r as out_row, g.o_c as out_col, count(*) filter (where k.vec_id is null) as empty_blocks, cast(coalesce(sum(case when k.vec_id is not null then 64 end), 0) as bigint) as covered from g left join k using (r, c) group by all")
def block_coverage(spark, sf_dir):
    def stats(key, members, grid):
        return [(assembly.assemble(members, key, grid, OTS, TS, None)[1], int(covered(members, key).sum()))]

    return canvases(spark, sf_dir, stored_tiles(spark, sf_dir).where("vec_id % 5 <> 2"), stats, "empty_blocks bigint, covered bigint")


@query(f"with {PIXELS_SQL}, w as (select vec_id as w_id, (vec_id % 25) * 8 + 2 as x0, (vec_id // 25) * 8 + 3 as y0 from embeddings where vec_id % 50 = 0) select w_id, count(*) as n, min(v) as low, max(v) as high from w join p on x // 8 = x0 // 8 and y // 8 = y0 // 8 and x >= x0 and x < x0 + 4 and y >= y0 and y < y0 + 4 group by w_id")
def window_extract(spark, sf_dir):
    def run(batches):
        for b in batches:
            own = [(i, validation.window(tiff.decode(p)[0], 3, 2, 4, 4).astype(float)) for i, p in zip(b.column("vec_id").to_pylist(), b.column("payload").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in own], pa.int64()), *(pa.array([f(w) for _, w in own], t) for f, t in ((np.size, pa.int64()), (np.min, pa.float64()), (np.max, pa.float64())))], ["w_id", "n", "low", "high"])

    return stored_tiles(spark, sf_dir).where("vec_id % 50 = 0").select("vec_id", "payload").mapInArrow(run, "w_id bigint, n bigint, low double, high double")


@query(f"with t as ({TILES}) select a.vec_id, b.vec_id as right_id, d.vec_id as below_id from t a left join t b on b.r = a.r and b.c = a.c + 1 left join t d on d.r = a.r + 1 and d.c = a.c")
def neighbour_adjacency(spark, sf_dir):
    return tiling.neighbours(embedding_tiles(spark, sf_dir, "vec_id"), "vec_id")


@query(f"with t as ({TILES}) select c * 8 + 100 as x, r * 8 - 40 as y from t where c < 20 intersect select c * 8 + 64 + 100, r * 8 + 16 - 40 from t where c < 15")
def shared_tiles_two_exports(spark, sf_dir):
    t = embedding_tiles(spark, sf_dir)
    a = t.where("col < 20").select(*big((F.col("col_px") + 100, "x"), (F.col("row_px") - 40, "y")))
    b = t.where("col < 15").select(*big((F.col("col_px") + 164, "x"), (F.col("row_px") - 24, "y")))
    return a.intersect(b)


DTYPE = "case cast(p_partkey % 7 as int) when 0 then 'float32' when 1 then 'float64' when 2 then 'int16' when 3 then 'int32' when 4 then 'uint8' when 5 then 'uint16' else 'other' end"


@query(f"select p_partkey, p_size * 100::bigint * 512 * 512 * case {DTYPE} when 'float64' then 8 when 'int16' then 2 when 'uint16' then 2 when 'uint8' then 1 else 4 end * (1 + p_partkey % 3) as raw_bytes from part")
def raw_output_bytes(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", fn.raw_bytes(F.col("p_size") * 100, F.lit(512), F.expr(DTYPE), 1 + F.col("p_partkey") % 3).alias("raw_bytes"))


MACHINE = "case cast(p_partkey % 4 as int) when 0 then 'n2-standard-4' when 1 then 'n1-standard-16' when 2 then 'n1-highmem-8' else 'e2-standard-' || cast(p_size as varchar) end"


@query(f"""with m as (select p_partkey, p_size * 100 as t, {MACHINE} as m, p_partkey % 5 = 0 as local from part), v as (select *, coalesce(try_cast(nullif(regexp_extract(m, '-standard-([0-9]+)$', 1), '') as int), 4) as v from m),
s as (select *, greatest(4, least(100, ceil(t / (8 * 600.0::double)))) as w, v * 0.056::double + v * 4.0::double * 0.003557::double as rate from v)
select p_partkey, round(t * 0.2::double, 6) as compute_low, case when not local then round(w * (t * 0.5::double / (w * 8) + 180) / 3600.0::double * rate, 6) end as usd_low, case when not local then round(w * (t * 2.0::double / (w * 8) + 180) / 3600.0::double * rate, 6) end as usd_high, case when not local then round(t * 512::bigint * 512 * 4 / 1e9 * 0.011::double, 6) end as shuffle_usd, round(t * 512::bigint * 512 * 4 * 0.5::double / 1e9 * 0.02::double, 6) as storage_usd from s""")
def cost_estimate(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 100).alias("t"), F.expr(MACHINE.replace("varchar", "string")).alias("m"), (F.col("p_partkey") % 5 == 0).alias("local"))
    c = costs.estimate(F.col("t"), F.lit(512), F.lit("float32"), F.lit(1), F.col("m"), F.lit(4), F.lit(100), F.lit(8), F.lit(True), ~F.col("local"))
    return p.select("p_partkey", *(F.round(c[k], 6).alias(n) for k, n in (("compute_seconds_low", "compute_low"), ("usd_low", "usd_low"), ("usd_high", "usd_high"), ("shuffle_usd", "shuffle_usd"), ("storage_usd_per_month", "storage_usd"))))


@query(f"with m as (select p_partkey, {MACHINE} as m from part) select p_partkey, m as machine, cast(coalesce(try_cast(nullif(regexp_extract(m, '-standard-([0-9]+)$', 1), '') as int), 4) as bigint) as vcpus, coalesce(try_cast(nullif(regexp_extract(m, '-standard-([0-9]+)$', 1), '') as int), 4) * 4.0::double as memory_gb, regexp_extract(m, '-standard-([0-9]+)$', 1) = '' as fallback from m")
def machine_shape(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr(MACHINE.replace("varchar", "string")).alias("machine"))
    return p.select("p_partkey", "machine", *big((fn.machine_vcpus(F.col("machine")), "vcpus")), (fn.machine_vcpus(F.col("machine")) * costs.GB_PER_VCPU).alias("memory_gb"), (F.regexp_extract("machine", r"-standard-(\d+)$", 1) == "").alias("fallback"))


@query("with n as (select c_custkey, case cast(c_custkey % 4 as int) when 0 then 'nan'::double when 1 then floor(c_acctbal) when 2 then -9999.0::double else floor(c_acctbal) + 0.5 end as x from customer) select c_custkey, case when isnan(x) then 'nan' when x = floor(x) then cast(cast(x as bigint) as varchar) else cast(x as varchar) end as tag from n")
def nodata_format(spark, sf_dir):
    x = F.expr("case cast(c_custkey % 4 as int) when 0 then double('nan') when 1 then double(floor(c_acctbal)) when 2 then -9999.0D else floor(c_acctbal) + 0.5D end")
    return table(spark, sf_dir, "customer").select("c_custkey", fn.nodata_text(x).alias("tag"))


@query("""with v as (select o_orderkey, cast(o_totalprice * (o_orderkey % 7) * 1000 as bigint) as n, cast(o_orderkey % 9000 as double) as s, floor(o_totalprice) + case when o_orderkey % 2 = 0 then 0.25 else 0.75 end as u from orders)
select o_orderkey, case when n < 1024 then n || ' B' when n < 1048576 then printf('%.1f KB', n / 1024.0::double) when n < 1073741824 then printf('%.1f MB', n / 1048576.0::double) else printf('%.2f GB', n / 1073741824.0::double) end as size_text, case when s < 60 then printf('~%.0f s', s) when s < 3600 then printf('~%.1f min', s / 60) else printf('~%.1f h', s / 3600) end as time_text, format('${:,.2f}', u) as usd_text from v""")
def format_bytes_duration_usd(spark, sf_dir):
    v = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "cast(rint(o_totalprice * (o_orderkey % 7) * 1000) as bigint) n", "cast(o_orderkey % 9000 as double) s", "floor(o_totalprice) + case when o_orderkey % 2 = 0 then 0.25D else 0.75D end u")
    return v.select("o_orderkey", fn.bytes_text(F.col("n")).alias("size_text"), fn.duration_text(F.col("s")).alias("time_text"), fn.usd_text(F.col("u")).alias("usd_text"))


@query("select user_id, date_diff('second', min(ts), max(ts)) as elapsed, date_diff('second', min(ts), max(ts)) > 2000000 as trips from events group by user_id")
def watchdog_runtime(spark, sf_dir):
    elapsed = F.expr("timestampdiff(second, date_trunc('second', min(ts)), date_trunc('second', max(ts)))")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(elapsed.alias("elapsed")).select("user_id", "elapsed", monitoring.over_runtime(F.col("elapsed"), 2_000_000.0).alias("trips"))


@query("select user_id, count(*) as tiles, count(*) filter (where event_type = 'error') as failures, count(*) filter (where event_type = 'error') / count(*) > 0.2 as trips from events group by user_id")
def watchdog_failure_rate(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("tiles"), F.count(F.when(F.col("event_type") == "error", 1)).alias("failures"))
    return n.select("user_id", "tiles", "failures", monitoring.over_failure_rate(F.col("failures"), F.col("tiles"), F.lit(700.0), 0.2).alias("trips"))


@query("""with s as (select event_id, user_id, event_id * 10 as t, cast(floor(value) as bigint) as a, case when event_type = 'error' then 1 else 0 end as b from events),
m as (select *, a > coalesce(max(a) over w, 0) or b > coalesce(max(b) over w, 0) as progressed from s window w as (partition by user_id order by t rows between unbounded preceding and 1 preceding)),
l as (select *, coalesce(max(case when progressed then t end) over (partition by user_id order by t rows between unbounded preceding and current row), min(t) over (partition by user_id)) as last_t, min(t) over (partition by user_id) as t0 from m)
select event_id, progressed, t - last_t as idle_for, t - last_t > 30000 and t - t0 > 1000 as trips from l""")
def watchdog_idle(spark, sf_dir):
    s = table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "event_id * 10 as t", "cast(floor(value) as bigint) as a", "case when event_type = 'error' then 1 else 0 end as b")
    return monitoring.idle(s, "user_id", "t", ["a", "b"], 30_000, 1_000).select("event_id", "progressed", "idle_for", "trips")


@query("""with m as (select user_id, event_id, case cast(event_id % 4 as int) when 0 then 'ElementCount' when 1 then 'elements_added' when 2 then 'failures_written' else 'tiles_written' end as name, case when event_id % 8 = 0 then 'out' end as o, value from events)
select user_id, max(value) filter (where name = 'ElementCount' and o is not null) as elements, max(value) filter (where name = 'elements_added') as elements_added, arg_max(value, event_id) filter (where name = 'failures_written') as failures_written, arg_max(value, event_id) filter (where name = 'tiles_written') as tiles_written from m group by user_id""")
def parse_metrics(spark, sf_dir):
    m = table(spark, sf_dir, "events").selectExpr("user_id", "event_id", "case cast(event_id % 4 as int) when 0 then 'ElementCount' when 1 then 'elements_added' when 2 then 'failures_written' else 'tiles_written' end as name", "case when event_id % 8 = 0 then 'out' end as o", "value")
    return monitoring.metrics(m, "user_id", "name", "o", "value", "event_id")


@query("""with m as (select source, doc_id, trim(text, ' ') as t from documents), c as (select *, regexp_replace(split_part(t, '. ', 1), '[.]+$', '') as cause from m where length(t) > 0),
b as (select source, cause, arg_max(t, (length(t), doc_id)) as message, min(doc_id) as first_at from c group by all)
select source, cause, message, first_at from (select *, row_number() over (partition by source order by first_at desc) as n from b) where n <= 5""")
def failure_summary(spark, sf_dir):
    return monitoring.failure_summary(table(spark, sf_dir, "documents"), "source", "doc_id", "text").select("source", "cause", "message", "first_at")


EXPRESSION = """'{"result":"0","values":{"0":{"functionInvocationValue":{"functionName":"' || case cast(event_id % 3 as int) when 0 then 'Collection.map' when 1 then 'reduce.median' else 'Image.load' end || '","arguments":{}}}}}'"""


@query(f"with x as (select event_id, {EXPRESSION} as e from events) select event_id, json_extract_string(e, '$.values.0.functionInvocationValue.functionName') in {tuple(sorted(COLLECTIONS))!r} as rejected from x")
def collection_result_check(spark, sf_dir):
    x = table(spark, sf_dir, "events").select("event_id", F.expr(EXPRESSION).alias("e"))
    return x.select("event_id", gives_collection(result_function_column(F.col("e"))).alias("rejected"))


@query("""select l_orderkey, l_linenumber, concat_ws(',', case when l_quantity <> 25 then 'scale' end, case when l_returnflag <> 'N' then 'crs' end, case when (case when l_linenumber % 2 = 0 then l_tax end) is distinct from (case when l_linenumber % 3 = 0 then l_tax end) then 'nodata' end, case when sha256(l_linestatus) <> sha256('O') then 'expression' end) as mismatches from lineitem""")
def meta_mismatch(spark, sf_dir):
    from tilewright.plans.meta import mismatches

    t = table(spark, sf_dir, "lineitem")
    was = {"scale": F.col("l_quantity"), "crs": F.col("l_returnflag"), "nodata": F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax")), "expression": F.sha2(F.col("l_linestatus"), 256)}
    now = {"scale": F.lit(25.0), "crs": F.lit("N"), "nodata": F.when(F.col("l_linenumber") % 3 == 0, F.col("l_tax")), "expression": F.sha2(F.lit("O"), 256)}
    return t.select("l_orderkey", "l_linenumber", F.array_join(mismatches(was, now), ",").alias("mismatches"))


@query("""select vec_id, case vec_id % 8 when 1 then 'dimensions 16x8, expected 8x8' when 2 then '2 bands, expected 1' when 3 then 'type float64, expected float32' when 4 then 'CRS EPSG:4326, expected EPSG:3857'
when 5 then 'origin' when 6 then 'unreadable: no TIFF header' when 7 then '150 bytes are too few for a file' else '' end as issues, vec_id % 8 <> 0 as failed from embeddings""")
def file_integrity_flags(spark, sf_dir):
    """A file for each vector, seven of eight with a fault of their own, against the headers expected."""
    grid = mosaic_grid(spark, sf_dir)
    t = embedding_tiles(spark, sf_dir, "vec_id", "embedding")

    def faulty(batches):
        for b in batches:
            ids, heads = b.column("vec_id").to_pylist(), []
            for i, v in zip(ids, b.column("embedding").to_pylist(), strict=True):
                a, kind = np.array(v, dtype="float32").reshape(TS, TS, 1), i % 8
                a = np.tile(a, (1, 2, 1)) if kind == 1 else np.tile(a, (1, 1, 2)) if kind == 2 else a.astype("float64") if kind == 3 else a
                at = grid.translate_x + (i % ACROSS * TS + (kind == 5)) * grid.scale_x, grid.translate_y + i // ACROSS * TS * grid.scale_y
                data = tiff.encode(a, None, "none", (grid.scale_x, grid.scale_y), at, None, tiff.geo_keys(4326 if kind == 4 else 3857, kind == 4))
                heads.append(b"XX" + data[2:] if kind == 6 else data)
            sizes = [150 if i % 8 == 7 else len(h) for i, h in zip(ids, heads, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("col"), pa.array(sizes, pa.int64()), pa.array(heads, pa.binary())], ["out_row", "out_col", "length", "head"])

    found = t.select("row", "col", "vec_id", "embedding").mapInArrow(faulty, "out_row int, out_col int, length bigint, head binary")
    expected = t.select(F.col("row").alias("out_row"), F.col("col").alias("out_col"), F.col("col_px").alias("origin_col_px"), F.col("row_px").alias("origin_row_px"), "width_px", "height_px")
    got = validation.header_issues(found, expected, grid, 1, "float32")
    text = F.array_join(F.transform("issues", lambda x: F.when(x.startswith("origin"), "origin").otherwise(x)), ",")
    return got.select((F.col("out_row") * ACROSS + F.col("out_col")).cast("bigint").alias("vec_id"), text.alias("issues"), (F.size("issues") > 0).alias("failed"))


def ramp(x, y, band):
    return y * 1000.0 + x


@query("select r.i as row_id, c.i as col_id, (8000 * (64 * r.i + 28) + 8 * (64 * c.i + 28))::double as total from (select distinct vec_id // 25 as i from embeddings) r, (select distinct vec_id % 25 as i from embeddings) c")
def repartition_fetch_roundtrip(spark, sf_dir):
    tiles = tiling.grid_tiles(spark, mosaic_grid(spark, sf_dir), TS)
    got = pixels.fetch(tiles, pixels.Synthetic(ramp, "float64"))

    def total(batches):
        for b in batches:
            sums = [float(tiff.decode(x)[0].sum()) for x in b.column("payload").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row").cast(pa.int64()), b.column("col").cast(pa.int64()), pa.array(sums, pa.float64())], ["row_id", "col_id", "total"])

    return got.mapInArrow(total, "row_id bigint, col_id bigint, total double")


@query(f"with {PIXELS_SQL} select vec_id, count(*) as n, min(v) as low, max(v) as high from p group by vec_id")
def cog_roundtrip(spark, sf_dir):
    def run(batches):
        for b in batches:
            rows = []
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("embedding").to_pylist(), strict=True):
                d, _ = tiff.decode(tiff.encode(np.array(v, dtype="float32").reshape(TS, TS), TS))
                rows.append((i, d.size, float(d.min()), float(d.max())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], ["vec_id", "n", "low", "high"])

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInArrow(run, "vec_id bigint, n bigint, low double, high double")


@query(f"""with x as (select event_id, {EXPRESSION} as e from events) select event_id, case when event_id % 3 = 2 then replace(e, '"arguments":{{}}', '"arguments":{{"version":{{"constantValue":1715000000000000}}}}') else e end as pinned from x""")
def pin_expression(spark, sf_dir):
    from tilewright.plans.pinning import pin_column

    e = table(spark, sf_dir, "events").select("event_id", F.expr(EXPRESSION).alias("e"))
    return e.select("event_id", pin_column(F.col("e"), 1_715_000_000_000_000).alias("pinned"))


@query(f"with {PIXELS_SQL} select 'file' as kind, y // 32 as out_row, x // 32 as out_col, count(*) // 64 as tiles, round(sum(v), 3) as checksum from p group by all")
def export_mosaic(spark, sf_dir):
    return flagship(spark, sf_dir).select("kind", *big(("out_row", "out_row"), ("out_col", "out_col"), ("tiles", "tiles")), "checksum")


@query("select error_kind, count(*) as n from (select case cast((r.i * 8 + c.i) % 4 as int) when 0 then 'MEMORY_EXCEEDED' when 1 then 'RATE_LIMITED' when 2 then 'AUTH_ERROR' end as error_kind from (select distinct vec_id // 25 as i from embeddings) r, (select distinct vec_id % 25 as i from embeddings) c) where error_kind is not null group by error_kind")
def fetch_failures(spark, sf_dir):
    got = pixels.fetch(tiling.grid_tiles(spark, mosaic_grid(spark, sf_dir), TS), Faulty(), attempts=2, pause=no_pause)
    return got.where("payload is null").groupBy("error_kind").agg(F.count("*").alias("n"))


class Faulty:
    """A source that fails by tile number, for drills of the failure path."""

    def fetch(self, tile):
        k = (tile["row"] * 8 + tile["col"]) % 4
        if k < 3:
            raise pixels.SourceError(*((400, "User memory limit exceeded."), (429, "Too many requests"), (401, "Unauthorized"))[k])
        return tiff.encode(np.zeros((tile["height_px"], tile["width_px"]), dtype="float32"))


def no_pause(seconds: float) -> None:
    return None


@query("""with t as (select p_partkey, cast(p_partkey as double) * 8 as c, cast(p_size as double) * 8 as r from part)
select p_partkey, '{"expression":{"result":"0","values":{"0":{"constantValue":1}}},"fileFormat":"GEO_TIFF","grid":{"dimensions":{"width":8,"height":8},"affineTransform":{"scaleX":0.5,"shearX":0.125,"translateX":' || (100.0::double + c * 0.5::double + r * 0.125::double)::varchar
|| ',"shearY":0.0625,"scaleY":-0.5,"translateY":' || (900.0::double + c * 0.0625::double + r * (-0.5)::double)::varchar || '},"crsCode":"EPSG:3857"}}' as body from t""")
def request_body(spark, sf_dir):
    grid = tiling.Grid("EPSG:3857", GRID["scale_x"], GRID["translate_x"], GRID["scale_y"], GRID["translate_y"], 1 << 20, 1 << 20, GRID["shear_x"], GRID["shear_y"])
    body = http.request_body(CONSTANT, grid, F.col("p_partkey") * TS, F.col("p_size") * TS, F.lit(TS), F.lit(TS))
    return table(spark, sf_dir, "part").select("p_partkey", body.alias("body"))


@query(f"with t as ({TILES}), g as (select r.i as r, c.i as c, r.i // 4 as o_r, c.i // 4 as o_c from (select distinct vec_id // 25 as i from embeddings) r, (select distinct vec_id % 25 as i from embeddings) c), k as (select g.o_r, g.o_c, count(t.vec_id) as n, count(*) as blocks from g left join (select * from t where vec_id % 5 <> 2) t on t.r = g.r and t.c = g.c group by all) select count(*) as output_tiles_written, count(*) filter (where n < blocks) as output_tiles_partial, 0::bigint as output_tiles_merged, cast(sum(n) as bigint) as tiles_written, 0::bigint as write_failures from k where n > 0")
def written_counters(spark, sf_dir):
    return assembly.counters(mosaic(spark, sf_dir, stored_tiles(spark, sf_dir).where("vec_id % 5 <> 2")))


@query("select o_orderstatus, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_orderstatus order by o_totalprice desc, o_orderkey) as n from orders) where n <= 20")
def first_problems(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice")
    return validation.first_of(rows, ["o_orderstatus"], [F.desc("o_totalprice"), "o_orderkey"], 20)


GRID_SQL = "g as (select r.i as r, c.i as c from (select distinct vec_id // 25 as i from embeddings) r, (select distinct vec_id % 25 as i from embeddings) c)"


def folder(spark, name: str) -> str:
    """A new place in the folder that executors share; it goes with the session."""
    out = f"{store.shared_dir(spark)}/{name}/{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(out)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return out


def direct(spark, sf_dir, tiles: DataFrame) -> str:
    """The folder of a direct export: a file for each tile, named by its row and column."""
    out = folder(spark, "direct")
    own = tiles.withColumns({"out_row": F.col("row"), "out_col": F.col("col")})
    store.stage(assembly.write_direct(own, out, mosaic_grid(spark, sf_dir), TS))
    return out


@query(f"with t as ({TILES}) select r as out_row, c as out_col, 'tile_r' || lpad(r::varchar, 4, '0') || '_c' || lpad(c::varchar, 4, '0') || '.tif' as name from t where vec_id % 5 <> 2")
def output_listing(spark, sf_dir):
    out = direct(spark, sf_dir, stored_tiles(spark, sf_dir).where("vec_id % 5 <> 2"))
    return files.output_files(spark, out).select("out_row", "out_col", "name")


@query(f"with t as ({TILES}) select r as out_row, c as out_col, 100.0::double + c * 8 * 0.5 as x, 900.0::double - r * 8 * 0.5 as y, 8::bigint as width, 8::bigint as height, 3857::bigint as epsg from t")
def direct_export_headers(spark, sf_dir):
    out = direct(spark, sf_dir, stored_tiles(spark, sf_dir))

    def run(batches):
        for b in batches:
            rows = []
            for head in b.column("head").to_pylist():
                at = tiff.read_layout(head)
                rows.append((*at.tags[tiff.TIEPOINT][1][3:5], at.width, at.height, tiff.epsg_of(at.tags)))
            yield pa.RecordBatch.from_arrays([*(b.column(c).cast(pa.int64()) for c in ("out_row", "out_col")), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()), strict=True))], ["out_row", "out_col", "x", "y", "width", "height", "epsg"])

    return validation.found_files(spark, out).mapInArrow(run, "out_row bigint, out_col bigint, x double, y double, width bigint, height bigint, epsg bigint")


@query(f"with t as ({TILES}) select 'missing' as problem, r as out_row, c as out_col from t where vec_id % 3 <> 1 and vec_id % 5 = 2 and vec_id % 7 <> 0 union all select 'unexpected', r, c from t where vec_id % 5 <> 2 and vec_id % 3 = 1")
def integrity_problems(spark, sf_dir):
    out = direct(spark, sf_dir, stored_tiles(spark, sf_dir).where("vec_id % 5 <> 2"))
    t = embedding_tiles(spark, sf_dir, "vec_id").withColumns({"out_row": F.col("row"), "out_col": F.col("col")})
    found = validation.integrity(spark, t.where("vec_id % 3 <> 1"), out, mosaic_grid(spark, sf_dir), t.where("vec_id % 7 = 0"))
    return found.select("problem", *big(("out_row", "out_row"), ("out_col", "out_col")))


@query(f"with {GRID_SQL}, k as (select r, c, row_number() over (order by r, c) - 1 as i, count(*) over () as n from g) select r as row_id, c as col_id, 0.0::double as max_abs, true as agrees from k where i in (select cast(round_even(s * ((n - 1) / 19.0::double), 0) as bigint) from generate_series(0, 19) x(s))")
def pixels_validated(spark, sf_dir):
    out, grid, source = folder(spark, "checked"), mosaic_grid(spark, sf_dir), pixels.Synthetic(ramp)
    tiles = tiling.grid_tiles(spark, grid, TS, OTS)
    store.stage(assembly.write_assembled(pixels.fetch(tiles, source), out, grid, TS, OTS))
    got = validation.pixel_differences(tiles, out, source, OTS, 20)
    return got.select(*big(("row", "row_id"), ("col", "col_id")), "max_abs", "agrees")


@query(f"with {GRID_SQL}, k as (select case cast((r * 8 + c) % 4 as int) when 0 then 'MEMORY_EXCEEDED' when 1 then 'RATE_LIMITED' when 2 then 'AUTH_ERROR' end as error_kind from g) select error_kind, 'failed' as journal_reason, count(*) as n, true as dated from k where error_kind is not null group by error_kind")
def journal_file(spark, sf_dir):
    """Failures of a fetch, as the records of a journal file that is written and read back."""
    at = f"{folder(spark, 'journal')}/_failures.json"
    fetched = store.stage(pixels.fetch(tiling.grid_tiles(spark, mosaic_grid(spark, sf_dir), TS), Faulty(), attempts=1, pause=no_pause))
    none = assembly.write_direct(fetched.limit(0), at, mosaic_grid(spark, sf_dir), TS)
    files.write_lines(retrying.journal_lines(assembly.failures(fetched, none)), at)
    return files.read_journal(spark, at).groupBy("error_kind", "journal_reason").agg(F.count("*").alias("n"), F.bool_and(F.col("first_seen").isNotNull() & F.col("last_seen").isNotNull()).alias("dated"))


@query(f"with t as ({TILES}) select r as row_id, c as col_id, c * 8 as col_px, r * 8 as row_px, o_r as out_row, o_c as out_col, 0::bigint as depth from t")
def tile_list_file(spark, sf_dir):
    at = f"{folder(spark, 'tiles')}/_tiles.ndjson"
    files.write_tiles(embedding_tiles(spark, sf_dir), at)
    return files.read_tiles(spark, at).select(*big(("row", "row_id"), ("col", "col_id"), ("col_px", "col_px"), ("row_px", "row_px"), ("out_row", "out_row"), ("out_col", "out_col"), (F.size("lineage"), "depth")))


@query("""select distinct event_id % 40 as row_id, event_id % 30 as col_id from events where event_id % 4 in (0, 3)""")
def journal_keys_lenient(spark, sf_dir):
    line = F.expr("""case cast(event_id % 4 as int) when 1 then concat('{"row":', event_id % 40, '}') when 2 then '{broken' when 3 then concat('{"col":', event_id % 30, ',"more":{"a":[1]},"row":', event_id % 40, '}') else concat('{"row":', event_id % 40, ',"col":', event_id % 30, '}') end""")
    return files.keys_of(table(spark, sf_dir, "events").select(line.alias("value"))).select(*big(("row", "row_id"), ("col", "col_id")))


class Steady:
    """A source that always answers."""

    def fetch(self, tile):
        return tiff.encode(np.ones((tile["height_px"], tile["width_px"]), dtype="float32"))


@query(f"with {GRID_SQL}, k as (select (r * 8 + c) % 4 as k from g) select 'export' as stage, count(*) as tiles, count(*) filter (where k = 3) as files, count(*) filter (where k < 3) as failed, 0::bigint as carried from k union all select 'retry', cast(count(*) filter (where k = 0) * 4 + count(*) filter (where k = 1) as bigint), count(*) filter (where k < 2), 0, count(*) filter (where k = 2) from k union all select 'retry again', 0, 0, 0, count(*) filter (where k = 2) from k")
def export_and_retries(spark, sf_dir):
    """An export with a faulty source, a retry with a steady one, and one with nothing left to do."""
    from tilewright.plans import api

    out, how = folder(spark, "export"), {"attempts": 1, "pause": no_pause}
    rows = [("export", api.export(spark, CONSTANT, out, Faulty(), grid=mosaic_grid(spark, sf_dir), tile_size=TS, snapshot_time=1_715_000_000_000_000, **how))]
    rows += [(name, api.retry(spark, out, Steady(), **how)) for name in ("retry", "retry again")]
    return spark.createDataFrame([(name, r.tiles, r.files, r.failed, getattr(r, "carried", 0)) for name, r in rows], "stage string, tiles bigint, files bigint, failed bigint, carried bigint")


@query(f"{JOURNAL_SQL} select time_bucket(interval '10 minutes', date_trunc('second', ts)) as window_start, kind as error_kind, count(*) as n from j group by all")
def failures_by_window(spark, sf_dir):
    """The journal as a stream: failures by kind and window of ten minutes."""
    from tilewright.streaming import monitor

    at = folder(spark, "stream")
    rows = journal(spark, sf_dir).drop("event_id").withColumn("last_seen", F.date_format(F.to_timestamp("last_seen"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    rows.repartition(4).write.json(f"{at}/in")
    name = "seen_" + uuid.uuid4().hex
    monitor.run_once(monitor.by_window(monitor.failures(spark, f"{at}/in", "1000 days")), name, f"{at}/state").awaitTermination()
    latest = spark.table(name).groupBy("window", "error_kind").agg(F.max("n").alias("n"))  # a window that grew came again
    return latest.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "error_kind", "n")


def relief(x, y, band):
    return (x * 7 + y * 13) % 3000


@query("select count(*) as files, cast(count(*) * 512 * 512 as bigint) as pixels from supplier")
def export_512px(spark, sf_dir):
    """Tiles of 512 px, int16, one for each supplier, fetched from a function and written as files."""
    n = table(spark, sf_dir, "supplier").count()
    if n == 0:
        return spark.createDataFrame([(0, 0)], "files bigint, pixels bigint")
    grid = tiling.Grid("EPSG:4326", 0.0002, 0.0, -0.0002, 0.0, 512 * n, 512)
    fetched = pixels.fetch(tiling.grid_tiles(spark, grid, 512), pixels.Synthetic(relief, "int16"))
    written = assembly.write_direct(fetched, folder(spark, "tiles512"), grid, 512)
    return written.where("kind = 'file'").agg(F.count("*").alias("files"), F.coalesce(F.sum(F.col("width_px").cast("bigint") * F.col("height_px")), F.lit(0)).alias("pixels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

