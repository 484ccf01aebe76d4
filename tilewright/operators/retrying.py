"""From a journal to the next round: what to try again as it is, what to split, what to carry over."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import tiles as fn
from tilewright.schema import TILE_COLUMNS

KEPT = ("error_kind", "error_message", "http_status", "attempts", "first_seen", "last_seen")


@dataclass
class Plan:
    next_tiles: DataFrame
    carryover: DataFrame
    stats: DataFrame


def decide(journal: DataFrame, max_depth: int = 2) -> DataFrame:
    """The journal with ``action``. A tile of odd size can't be split and is carried over as terminal."""
    depth = F.size(F.coalesce("lineage", F.array().cast("array<int>")))
    action = fn.retry_action(F.col("error_kind"), depth, max_depth)
    odd = (action == "split") & ((F.col("width_px") % 2 != 0) | (F.col("height_px") % 2 != 0))
    return journal.withColumn("action", F.when(odd, "terminal").otherwise(action))


def plan(journal: DataFrame, max_depth: int = 2) -> Plan:
    decided = decide(journal, max_depth)
    same = decided.where("action = 'retry_same'").select(*TILE_COLUMNS)
    children = decided.where("action = 'split'").withColumn("k", F.explode(fn.quadrants(F.col("col_px"), F.col("row_px"), F.col("width_px"), F.col("height_px"), F.coalesce("lineage", F.array().cast("array<int>")))))
    children = children.select(*(F.col(f"k.{c}").alias(c) if c in ("col_px", "row_px", "width_px", "height_px", "lineage") else F.col(c) for c in TILE_COLUMNS))
    carried = decided.where("action in ('depth_cap', 'terminal', 'unknown_kind')").withColumn("journal_reason", F.col("action"))
    if "raw" in journal.columns:
        carried = carried.withColumn("raw", stamped(F.col("raw"), F.col("action")))
    columns = [*TILE_COLUMNS, *KEPT, "journal_reason", *(["raw"] if "raw" in journal.columns else [])]
    return Plan(same.unionByName(children), carried.select(*columns), decided.groupBy("action").agg(F.count("*").alias("n")))


REASON = r'"journal_reason"\s*:\s*(?:null|"(?:[^"\\]|\\.)*")'


def stamped(line: Column, reason: Column) -> Column:
    """A journal line with its reason set and everything else, fields of other writers too, as it stands."""
    new = F.concat(F.lit('"journal_reason":"'), reason, F.lit('"'))
    return F.when(F.regexp_like(line, F.lit(REASON)), F.call_function("regexp_replace", line, F.lit(REASON), new)).otherwise(F.call_function("regexp_replace", line, F.lit(r"\}\s*$"), F.concat(F.lit(","), new, F.lit("}"))))


def journal_lines(fresh: DataFrame, carryover: DataFrame | None = None) -> DataFrame:
    """Lines of the next journal: fresh failures as JSON, carried lines verbatim (a text column ``value``)."""
    lines = fresh.select(F.to_json(F.struct(*fresh.columns)).alias("value"))
    return lines if carryover is None else lines.unionAll(carryover.select("value"))
