"""Watching a job: limits, idle time, failure summaries, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COUNTERS = ("elements_produced", "output_tiles_written", "tiles_written", "compute_tiles_assembled", "failures_written")


def over_runtime(elapsed: Column, cap: float | None) -> Column:
    return F.lit(False) if cap is None else elapsed > cap


def over_failure_rate(failures: Column, tiles: Column, elapsed: Column, most: float = 0.5, grace: float = 600.0) -> Column:
    return F.coalesce((tiles > 0) & (elapsed > grace) & (failures / tiles > most), F.lit(False))


def idle(snapshots: DataFrame, job: str, at: str, counters: list[str], timeout: float = 1200.0, grace: float = 0.0) -> DataFrame:
    """Snapshots with ``progressed`` and ``trips``: no counter has passed its own highest value for over
    ``timeout`` seconds, and the job is older than ``grace``."""
    before = Window.partitionBy(job).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(job).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    moved = F.lit(False)
    for c in counters:
        moved = moved | (F.coalesce(F.col(c), F.lit(0)) > F.coalesce(F.max(c).over(before), F.lit(0)))
    seconds = F.col(at)
    df = snapshots.withColumn("progressed", moved)
    last = F.coalesce(F.max(F.when(F.col("progressed"), seconds)).over(upto), F.min(seconds).over(Window.partitionBy(job)))
    df = df.withColumn("idle_for", seconds - last).withColumn("age", seconds - F.min(seconds).over(Window.partitionBy(job)))
    return df.withColumn("trips", (F.col("idle_for") > timeout) & (F.col("age") > grace))


def failure_summary(messages: DataFrame, job: str, order: str, text: str, most: int = 5) -> DataFrame:
    """For each job the longest message (ties: the later) of each cause, causes by first appearance, the last ``most``."""
    m = messages.where(F.length(F.trim(text)) > 0).withColumn("_t", F.trim(text))
    m = m.withColumn("cause", F.regexp_replace(F.split_part("_t", F.lit(". "), F.lit(1)), r"\.+$", ""))
    best = m.groupBy(job, "cause").agg(F.max_by("_t", F.struct(F.length("_t"), F.col(order))).alias("message"), F.min(order).alias("first_at"))
    newest = F.row_number().over(Window.partitionBy(job).orderBy(F.desc("first_at")))
    return best.withColumn("_n", newest).where(F.col("_n") <= most).drop("_n")


def metrics(rows: DataFrame, job: str, name: str, user: str, value: str, order: str) -> DataFrame:
    """elements (max of ElementCount of a named output), elements_added (max) and the last value of each user counter."""
    return rows.groupBy(job).agg(
        F.max(F.when((F.col(name) == "ElementCount") & F.col(user).isNotNull(), F.col(value))).alias("elements"), F.max(F.when(F.col(name) == "elements_added", F.col(value))).alias("elements_added"),
        F.max_by(value, F.when(F.col(name) == "failures_written", F.col(order))).alias("failures_written"), F.max_by(value, F.when(F.col(name) == "tiles_written", F.col(order))).alias("tiles_written"),
    )
