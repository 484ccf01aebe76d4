"""Estimates of compute, shuffle and storage cost."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.functions import tiles as fn

#: Prices and model constants (fixed values; list prices of batch jobs).
VCPU_HOUR, MEMORY_GB_HOUR, SHUFFLE_GB, STORAGE_GB_MONTH = 0.056, 0.003557, 0.011, 0.02
COMPUTE_SECONDS_LOW, COMPUTE_SECONDS_HIGH, DEFLATE, GB_PER_VCPU, TARGET_SECONDS, OVERHEAD_SECONDS, BAND = 0.2, 5.0, 0.5, 4.0, 600.0, 180.0, 2.0


def worker_usd(tiles: Column, vcpus: Column, workers: Column, most: Column, threads: Column, seconds_per_tile: float) -> Column:
    steady = F.greatest(workers, F.least(most, F.ceil(tiles / (threads * TARGET_SECONDS))))
    wall = tiles * seconds_per_tile / (steady * threads)
    return steady * (wall + OVERHEAD_SECONDS) / 3600.0 * (vcpus * VCPU_HOUR + vcpus * GB_PER_VCPU * MEMORY_GB_HOUR)


def estimate(tiles: Column, tile: Column, data_type: Column, bands: Column, machine: Column, workers: Column, most: Column, threads: Column, two_tier: Column, remote: Column) -> dict[str, Column]:
    """Columns of the estimate; null where a figure doesn't apply, zeros where the number of tiles isn't known."""
    vcpus, raw = fn.machine_vcpus(machine), fn.raw_bytes(tiles, tile, data_type, bands)
    known = tiles > 0
    return {
        "compute_seconds_low": F.when(known, tiles * COMPUTE_SECONDS_LOW).otherwise(0.0), "compute_seconds_high": F.when(known, tiles * COMPUTE_SECONDS_HIGH).otherwise(0.0),
        "usd_low": F.when(known & remote, worker_usd(tiles, vcpus, workers, most, threads, 1.0 / BAND)), "usd_high": F.when(known & remote, worker_usd(tiles, vcpus, workers, most, threads, 1.0 * BAND)),
        "shuffle_usd": F.when(known & remote & two_tier, raw / 1e9 * SHUFFLE_GB), "storage_usd_per_month": F.when(known, raw * DEFLATE / 1e9 * STORAGE_GB_MONTH).otherwise(0.0),
    }
