"""Helpers that the corpus operators share: staging, streaming of sorted groups, components.

Tables are staged as Parquet below the folder named by ``spark.checkpoint.dir``, which every
executor of a cluster can read, so a lost executor costs a re-read and no recomputation.
"""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII capitals to small letters, every other byte unchanged.
LOWER_AZ = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a fresh temporary one only where none is set (tests)."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="tilewright-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, lineage cut."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


class Vocab(dict):
    """Numbers its keys in the order in which they are first looked up."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def binary(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, nulls as empty."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    elif pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    return [x or b"" for x in column.to_pylist()]


def give_back() -> None:
    """Returns freed memory to the system: workers wait idle between stages and would keep it."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)


def keep_heap() -> None:
    """Lets this process keep freed blocks of up to 64 MB for the next array, which saves most of the time that
    loops over mid-sized arrays take; ``give_back`` returns them at a task's end."""
    if sys.platform == "linux":
        own = getattr(ctypes.CDLL(None), "mallopt", None)  # glibc only
        if own is not None:
            own(-3, 64 << 20)  # from what size on a block is mapped by itself
            own(-1, 128 << 20)  # how much may stay free at the heap's end


def tidy(run):
    """``run``, a function over the batches of a task, after whose end freed memory goes back."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that no slice of two rows or more holds over ``most`` bytes of ``column``."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.array([0 if n is None else n for n in pc.binary_length(batch.column(column)).to_pylist()], dtype=np.int64)
        start, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def sorted_chunks(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that arrive sorted by the integer column ``key``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(keys, keys[-1], side="left"))
        if last == 0 and (not held or held[-1].column(key)[-1].as_py() == keys[0]):
            held.append(batch)
            continue
        whole = [*held, batch.slice(0, last)] if last else held
        yield pa.Table.from_batches(whole)
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def bounds(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the length at the end."""
    if len(keys) == 0:
        return np.zeros(1, dtype=np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]).astype(np.int64)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 joined by the pairs ``a``, ``b``: the smallest node of each one's component."""
    root = np.arange(n, dtype=np.int64)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (jumped := root[root]).tobytes() != root.tobytes():
            root = jumped
    return root


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: bigint): one row (node, root) for each node of an edge,
    root being the smallest node of its component.

    Alternates large-star and small-star steps, each a partial aggregation and a join that adaptive
    execution may split for skew; every round is staged, so plans stay short. No size cap.
    """
    e = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda x: x.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h"), F.sum(F.hash("a", "b").cast("long")).alias("s")).first()
    before = mark(e)
    while before["n"]:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # a node hands its smallest neighbour to the larger ones
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e = stage(small.where("a <> b").distinct())
        after = mark(e)
        if after == before:
            break
        before = after
    roots = e.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
