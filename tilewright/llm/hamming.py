"""Near duplicates among embeddings by iterative quantisation and multi-index Hamming tables.

A rotation is learnt on a bounded sample of unit vectors (principal axes, then alternating between the
nearest signs and the orthogonal Procrustes solution), giving 64 balanced bits. The code's eight bytes
index 28 tables, one for each pair of bytes: two codes that differ in six bits or fewer share at least
two bytes, so they meet in a table. What meets is compared by the cosine of the original vectors in
double precision. A pair that meets in several tables counts in the first only (its two first equal
bytes). Identical vectors are folded into one node, with a number of its own and a multiplicity, first. A bucket above ``block`` vectors
is cut into blocks, and every two blocks are compared as a task's group of their own, so nothing is
dropped and no task holds an unbounded group.

Defined results: null vectors, zero vectors and those that hold null or non-finite components, and those
whose label is null, link with nothing and are kept; vectors of another length than most are compared
with those of their own length only (a plan for each length); repeated rows link; rows without vec_id link like others, but no component is
named after them: where none of its rows has a vec_id, component_id is null and its rows are kept, and in a named
component they are not; rows that share a vec_id are rows of their own; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounds, components, local_roots, sorted_chunks, stage

#: Vectors at most (about) on which the rotation is learnt.
SAMPLE = 20_000
BITS = 64
PAIRS = tuple(itertools.combinations(range(BITS // 8), 2))
COSINE = 0.98
BLOCK = 2048


def rotation(x: np.ndarray, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """dims x 64: projection to principal axes and the rotation that makes signs lose least.

    Fewer dimensions than bits: further bits come from seeded random directions.
    """
    dims = x.shape[1]
    k = min(dims, BITS)
    rng = np.random.default_rng(seed)
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :k] if len(x) else np.eye(dims)[:, :k]
    v = x @ axes
    r = np.linalg.qr(rng.standard_normal((k, k)))[0]
    for _ in range(rounds if len(x) else 0):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = w.T @ u.T
    out = axes @ r
    return np.hstack([out, rng.standard_normal((dims, BITS - k))]) if k < BITS else out


def unit(column: pa.Array, dims: int) -> np.ndarray:
    """Unit vectors in double precision from a binary column of components (4 or 8 bytes each)."""
    raw = column.to_pylist()
    kind = "<f4" if raw and len(raw[0]) == 4 * dims else "<f8"
    x = np.frombuffer(b"".join(raw), dtype=kind).reshape(-1, dims).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # very small and very large vectors neither under- nor overflow
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def vectors(df: DataFrame) -> DataFrame:
    """vec_id, label, dims, v: the components in binary, as wide as they came; null where a vector links with nothing."""
    bad = "exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    usable = f"coalesce(embedding is not null and size(embedding) > 0 and label is not null and not coalesce({bad}, true) and exists(embedding, x -> x <> 0), false)"
    kind = "<f4" if dict(df.dtypes)["embedding"] == "array<float>" else "<f8"

    def run(batches):
        for batch in batches:
            values = [np.array(x, dtype=kind) + 0.0 if x is not None else None for x in batch.column("embedding").to_pylist()]  # minus zero becomes zero
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([None if x is None else len(x) for x in values], pa.int32()), pa.array([None if x is None else x.astype(kind).tobytes() for x in values], pa.binary())], ["vec_id", "label", "dims", "v"])

    own = df.selectExpr("cast(vec_id as bigint) vec_id", "cast(label as string) label", f"if({usable}, cast(embedding as array<{'float' if kind == '<f4' else 'double'}>), null) embedding")
    return own.mapInArrow(run, "vec_id bigint, label string, dims int, v binary")


def learn(folded: DataFrame, dims: int, sample: int) -> np.ndarray:
    """The rotation, from about ``sample`` vectors at most, chosen by a hash of their content."""
    n = folded.count()
    part = min(1.0, sample / max(n, 1))
    rows = folded.where(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < int(part * (1 << 20))).select("v").orderBy("v").limit(2 * sample).collect()
    return rotation(unit(pa.array([bytes(r.v) for r in rows], pa.binary()), dims))


def encode(dims: int, turn: np.ndarray):
    """The rows with their codes."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                code = np.packbits(unit(batch.column("v"), dims) @ turn >= 0, axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in code], pa.binary())], [*batch.schema.names, "code"])

    return run


def keyed(coded: DataFrame) -> DataFrame:
    """One row for each of the tables, with ``t`` and a key of label, table and its two bytes."""
    places = F.array(*(F.struct(F.lit(t).alias("t"), F.concat(F.substring("code", i + 1, 1), F.substring("code", j + 1, 1)).alias("at")) for t, (i, j) in enumerate(PAIRS)))
    return coded.withColumn("k", F.explode(places)).withColumns({"t": F.col("k.t"), "key": F.xxhash64("k.t", "k.at", "label")}).drop("k")


def compare(dims: int, cosine: float):
    """Over rows sorted by group: for each vector the number of vectors linked there, and stars over links."""

    def run(batches):
        for chunk in sorted_chunks(batches, "g"):
            cut = bounds(chunk.column("g").to_numpy())
            if len(cut) == chunk.num_rows + 1 and chunk.num_rows:
                continue
            ids, label = chunk.column("node").to_numpy(), np.unique(np.array(chunk.column("label").to_pylist(), dtype=object).astype(str), return_inverse=True)[1]
            x, many = unit(chunk.column("v"), dims), chunk.column("n").to_numpy()
            code = np.frombuffer(b"".join(chunk.column("code").to_pylist()), dtype=np.uint8).reshape(-1, BITS // 8)
            table, side = chunk.column("t").to_numpy(), chunk.column("side").to_numpy()
            who, n_links, star_a, star_b = [], [], [], []
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                if e - s < 2:
                    continue
                links, near_a, near_b = np.zeros(e - s, dtype=np.int64), [], []
                for at in range(s, e, 1024):
                    top = min(e, at + 1024)
                    a, b = np.nonzero(x[at:top] @ x[s:e].T >= cosine - 1e-9)  # 1,024 rows against the block at most
                    a, b = a + at, b + s
                    # each unordered pair once; of two blocks, only what crosses them
                    ok = (ids[a] < ids[b]) & (label[a] == label[b]) & ((side[a] != side[b]) | (side[a] == 0))
                    a, b = a[ok], b[ok]
                    exact = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
                    a, b = a[exact], b[exact]
                    equal = code[a] == code[b]
                    first = equal.argmax(axis=1)
                    equal[np.arange(len(a)), first] = False
                    mine = np.array([p[0] for p in PAIRS])[table[a]] == first
                    mine &= np.array([p[1] for p in PAIRS])[table[a]] == equal.argmax(axis=1)
                    a, b = a[mine], b[mine]
                    np.add.at(links, a - s, many[b])
                    np.add.at(links, b - s, many[a])
                    root = local_roots(e - s, a - s, b - s)
                    leaf = np.flatnonzero(root != np.arange(e - s))
                    near_a.append(leaf)
                    near_b.append(root[leaf])
                root = local_roots(e - s, np.concatenate(near_a), np.concatenate(near_b))
                found = np.flatnonzero(links)
                who.append(ids[s:e][found])
                n_links.append(links[found])
                star_a.append(ids[s:e][found])
                star_b.append(ids[s:e][root[found]])
            if who:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(y)) for y in (who, n_links, star_b)], ["node", "links", "root"])

    return run


def near_duplicates(df: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``df`` (vec_id, embedding, label)."""
    spark = df.sparkSession
    own = stage(vectors(df))
    folded = own.where("v is not null").groupBy("label", "dims", "v").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"))
    folded = stage(folded.withColumn("node", F.monotonically_increasing_id()))
    links = None
    for dims in sorted(r.dims for r in folded.select("dims").distinct().collect()):
        same = folded.where(F.col("dims") == dims)
        turn = learn(same, dims, sample)
        coded = stage(same.select("label", "node", "n", "v").mapInArrow(encode(dims, turn), "label string, node bigint, n bigint, v binary, code binary"))
        # counted without the vectors; where the few crowded keys are a small table, Spark joins them without a shuffle
        crowded = stage(keyed(coded.select("label", "code")).groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > block))
        cut = keyed(coded).join(crowded, "key", "left").withColumn("parts", F.coalesce(F.ceil(F.col("size") / block), F.lit(1)).cast("int"))
        cut = cut.withColumn("part", F.pmod(F.xxhash64("node", F.lit(5)), F.col("parts")).cast("int"))
        cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        cut = cut.withColumn("g", F.when(F.col("parts") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"))))
        # side 0: a block with itself; 1 and 2: the two blocks of a crossing
        cut = cut.withColumn("side", F.expr("case when part = other then 0 when part < other then 1 else 2 end"))
        found = cut.select("g", "t", "side", "label", "node", "n", "v", "code").repartition("g").sortWithinPartitions("g").mapInArrow(compare(dims, cosine), "node bigint, links bigint, root bigint")
        links = found if links is None else links.union(found)
    if links is None:
        links = spark.createDataFrame([], "node bigint, links bigint, root bigint")
    links = stage(links)
    roots = components(links.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("root", "top")
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    per = stage(folded.join(counted, "node", "left").join(roots, "node", "left").select("label", "dims", "v", "first_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("top", "node").alias("top")))
    named = per.groupBy("top").agg(F.min("first_id").alias("component_id"))
    per = stage(per.join(named, "top").select(F.col("label").alias("l"), F.col("dims").alias("d"), F.col("v").alias("w"), "n_links", "component_id"))
    joined = own.join(per, (F.col("label") == F.col("l")) & (F.col("dims") == F.col("d")) & (F.col("v") == F.col("w")), "left")
    component = F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
