"""Near duplicates by SimHash, found at the anchors of a covering code.

The 64 bits are cut into blocks of 21, 21 and 22. Each block, padded to 23 bits, lies within 3 bits
of exactly one word of the perfect binary Golay code, so the products of three code words are anchors
of covering radius 3 in every block. For fingerprints x and y at distance 2 or less some z lies within
1 of both; z's anchor lies within the radius plus 1 of both, and only in the block where z differs can
the extra bit fall. Each distinct fingerprint is therefore replicated to its own anchor and to those
which replace one block's word by one at distance 4 (14 on average): radius plus half the threshold for
both sides, which meets all pairs that radius plus threshold for one side would. At each anchor,
fingerprints are compared exactly; tasks pass on stars over what they linked, never pairs.

Defined results: a null or empty text, or one without words, has fingerprint 0; a text of one or two
words has one shingle, the whole sequence; equal fingerprints link; repeated rows link to themselves; an
empty table gives an empty table; other columns are ignored. Rows whose doc_id is null are left out of
components and keep a null component_id.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_AZ, binary, bounds, components, local_roots, slices, sorted_chunks, stage, tidy

#: The generator polynomial of the Golay code of length 23, and the cuts of the fingerprint (fixed values).
GOLAY, LENGTH, CHECK_BITS = 0b110001110101, 23, 11
CUTS = ((0, 21), (21, 21), (42, 22))
THRESHOLD = 2


def remainder(v: int) -> int:
    for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
        if v >> bit & 1:
            v ^= GOLAY << (bit - CHECK_BITS)
    return v


@functools.cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low and high bits, the correction of each syndrome, and its patterns of weight 4 (0: none)."""
    bit = np.array([remainder(1 << i) for i in range(LENGTH)])
    low, high = np.zeros(1 << 12, dtype=np.int64), np.zeros(1 << 11, dtype=np.int64)
    for i in range(12):
        low ^= np.where(np.arange(1 << 12) >> i & 1, bit[i], 0)
    for i in range(11):
        high ^= np.where(np.arange(1 << 11) >> i & 1, bit[12 + i], 0)
    home = np.zeros(1 << CHECK_BITS, dtype=np.int64)
    further: list[list[int]] = [[] for _ in range(1 << CHECK_BITS)]
    for weight in range(5):
        for places in itertools.combinations(range(LENGTH), weight):
            pattern, syndrome = sum(1 << p for p in places), int(np.bitwise_xor.reduce(bit[list(places)])) if places else 0
            if weight < 4:
                home[syndrome] = pattern
            else:
                further[syndrome].append(pattern)
    table = np.zeros((1 << CHECK_BITS, max(map(len, further))), dtype=np.int64)
    for s, patterns in enumerate(further):
        table[s, : len(patterns)] = patterns
    return low, high, home, table


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For fingerprints (uint64): the number of the print, and each anchor (36 bits) that it goes to."""
    low, high, home, table = golay()
    homes, others = [], []
    for start, width in CUTS:
        v = (prints >> np.uint64(start) & np.uint64((1 << width) - 1)).astype(np.int64)
        syndrome = low[v & 0xFFF] ^ high[v >> 12]
        homes.append((v ^ home[syndrome]) >> CHECK_BITS)  # the leading 12 bits tell the code word
        patterns = table[syndrome]
        others.append(np.where(patterns > 0, (v[:, None] ^ patterns) >> CHECK_BITS, -1))
    place = np.arange(len(prints))
    who, where = [place], [homes[0] | homes[1] << 12 | homes[2] << 24]
    for k in range(3):
        rest = where[0] & ~(0xFFF << 12 * k)
        row, column = np.nonzero(others[k] >= 0)
        who.append(row)
        where.append(rest[row] | others[k][row, column] << 12 * k)
    return np.concatenate(who), np.concatenate(where)


def fingerprint(words: list[bytes]) -> int:
    """SimHash of lower-cased words: a bit is set if over half of the shingles' hashes have it."""
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < 3 else list(map(b" ".join, zip(words, words[1:], words[2:])))  # noqa: B905
    ones, step = np.zeros(64, dtype=np.int64), 1 << 16
    for i in range(0, len(grams), step):
        h = np.array([xxhash.xxh64_intdigest(g, 42) for g in grams[i : i + step]], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(grams), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as bigint) of each whole text."""

    def run(batches):
        for batch in slices(batches, "text"):
            fp = np.array([fingerprint(t.translate(LOWER_AZ).split()) for t in binary(batch.column("text"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(tidy(run), "doc_id bigint, fp bigint")


def linked_in_group(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (as places) that join all of a group's prints which are linked: all near pairs of a small
    group; in a large one each print looks up its own variants, so work grows with its size alone."""
    n = len(prints)
    if n <= 2048:
        a, b = np.nonzero(np.triu(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= THRESHOLD, 1))
        return a, b
    ranked = np.argsort(prints)
    values = prints[ranked]
    found_a, found_b = [], []
    single = [np.uint64(1 << i) for i in range(64)]
    for mask in itertools.chain(single, (x | y for x, y in itertools.combinations(single, 2))):
        at = np.searchsorted(values, values ^ mask)
        at[at == n] = 0
        hit = np.flatnonzero(values[at] == values ^ mask)
        hit = hit[hit < at[hit]]
        found_a.append(ranked[hit])
        found_b.append(ranked[at[hit]])
    return np.concatenate(found_a), np.concatenate(found_b)


def links_at_anchors(batches):
    """Over rows sorted by anchor: stars (a, b) over the prints that are linked there."""
    for chunk in sorted_chunks(batches, "anchor"):
        anchor, prints = chunk.column("anchor").to_numpy(), chunk.column("fp").to_numpy().view(np.uint64)
        cut = bounds(anchor)
        width = np.diff(cut)
        of, pairs = np.repeat(np.arange(len(width)), width), []
        small = width[of] <= 64
        for k in range(1, int(min(64, width.max(initial=1)))):
            near = np.flatnonzero((of[k:] == of[:-k]) & small[k:] & (np.bitwise_count(prints[k:] ^ prints[:-k]) <= THRESHOLD))
            pairs.append((prints[near], prints[near + k]))
        for g in np.flatnonzero(width > 64):
            own = prints[cut[g] : cut[g + 1]]
            a, b = linked_in_group(own)
            pairs.append((own[a], own[b]))
        if not pairs:
            continue
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*pairs, strict=True))
        names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = local_roots(len(names), place[: len(a)], place[len(a) :])
        leaf = np.flatnonzero(root != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(names[leaf]), pa.array(names[root[leaf]])], ["a", "b"])


def replicate(batches):
    for batch in batches:
        fp = batch.column("fp").to_numpy()
        for i in range(0, len(fp), 1 << 16):
            who, where = anchors(fp[i : i + (1 << 16)].view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(fp[i : i + (1 << 16)][who])], ["anchor", "fp"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id: the smallest doc_id that links of two differing bits reach."""
    prints = stage(fingerprints(docs))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    placed = distinct.select("fp").mapInArrow(tidy(replicate), "anchor bigint, fp bigint").repartition("anchor").sortWithinPartitions("anchor")
    roots = components(placed.mapInArrow(tidy(links_at_anchors), "a bigint, b bigint"))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = stage(named)
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_print = stage(named.join(least, "root").select(F.col("fp").alias("of"), "component_id"))
    joined = prints.join(of_print, F.col("fp") == F.col("of"), "left")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
