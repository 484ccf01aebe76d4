"""Scoring texts with causal self-attention over subword ids, trained in numpy on all training texts.

A word is split into subword ids of a public vocabulary. Its probability is that of its first subword, given
the texts so far, times that of the word among all words with this first subword:

- The *sequence* field runs over the first subwords of a text's words and an end, so every token is one place.
  One layer: an embedding of the place before, causal attention over a window with a learnt bias for each
  distance, a hidden layer, then a softmax over groups of classes and one over the classes of a group; frequent
  subwords are classes of their own, and within the other classes corpus counts decide. A text is cut into blocks of
  ``half`` places; a block's queries see their own block up to themselves and the block before, so windows of
  twice ``half`` overlap by half and every token is scored once. Blocks are batched with a mask.
- Among the words with one first subword, training counts are discounted by an absolute amount, and what they give
  up goes to the *spelling* field: the same kind of field over the further subwords of a word and its end. The
  discount is n1 / (n1 + 2 n2) of the words that training meets once and twice: no weight is chosen by hand
  or on held-out texts. All this is a distribution over all words.

Corpus side. Tasks cut the documents into slices, number the distinct words of each and deal them out by a
hash into buckets (one for about ``BUCKET_BYTES`` of text), a packed row for each slice and bucket, so a frequent
word costs a row's entry for each slice and not for each occurrence. A bucket adds up its words' counts, splits each
distinct word once, and answers each slice. A slice's documents become streams of first subwords; these are
dealt into units (one for about ``UNIT_BYTES`` of text) by a hash of doc_id and stream, and sorted by it; distinct
training words into units of about ``UNIT_WORDS``, by bucket.

Training. The spelling field trains on every distinct word of the training texts, the sequence field on every
block of every training text; with a ``stride`` above one, on every stride-th only. Blocks are dealt over
``rounds``; in each, every unit takes Adam steps on its share from the current weights, and the units' weights are
averaged, weighted by blocks, in fixed point. So results depend on the documents alone, not on files, partitions
or tasks.

Defined results: null text is an empty text: one end token; repeated rows agree; an empty table gives an
empty table; a training part without documents leaves N and V zero and untrained fields; a null doc_id counts as
not held out; other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import Vocab, keep_heap, slices, stage, tidy

WIDTH, HIDDEN, GROUPS, MEMBERS, IN_CLASSES, IN_REST = 16, 32, 32, 32, 1024, 64
#: Places of a block: words of a text, subwords of a word.
HALF, SPELL_HALF = 16, 4
STRIDE, ROUNDS, RATE, STEP, SPELL_STEP = 1, 2, 0.08, 512, 1024
#: Steps that a unit's share of a round makes at least, with fewer blocks each, if it has the blocks.
LEAST_STEPS = 20
#: Places scored at a time.
BATCH = 8192
BUCKET_BYTES, LEAST_BUCKETS, UNIT_BYTES, UNIT_WORDS = 8 << 20, 16, 4 << 20, 150_000
END = 50_256  # free in the vocabulary
SIZE = END + 1
#: Stands for the place before a text.
BEGIN = SIZE
SHIFT = 24


# The fields.


class Classes:
    """Input and output classes of the subwords, and log shares within output classes, from corpus counts."""

    def __init__(self, counts: np.ndarray):
        rank = np.empty(SIZE, dtype=np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(SIZE)
        self.into = np.append(np.where(rank < IN_CLASSES, rank, IN_CLASSES + np.arange(SIZE) % IN_REST), IN_CLASSES + IN_REST).astype(np.int32)
        own = (GROUPS - 1) * MEMBERS
        # what has no class of its own: the last group, bands of falling frequency
        band = np.minimum((np.log2(np.maximum(rank - own, 0) + 1) * MEMBERS / np.log2(SIZE)).astype(np.int64), MEMBERS - 1)
        self.out = np.where(rank < own, rank, own + band).astype(np.int32)
        mass = counts + 0.5
        of_class = np.bincount(self.out, weights=mass, minlength=GROUPS * MEMBERS)
        self.share = np.log(mass / of_class[self.out]).astype(np.float32)
        self.start = (of_class + 1e-3).reshape(GROUPS, MEMBERS)


NAMES = ("emb", "q", "k", "v", "o", "w1", "b1", "wg", "bg", "wm", "bm", "dist")


def shapes(half: int) -> dict[str, tuple[int, ...]]:
    d, h = WIDTH, HIDDEN
    return {"emb": (IN_CLASSES + IN_REST + 1, d), "q": (d, d), "k": (d, d), "v": (d, d), "o": (d, d), "w1": (2 * d, h), "b1": (h,), "wg": (h, GROUPS), "bg": (GROUPS,), "wm": (GROUPS, h, MEMBERS), "bm": (GROUPS, MEMBERS), "dist": (2 * half,)}


def fresh(classes: Classes, half: int, seed: int = 1) -> dict[str, np.ndarray]:
    """Seeded weights, the output's biases at the corpus shares."""
    rng = np.random.default_rng(seed)
    p = {}
    for name, shape in shapes(half).items():
        scale = {"emb": 0.3, "wg": 0.1, "wm": 0.1}.get(name, 1.0) / (1 if name == "emb" else np.sqrt(shape[-2] if len(shape) > 1 else 1))
        p[name] = (rng.standard_normal(shape) * scale).astype(np.float32) if name not in ("b1", "bg", "bm", "dist") else np.zeros(shape, np.float32)
    p["bg"][:] = np.log(classes.start.sum(axis=1) / classes.start.sum())
    p["bm"][:] = np.log(classes.start / classes.start.sum(axis=1, keepdims=True))
    return p


@functools.cache
def masks(half: int) -> tuple[np.ndarray, np.ndarray]:
    """What query i may see of a window (the block before, then the own block), and the distances."""
    place, query = np.arange(2 * half)[None, :], half + np.arange(half)[:, None]
    return (place <= query).astype(np.float32), np.clip(query - place, 0, 2 * half - 1)


@dataclass
class Blocks:
    """Streams cut into blocks. past: the id before each place; ids: the id at it; live: places in use; first:
    blocks without one before; of: each block's stream."""

    past: np.ndarray
    ids: np.ndarray
    live: np.ndarray
    first: np.ndarray
    of: np.ndarray


def lay_out(ids: np.ndarray, lengths: np.ndarray, leads: np.ndarray | int, half: int) -> Blocks:
    """Streams one after another in ``ids`` as blocks; leads: the id before each stream."""
    blocks = -(-lengths // half)
    starts = np.concatenate([[0], np.cumsum(blocks)])
    n = int(starts[-1])
    padded, past = np.full(n * half, END, dtype=np.uint16), np.empty(n * half, dtype=np.uint16)
    at = np.arange(len(ids)) + np.repeat(starts[:-1] * half - (np.cumsum(lengths) - lengths), lengths)
    padded[at] = ids
    past[1:] = padded[:-1]
    some = lengths > 0
    past[starts[:-1][some] * half] = leads if np.isscalar(leads) else leads[some]
    live = np.zeros(n * half, dtype=bool)
    live[at] = True
    first = np.zeros(n, dtype=bool)
    first[starts[:-1][some]] = True
    return Blocks(past.reshape(n, half), padded.reshape(n, half), live.reshape(n, half), first, np.repeat(np.arange(len(lengths)), blocks))


def by_group(groups: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order that brings equal groups together, and each group that occurs with its stretch."""
    order = np.argsort(groups.astype(np.uint8), kind="stable")
    cuts = np.searchsorted(groups[order], np.arange(GROUPS + 1))
    return order, [(int(g), slice(int(cuts[g]), int(cuts[g + 1]))) for g in np.flatnonzero(np.diff(cuts))]


def flat(m: np.ndarray) -> np.ndarray:
    return m.reshape(-1, m.shape[-1])


ONES = np.ones((max(MEMBERS, GROUPS, 2 * HALF), 1), dtype=np.float32)


def add_row(x: np.ndarray, row: np.ndarray) -> None:
    """Adds ``row`` to each row of ``x``, many rows at a time: loops over single short rows cost more than their sums."""
    even = len(x) & ~63
    many = x[:even].reshape(-1, 64 * len(row))
    many += np.tile(row, 64)
    x[even:] += row


def add_rows(x: np.ndarray) -> np.ndarray:
    """The sum of the rows, as a product, which is faster than a sum over the first axis."""
    return (np.ones((1, len(x)), dtype=x.dtype) @ x)[0]


def turned(x: np.ndarray) -> np.ndarray:
    """Each matrix transposed, laid out anew: products of many small matrices are slow with a transposed right side."""
    return np.ascontiguousarray(x.transpose(0, 2, 1))


def pick(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places in the flat ``x`` of the column y of each row."""
    return np.arange(0, x.size, x.shape[1]) + y


def settle(x: np.ndarray, some: np.ndarray) -> None:
    """Brings logits into the range of exp, row by row, where any row needs it; some: a logit of each row. Small
    ones beside it do no harm."""
    if x.size and (x.max() > 60 or some.min() < -60):
        x -= x.max(axis=-1, keepdims=True)


def attend(a: np.ndarray, near: np.ndarray, hide: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Attention weights from logits, in place. near: the bias of each distance; hide: zero where a query may not look."""
    half = a.shape[1]
    a += near
    if a.size and (a.max() > 60 or a.diagonal(half, 1, 2).min() < -60):  # the diagonal: a query's own place
        a += (hide - 1) * np.float32(1e9)
        a[first, :, :half] = -1e9
        a -= a.max(axis=2, keepdims=True)
    np.exp(a, out=a)
    a *= hide
    a[first, :, :half] = 0
    a /= (flat(a) @ ONES[: 2 * half]).reshape(*a.shape[:2], 1)
    return a


def hidden(p: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray):
    """Hidden layer of windows. x: batch x 2*half input classes; first: windows whose block before is not of the text.
    Keys and values depend on the class alone, so they are looked up in tables of classes."""
    n, half = len(x), x.shape[1] // 2
    hide, gap = masks(half)
    now = p["emb"].take(x[:, half:], axis=0)
    q = (flat(now) @ (p["q"] / np.float32(np.sqrt(WIDTH)))).reshape(n, half, WIDTH)
    kv = (p["emb"] @ np.concatenate([p["k"], p["v"]], axis=1)).take(x, axis=0)
    k, v = kv[..., :WIDTH], kv[..., WIDTH:]
    a = attend(q @ turned(k), p["dist"].take(gap), hide, first)
    c = a @ v
    z = np.concatenate([flat(now), flat(c) @ p["o"]], axis=1)
    h = z @ p["w1"]
    add_row(h, p["b1"])
    np.maximum(h, np.zeros_like(h), out=h)
    return h, (now, q, k, v, a, c, z)


def group_logits(p: dict[str, np.ndarray], rows: np.ndarray, group: np.ndarray, parts: list[tuple[int, slice]]) -> np.ndarray:
    """Logits within the groups, of rows that are brought together by group."""
    out = np.empty((len(rows), MEMBERS), dtype=np.float32)
    for g, own in parts:
        np.matmul(rows[own], p["wm"][g], out=out[own])
    out += p["bm"].take(group, axis=0)
    return out


def log_soft(logits: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log softmax at y; the logits are overwritten."""
    at = pick(logits, y)
    settle(logits, logits.take(at))
    picked = logits.take(at)
    np.exp(logits, out=logits)
    return picked - np.log(logits @ ONES[: logits.shape[1]])[:, 0]


def log_class(p: dict[str, np.ndarray], h: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log probability of the classes y at hidden rows h."""
    group, member = y // MEMBERS, y % MEMBERS
    order, parts = by_group(group)
    top = h @ p["wg"]
    add_row(top, p["bg"])
    out = log_soft(top, group)
    out[order] += log_soft(group_logits(p, h.take(order, axis=0), group[order], parts), member[order])
    return out


def soft_minus(logits: np.ndarray, y: np.ndarray, n: np.float32) -> np.ndarray:
    """n times the softmax less the indicator of y, in place."""
    at = pick(logits, y)
    settle(logits, logits.take(at))
    np.exp(logits, out=logits)
    logits *= n / (logits @ ONES[: logits.shape[1]])
    logits.reshape(-1)[at] -= n
    return logits


def gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, live: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean negative log probability over the live places."""
    half = x.shape[1] // 2
    h, (now, q, k, v, a, c, z) = hidden(p, x, first)
    place = np.flatnonzero(live.reshape(-1))
    y = y.reshape(-1)[place]
    n = np.float32(1 / max(len(place), 1))
    order, parts = by_group(y // MEMBERS)
    place, y = place[order], y[order]
    rows, group = h.take(place, axis=0), y // MEMBERS
    top = rows @ p["wg"]
    add_row(top, p["bg"])
    g = soft_minus(top, group, n)
    out = {"wg": rows.T @ g, "bg": add_rows(g), "wm": np.zeros_like(p["wm"]), "bm": np.zeros_like(p["bm"])}
    drows = g @ p["wg"].T
    g = soft_minus(group_logits(p, rows, group, parts), y % MEMBERS, n)
    for one, own in parts:
        np.matmul(rows[own].T, g[own], out=out["wm"][one])
        drows[own] += g[own] @ p["wm"][one].T
        out["bm"][one] = add_rows(g[own])
    drows *= rows > 0
    dh = np.zeros_like(h)
    dh[place] = drows
    out["w1"], out["b1"] = z.T @ dh, add_rows(drows)
    dz = dh @ p["w1"].T
    dnow, dco = dz[:, :WIDTH], dz[:, WIDTH:]
    out["o"] = flat(c).T @ dco
    dc = (dco @ p["o"].T).reshape(c.shape)
    da = dc @ turned(v)
    da -= np.einsum("ijk,ijk->ij", dc, c)[..., None]  # as much as da with a
    ds = np.multiply(da, a, out=da)
    out["dist"] = np.bincount(masks(half)[1].reshape(-1), weights=ds.sum(axis=0).reshape(-1), minlength=2 * half).astype(np.float32)
    scale = np.float32(1 / np.sqrt(WIDTH))
    dq = flat(ds @ k)
    out["q"] = flat(now).T @ dq * scale
    dkv = np.empty((*x.shape, 2 * WIDTH), dtype=h.dtype)
    np.matmul(ds.transpose(0, 2, 1), q, out=dkv[..., :WIDTH])
    np.matmul(a.transpose(0, 2, 1), dc, out=dkv[..., WIDTH:])
    dkv = sum_rows(x.reshape(-1), flat(dkv), len(p["emb"]))
    dk, dv = dkv[:, :WIDTH], dkv[:, WIDTH:]
    own = sum_rows(x[:, half:].reshape(-1), dnow + dq @ (p["q"].T * scale), len(p["emb"]))
    out["k"], out["v"] = p["emb"].T @ dk, p["emb"].T @ dv
    out["emb"] = own + dk @ p["k"].T + dv @ p["v"].T
    return out


def sum_rows(ids: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Rows added up by id."""
    ids = ids.astype(np.uint16)  # short numbers are sorted by radix
    order = np.argsort(ids, kind="stable")
    ranked = ids[order]
    cuts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ids) else np.zeros(0, dtype=np.int64)
    out = np.zeros((size, rows.shape[1]), dtype=np.float32)
    if len(cuts):
        out[ranked[cuts]] = np.add.reduceat(rows.take(order, axis=0), cuts, axis=0)
    return out


def window_classes(classes: Classes, blocks: Blocks, k: np.ndarray) -> np.ndarray:
    """Input classes of the windows of the blocks k."""
    return classes.into.take(np.concatenate([blocks.past.take(np.maximum(k - 1, 0), axis=0), blocks.past.take(k, axis=0)], axis=1))


def pack(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[name].reshape(-1) for name in NAMES])


def unpack(flat: np.ndarray, half: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in shapes(half).items():
        size = int(np.prod(shape))
        out[name] = flat[at : at + size].reshape(shape).astype(np.float32, copy=False)
        at += size
    return out


def train_unit(classes: Classes, start: np.ndarray, half: int, blocks: Blocks, turn: int, rounds: int, stride: int, rate: float, step: int) -> tuple[np.ndarray, int]:
    """Weights after Adam steps, from ``start``, on the blocks of a unit that belong to this round; and their number."""
    n = len(blocks.first)
    mine = np.arange(n)[np.arange(n) % (rounds * stride) == turn * stride]
    np.random.default_rng(turn).shuffle(mine)
    step = max(min(step, len(mine) // LEAST_STEPS), 8)
    flat = start.copy()
    p = unpack(flat, half)
    m, s = np.zeros_like(flat), np.zeros_like(flat)
    for t, i in enumerate(range(0, len(mine), step), 1):
        k = mine[i : i + step]
        g = pack(gradients(p, window_classes(classes, blocks, k), classes.out[blocks.ids[k]], blocks.live[k], blocks.first[k]))
        m *= np.float32(0.9)
        m += np.float32(0.1) * g
        g *= g
        g *= np.float32(0.01)
        s *= np.float32(0.99)
        s += g
        pace = rate * min(1.0, t / 20) / (1 + t / 400)
        np.sqrt(s, out=g)
        g += np.float32(1e-8)
        np.divide(m, g, out=g)
        g *= np.float32(pace * np.sqrt(1 - 0.99**t) / (1 - 0.9**t))
        flat -= g  # p's arrays are views of it
    return flat, len(mine)


#: Weights are added up as whole multiples of this, which is exact in any order.
POINT = 2.0**-16


class Scorer:
    """A field folded for scoring: what depends on the place before alone becomes a table of input classes."""

    def __init__(self, classes: Classes, flat: np.ndarray, half: int):
        p = self.p = unpack(flat, half)
        self.classes, self.half = classes, half
        scale = np.float32(1 / np.sqrt(WIDTH))
        self.k, self.v = p["emb"] @ p["k"], p["emb"] @ p["v"]
        self.q, self.own = p["emb"] @ p["q"] * scale, p["emb"] @ p["w1"][:WIDTH] + p["b1"]
        self.mix = p["o"] @ p["w1"][WIDTH:]
        self.hide, gap = masks(half)
        self.near = p["dist"][gap]

    def hidden(self, blocks: Blocks, a: int, b: int) -> np.ndarray:
        """Hidden rows of the live places of the blocks a to b."""
        x = window_classes(self.classes, blocks, np.arange(a, b))
        now = x[:, self.half :]
        s = attend(self.q.take(now, axis=0) @ turned(self.k.take(x, axis=0)), self.near, self.hide, blocks.first[a:b])
        c = s @ self.v.take(x, axis=0)
        out = flat(c) @ self.mix
        out += flat(self.own.take(now, axis=0))
        np.maximum(out, np.zeros_like(out), out=out)
        return out.take(np.flatnonzero(blocks.live[a:b]), axis=0)

    def __call__(self, ids: np.ndarray, lengths: np.ndarray, leads: np.ndarray | int) -> np.ndarray:
        """Natural log probability of each stream; the ids of the streams lie one after another."""
        blocks = lay_out(ids, lengths, leads, self.half)
        out, step = np.zeros(len(lengths)), max(1, BATCH // self.half)
        for a in range(0, len(blocks.first), step):
            b = min(len(blocks.first), a + step)
            live = blocks.live[a:b]
            own = blocks.ids[a:b][live]
            log_p = log_class(self.p, self.hidden(blocks, a, b), self.classes.out[own]) + self.classes.share[own]
            top = int(blocks.of[a])
            added = np.bincount(np.repeat(blocks.of[a:b] - top, live.sum(axis=1)), weights=log_p)
            out[top : top + len(added)] += added
        return out


# Corpus side.


def numbered(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of texts in the order of their first places, the number of each word of the texts, and words a text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    found, of = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    some = pc.greater(pc.binary_length(found), 0)  # white space at a text's ends leaves empty pieces
    coded = found.filter(some).dictionary_encode()
    lengths = np.bincount(of[some.to_numpy(zero_copy_only=False)], minlength=len(texts))
    return coded.dictionary.cast(pa.large_binary() if pa.types.is_large_string(found.type) else pa.binary()).to_pylist(), coded.indices.to_numpy(), lengths


def slice_rows(buckets: int):
    """Packed rows (slice, bucket, words, counts) of words, and with bucket -1 the documents of a slice."""

    def run(batches):
        part = TaskContext.get().partitionId()
        for k, batch in enumerate(slices(batches, "text", 16 << 20)):
            at = part << SHIFT | k
            held = np.array(batch.column("held_out").to_pylist(), dtype=bool)
            words, flat, lengths = numbered(batch.column("text"))
            trained = np.bincount(flat[np.repeat(~held, lengths)], minlength=len(words))
            bucket = np.fromiter((zlib.crc32(w) for w in words), dtype=np.int64, count=len(words)) % buckets
            order = np.argsort(bucket, kind="stable")
            new = np.empty(len(words), dtype=np.int32)
            new[order] = np.arange(len(words))
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out = [(at, -1, new[flat].astype("<i4").tobytes(), lengths.astype("<i8").tobytes(), held.tobytes(), np.array(batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False), dtype="<i8").tobytes(), np.array(batch.column("doc_id").is_null()).tobytes())]
            for b in np.flatnonzero(np.diff(edges)):
                own = order[edges[b] : edges[b + 1]]
                out.append((at, int(b), b" ".join([words[i] for i in own]), trained[own].astype("<i8").tobytes(), None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), *[pa.binary()] * 5), strict=True)], ["slice", "bucket", "words", "counts", "held", "docs", "no_id"])

    return run


SLICE_ROWS = "slice bigint, bucket int, words binary, counts binary, held binary, docs binary, no_id binary"
#: Kinds of the sums that a bucket adds to: words by training count (1 and 2), tokens and words by first subword,
#: further subwords of the distinct training words.
MET, TOKENS, TYPES, FURTHER = range(4)
LEXICON = -1


def answer_bucket(path: str, pattern: str):
    """Counts and subwords of a bucket's words, for each slice; as slice -1 its distinct training words, with the sums they add to."""

    def run(table: pa.Table) -> pa.Table:
        enc = bpe.encoding(path, pattern)
        names = Vocab()
        parts, counts = [], []
        for words, own in zip(table.column("words").to_pylist(), table.column("counts").to_pylist(), strict=True):
            parts.append(np.fromiter(map(names.__getitem__, words.split(b" ")), dtype=np.int64))
            counts.append(np.frombuffer(own, dtype="<i8"))
        total = np.zeros(len(names), dtype=np.int64)
        for part, own in zip(parts, counts, strict=True):
            total[part] += own  # a slice has each word once
        words = list(names)
        pieces = [enc.encode_ordinary(" " + w.decode("utf-8", "replace")) if len(w) < bpe.PIECE_CHARS else bpe.encode(enc, " " + w.decode("utf-8", "replace"), pattern) for w in words]
        length = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        flat = np.fromiter((y for x in pieces for y in x), dtype=np.int64, count=int(length.sum()))
        starts = np.concatenate([[0], np.cumsum(length)])
        bucket, rows = table.column("bucket")[0].as_py(), []
        for at, part in zip(table.column("slice").to_pylist(), parts, strict=True):
            rows.append((at, bucket, total[part].astype("<i8").tobytes(), length[part].astype("<i4").tobytes(), flat[ragged(starts, part)].astype("<u2").tobytes(), None))
        known = np.array(sorted(np.flatnonzero(total).tolist(), key=words.__getitem__), dtype=np.int64)  # in an order that no layout changes
        known = np.random.default_rng(bucket).permutation(known)
        first = flat[starts[:-1]]
        sums = [(MET, np.bincount(np.minimum(total[known], 3), minlength=4)), (TOKENS, np.bincount(first, weights=total).astype(np.int64)), (TYPES, np.bincount(first[known])), (FURTHER, np.bincount(further(flat, length, known, starts)))]
        packed = np.array([(kind, i, own[i]) for kind, own in sums for i in np.flatnonzero(own)], dtype="<i8")
        rows.append((LEXICON, bucket, total[known].astype("<i8").tobytes(), length[known].astype("<i4").tobytes(), flat[ragged(starts, known)].astype("<u2").tobytes(), packed.tobytes()))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), *[pa.binary()] * 4), strict=True)], ["slice", "bucket", "counts", "lengths", "pieces", "sums"])

    return run


ANSWERS = "slice bigint, bucket int, counts binary, lengths binary, pieces binary, sums binary"


def ragged(starts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places of the flat array that hold these rows one after another."""
    first, length = starts[rows], starts[rows + 1] - starts[rows]
    ends = np.cumsum(length)
    return np.repeat(first - ends + length, length) + np.arange(int(ends[-1]) if len(ends) else 0)


def further(flat: np.ndarray, length: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """What follows the first subword of these words: the further ones and the end."""
    out = flat[ragged(starts, rows)]
    own = length[rows]
    out = np.append(out[1:], END) if len(out) else out
    out[np.cumsum(own) - 1] = END
    return out


@dataclass
class Words:
    """What is known of all training words: discount, and tokens and distinct words by first subword."""

    discount: float
    tokens: np.ndarray
    types: np.ndarray

    def log_share(self, first: np.ndarray, counts: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """Natural log of a word's probability among the words with its first subword. spelled: the field's log probability of the rest."""
        n = self.tokens[first]
        with np.errstate(divide="ignore", invalid="ignore"):
            seen = np.log(np.maximum(counts - self.discount, 0) / n)
            new = np.log(self.discount * self.types[first] / n) + spelled
            return np.where(n > 0, np.logaddexp(seen, new), spelled)


def encode_slice(n: int, v: int, words: Words, classes: Classes, weights: np.ndarray):
    """Cogroup of a slice's documents and its words' answers: a row for each document, with its stream of first
    subwords, its base score and what its words cost beyond their first subwords."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        keep_heap()
        answers = answers.sort_by("bucket")
        counts, lengths, pieces = (np.frombuffer(b"".join(answers.column(c).to_pylist()), dtype=t) for c, t in (("counts", "<i8"), ("lengths", "<i4"), ("pieces", "<u2")))
        lengths = lengths.astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        first = pieces[starts[:-1]].astype(np.int64)
        base = np.log10((counts + 0.1) / (n + 0.1 * (v + 1)))
        field, share = Scorer(classes, weights, SPELL_HALF), np.empty(len(lengths))
        for a in range(0, len(lengths), 1 << 16):
            b = min(len(lengths), a + (1 << 16))
            own = pieces[starts[a] : starts[b]].astype(np.int64)
            spelled = field(further(own, lengths[a:b], np.arange(b - a), starts[a : b + 1] - starts[a]), lengths[a:b], first[a:b])
            share[a:b] = words.log_share(first[a:b], counts[a:b], spelled)
        rows = []
        for r in docs.select(["words", "counts", "held", "docs", "no_id"]).to_pylist():
            flat, sizes = np.frombuffer(r["words"], dtype="<i4"), np.frombuffer(r["counts"], dtype="<i8")
            cut = np.concatenate([[0], np.cumsum(sizes)])
            stream = first.take(flat).astype("<u2")
            of = np.repeat(np.arange(len(sizes)), sizes)
            known, based, rest = (np.bincount(of, weights=x.take(flat), minlength=len(sizes)).tolist() for x in (counts > 0, base, share))
            for k, (doc, none, held) in enumerate(zip(np.frombuffer(r["docs"], dtype="<i8").tolist(), np.frombuffer(r["no_id"], dtype=bool).tolist(), np.frombuffer(r["held"], dtype=bool).tolist(), strict=True)):
                rows.append((None if none else doc, held, int(sizes[k]), int(known[k]), based[k], rest[k], stream[cut[k] : cut[k + 1]].tobytes()))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()), strict=True)], ["doc_id", "held_out", "n_words", "n_known", "base", "rest", "stream"])

    return run


ENCODED = "doc_id bigint, held_out boolean, n_words bigint, n_known bigint, base double, rest double, stream binary"


def streams(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The streams one after another, each with its end, and their lengths."""
    end = np.array([END], dtype="<u2").tobytes()
    return np.frombuffer(b"".join(x + end for x in rows), dtype="<u2"), np.array([len(x) // 2 + 1 for x in rows], dtype=np.int64)


def units_of(batches) -> Iterator[tuple[int, list[bytes]]]:
    """The streams of each unit, from rows that come sorted by unit."""
    at, held = None, []
    for batch in batches:
        for unit, stream in zip(batch.column("unit").to_pylist(), batch.column("stream").to_pylist(), strict=True):
            if unit != at:
                if held:
                    yield at, held
                at, held = unit, []
            held.append(stream)
    if held:
        yield at, held


def sequence_blocks(batches) -> Iterator[Blocks]:
    for _, rows in units_of(batches):
        yield lay_out(*streams(rows), BEGIN, HALF)


def spelling_blocks(batches) -> Iterator[Blocks]:
    """The words of each unit, from rows that come sorted by unit, then bucket."""

    def blocks(lengths: list[bytes], pieces: list[bytes]) -> Blocks:
        n, flat = np.frombuffer(b"".join(lengths), dtype="<i4").astype(np.int64), np.frombuffer(b"".join(pieces), dtype="<u2").astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(n)])
        return lay_out(further(flat, n, np.arange(len(n)), starts), n, flat[starts[:-1]], SPELL_HALF)

    at, held = None, ([], [])
    for batch in batches:
        for i in range(batch.num_rows):
            unit, own = batch.column("unit")[i].as_py(), [batch.column(c)[i].as_py() for c in ("lengths", "pieces")]
            if unit != at and held[0]:
                yield blocks(*held)
                held = ([], [])
            at = unit
            if own[0]:
                held[0].append(own[0])
                held[1].append(own[1])
    if held[0]:
        yield blocks(*held)


SUMS = "value binary, weight bigint"


def sum_row(total: np.ndarray, weight: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary()), pa.array([weight], pa.int64())], ["value", "weight"])


def add_up(batches):
    """One row: the sums of a task's rows."""
    total, weight = None, 0
    for batch in batches:
        for i in range(batch.num_rows):
            own = np.frombuffer(batch.column("value")[i].as_py(), dtype="<f8")
            total, weight = own.copy() if total is None else total + own, weight + batch.column("weight")[i].as_py()
    if total is not None:
        yield sum_row(total, weight)


def fit(rows: DataFrame, blocks_of, classes: Classes, half: int, step: int, stride: int, rounds: int, fan: int = 32) -> np.ndarray:
    """Weights of a field trained on the blocks that ``blocks_of`` makes of each task's rows, ``rounds`` times averaged."""
    weights = pack(fresh(classes, half))
    for turn in range(rounds):
        start = weights

        def run(batches, start=start, turn=turn):
            keep_heap()
            total, seen = np.zeros(len(start)), 0
            for blocks in blocks_of(batches):
                own, n = train_unit(classes, start, half, blocks, turn, rounds, stride, RATE / (1 + turn), step)
                total += np.rint(own.astype(np.float64) / POINT) * n  # whole numbers: their sums are exact in any order
                seen += n
            if seen:
                yield sum_row(total, seen)

        sums = stage(rows.mapInArrow(tidy(run), SUMS))
        while (parts := sums.rdd.getNumPartitions()) > fan:
            sums = stage(sums.coalesce(-(-parts // fan)).mapInArrow(add_up, SUMS))
        found = list(sums.toLocalIterator())  # at most a row for each of ``fan`` partitions' tasks
        if found:
            total, n = sum(np.frombuffer(bytes(r.value), dtype="<f8") for r in found), sum(r.weight for r in found)
            weights = (total * POINT / n).astype(np.float32)
    return weights


def score_rows(classes: Classes, weights: np.ndarray, end_score: float):
    """The results of each document, its stream scored by the sequence field."""

    def run(batches):
        keep_heap()
        field = Scorer(classes, weights, HALF)
        for batch in slices(batches, "stream", 1 << 20):
            log_p = field(*streams(batch.column("stream").to_pylist()), BEGIN)
            score = (log_p + batch.column("rest").to_numpy()) / np.log(10)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "held_out", "n_words", "n_known")), pa.array(batch.column("base").to_numpy() + end_score), pa.array(score)], ["doc_id", "held_out", "n_words", "n_known", "base_score", "score"])

    return run


def held_out():
    return F.coalesce(F.expr("crc32(cast(doc_id as string)) % 10 = 0"), F.lit(False))


def score(docs: DataFrame, path: str | None = None, pattern: str | None = None, stride: int = STRIDE, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    stride: the sequence field trains on every stride-th block of each unit; 1 is all of them.
    """
    own = bpe.rank_file()
    path, pattern = path or own[0], pattern or own[1]
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    sizes = source.agg(F.count(F.when(~F.col("held_out"), 1)).alias("trained"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    trained = sizes["trained"]  # each has an end
    buckets, units = max(LEAST_BUCKETS, -(-sizes["bytes"] // BUCKET_BYTES)), max(1, -(-sizes["bytes"] // UNIT_BYTES))
    rows = stage(source.mapInArrow(tidy(slice_rows(buckets)), SLICE_ROWS))
    answers = stage(rows.where("bucket >= 0").groupBy("bucket").applyInArrow(answer_bucket(path, pattern), ANSWERS))
    lexicon = answers.where(f"slice = {LEXICON}")

    def unpack_sums(batches):
        for b in batches:
            own = np.frombuffer(b"".join(b.column("sums").to_pylist()), dtype="<i8").reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(own[:, j].copy()) for j in range(3)], ["kind", "id", "n"])

    sums = {kind: np.zeros(SIZE) for kind in (MET, TOKENS, TYPES, FURTHER)}
    for r in lexicon.select("sums").mapInArrow(unpack_sums, "kind bigint, id bigint, n bigint").groupBy("kind", "id").agg(F.sum("n").alias("n")).collect():  # rows for each subword at most
        sums[r.kind][r.id] = r.n
    ends = 1 if trained else 0
    n, v = int(sums[TOKENS].sum()) + trained, int(sums[TYPES].sum()) + ends
    once, twice = sums[MET][1], sums[MET][2]
    discount = min(once / (once + 2 * twice), 0.95) if once else 0.5
    words = Words(discount, sums[TOKENS].copy(), sums[TYPES])
    spelling, sequence = Classes(sums[FURTHER] + 0.0), Classes(np.where(np.arange(SIZE) == END, trained, sums[TOKENS]))
    spell_units = max(1, int(sums[TYPES].sum()) // UNIT_WORDS)
    spelt = lexicon.select("bucket", "lengths", "pieces").withColumn("unit", F.pmod("bucket", F.lit(spell_units)))
    spelt = stage(spelt.repartition("unit").sortWithinPartitions("unit", "bucket"))
    spelled = fit(spelt.select("unit", "lengths", "pieces"), spelling_blocks, spelling, SPELL_HALF, SPELL_STEP, 1, rounds)
    encoded = rows.where("bucket = -1").groupBy("slice").cogroup(answers.where("slice >= 0").groupBy("slice")).applyInArrow(encode_slice(n, v, words, spelling, spelled), ENCODED)
    encoded = encoded.withColumn("h", F.xxhash64("doc_id", "stream")).withColumn("unit", F.pmod("h", F.lit(units)))
    encoded = stage(encoded.repartition("unit").sortWithinPartitions("unit", "h", "doc_id"))
    weights = fit(encoded.where("not held_out").select("unit", "stream"), sequence_blocks, sequence, HALF, STEP, stride, rounds)
    out = encoded.mapInArrow(tidy(score_rows(sequence, weights, float(np.log10((trained + 0.1) / (n + 0.1 * (v + 1)))))), "doc_id bigint, held_out boolean, n_words bigint, n_known bigint, base_score double, score double")
    return out.select("doc_id", "held_out", (F.col("n_words") + 1).alias("n_tokens"), (F.col("n_known") + ends).alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score")
