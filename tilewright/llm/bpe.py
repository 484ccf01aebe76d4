"""Byte-level BPE encoding and decoding with the tiktoken library over a local rank file.

Long texts are cut before encoding at places where every match of the split pattern must end
(between a character that is no white space and one that is), so pieces encode independently and
memory stays bounded; ids of the pieces joined are the ids of the text. A run without such a place
is cut match by match with the same pattern.

Defined results: null text is an empty text; an empty text has no tokens and the digests of nothing;
repeated rows give repeated results; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, tidy

#: A piece handed to the encoder has about so many characters at most, if a safe boundary allows.
PIECE_CHARS = 200_000
#: Bytes of text encoded at a time (about; a longer text is encoded by itself).
SLICE = 1 << 20
SAFE = re.compile(r"(?<=\S)(?=\s)")


@functools.cache
def encoding(path: str, pattern: str):
    """The encoder of a rank file (base64 token, rank on each line), one for each worker process."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def rank_file() -> tuple[str, str]:
    """Path and split pattern of the default vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def pieces(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` cut at safe boundaries; a piece passes ``most`` only where none is near."""
    start = 0
    while len(text) - start > most:
        cut = SAFE.search(text, start + most)
        end = cut.start() if cut else len(text)
        yield text[start:end]
        start = end
    if start < len(text):
        yield text[start:]


def id_array(enc, text: str, pattern: str, most: int = PIECE_CHARS) -> np.ndarray:
    """Ids (uint32) of the whole text; they never stand as Python integers, except those of single long matches."""
    parts = []
    for piece in pieces(text, most):
        if len(piece) <= 2 * most:
            parts.append(enc.encode_to_numpy(piece, allowed_special=set(), disallowed_special=()))
        else:  # one run without white space, or white space alone
            import regex

            single = getattr(enc, "encode_single_piece", None) or enc._encode_single_piece
            parts += [np.array(single(match[0]), dtype=np.uint32) for match in regex.finditer(pattern, piece)]
    return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, dtype=np.uint32), *parts])


def encode(enc, text: str, pattern: str, most: int = PIECE_CHARS) -> list[int]:
    """Ids of the whole text."""
    return id_array(enc, text, pattern, most).tolist()


def decode(enc, ids: Sequence[int], most: int = PIECE_CHARS) -> bytes:
    """The raw bytes of the ids; they need not be valid UTF-8 by themselves."""
    ids = np.asarray(ids, dtype=np.uint32)
    return b"".join(enc.decode_bytes(ids[i : i + most].tolist()) for i in range(0, len(ids), most))


def id_lists(texts: list[str | None], enc, pattern: str) -> pa.ListArray:
    """The ids of each text as one flat array with offsets."""
    own = [id_array(enc, t or "", pattern) for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, dtype=np.uint32), *own])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int32)))


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>): the token ids of each text."""
    own = rank_file()
    path, pattern = path or own[0], pattern or own[1]

    def run(batches):
        enc = encoding(path, pattern)
        for batch in slices(batches, "text", SLICE):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), id_lists(batch.column("text").to_pylist(), enc, pattern)], ["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(tidy(run), "doc_id bigint, ids array<int>")


def encode_rows(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, source, n_tokens, ids (array<int>) of each row of documents."""
    own = rank_file()
    path, pattern = path or own[0], pattern or own[1]

    def run(batches):
        enc = encoding(path, pattern)
        for batch in slices(batches, "text", SLICE):
            ids = id_lists(batch.column("text").to_pylist(), enc, pattern)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), ids.value_lengths().cast(pa.int64()), ids], ["doc_id", "source", "n_tokens", "ids"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text", "cast(source as string) source").mapInArrow(tidy(run), "doc_id bigint, source string, n_tokens bigint, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, bytes (binary) from doc_id, ids; null ids decode to nothing."""
    own = rank_file()
    path, pattern = path or own[0], pattern or own[1]

    def run(batches):
        enc = encoding(path, pattern)
        for batch in batches:
            out = [decode(enc, x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id bigint, bytes binary")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes each text, then decodes the ids."""
    own = rank_file()
    path, pattern = path or own[0], pattern or own[1]

    def run(batches):
        enc = encoding(path, pattern)
        for batch in slices(batches, "text", SLICE):
            n, ids_sum, text_sum = [], [], []
            for text in batch.column("text").to_pylist():
                ids = id_array(enc, text or "", pattern)
                n.append(len(ids))
                ids_sum.append(hashlib.sha256(ids.astype("<u4", copy=False).data).hexdigest())
                text_sum.append(hashlib.sha256(decode(enc, ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sum, pa.string()), pa.array(text_sum, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(tidy(run), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
