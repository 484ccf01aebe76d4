"""Quality rules by tokeniser fertility.

Two public vocabularies measure each text: one of pieces with byte fallback gives characters per token, the share of
byte-fallback tokens and the entropy of the token distribution; a byte-level one gives its characters per token. Bands of normal values are learnt from all
documents, for each language (``lang``; where null, the text's main script) and doubling of length:
quartiles, widened by ``spread`` interquartile ranges (3, Tukey's far-out fences; the README gives the
rates on labelled texts). A text outside a band is rejected. A group of
fewer than ``least`` texts takes the band of the same language's nearest doubling of length that has
enough; else of the language over all lengths; else of all languages at the nearest doubling that has
enough; else of all texts, however few. So every text with tokens that passes the base rules is judged.

Defined results: a text without tokens has no measures and only the base rules; null text has no words, fails the base rules and is not kept; null lang uses the
script; repeated rows are judged alike; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import Vocab, binary, slices, stage, tidy

#: Words kept with their pieces in a worker process; beyond, the store starts anew.
STORE_WORDS = 400_000
#: Ranges of code points (ends included) whose characters count for a script.
SCRIPTS = {"arabic": [(0x600, 0x6FF)], "cyrillic": [(0x400, 0x4FF)], "greek": [(0x370, 0x3FF)], "han": [(0x3040, 0x30FF), (0x4E00, 0x9FFF)], "hangul": [(0xAC00, 0xD7AF)], "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F)]}


@functools.cache
def pieces_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceStore:
    """Pieces of each word met, encoded once: number of the word, then its ids in one flat array; and the number of
    its tokens in the byte-level vocabulary."""

    def __init__(self, path: str, ranks: tuple[str, str], most: int = STORE_WORDS):
        self.model, self.most = pieces_model(path), most
        self.ranks, self.bytes_of = ranks, bpe.encoding(*ranks)
        self.clear()

    def clear(self):
        self.words, self.done = Vocab(), 0
        self.flat, self.starts = np.empty(1 << 16, dtype=np.int32), np.zeros(1, dtype=np.int64)
        self.byte_tokens = np.zeros(0, dtype=np.int64)

    def number(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.words.__getitem__, words), dtype=np.int64, count=len(words))

    def encode(self) -> None:
        """Encodes the words numbered since the last call."""
        if len(self.words) == self.done:
            return
        new = [w.decode("utf-8", "replace") for w in list(self.words)[self.done :]]
        ids = self.model.encode(new, num_threads=1)
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        used, more = int(self.starts[-1]), int(lengths.sum())
        if used + more > len(self.flat):
            self.flat = np.concatenate([self.flat[:used], np.empty(used + 2 * more, dtype=np.int32)])
        self.flat[used : used + more] = [y for x in ids for y in x]
        self.starts = np.concatenate([self.starts, used + np.cumsum(lengths)])
        own = [len(self.bytes_of.encode_ordinary(" " + w)) if len(w) < bpe.PIECE_CHARS else len(bpe.id_array(self.bytes_of, " " + w, self.ranks[1])) for w in new]
        self.byte_tokens = np.concatenate([self.byte_tokens, np.array(own, dtype=np.int64)])
        self.done = len(self.words)

    def stream(self, numbers: np.ndarray) -> np.ndarray:
        """The pieces of these words in order."""
        first, length = self.starts[numbers], self.starts[numbers + 1] - self.starts[numbers]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(first - ends + length, length) + np.arange(total)]


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in a 3-word window which the text holds twice or more."""
    if len(ids) < 4:
        return 0
    own = np.unique(ids, return_inverse=True)[1] if int(ids.max()) >= 1 << 21 else ids
    if int(own.max()) < 1 << 21:
        key = (own[:-2] << 42) | (own[1:-1] << 21) | own[2:]
    else:
        pair = np.unique(own[:-1] * (int(own.max()) + 1) + own[1:], return_inverse=True)[1]
        key = pair[:-1] * (int(own.max()) + 1) + own[2:]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), dtype=bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def script_of(text: str) -> str:
    """The script with most characters in the whole text; 'none' without any, ties to the first in the alphabet."""
    points = np.sort(np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4"))
    count = lambda spans: sum(int(np.searchsorted(points, z, "right") - np.searchsorted(points, a)) for a, z in spans)
    counts = {name: count(spans) for name, spans in SCRIPTS.items()}
    best = max(counts, key=counts.__getitem__)
    return best if counts[best] else "none"


METRICS = "doc_id bigint, band string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_tokens bigint, chars_per_token double, byte_share double, entropy double, chars_per_byte_token double"
ALL = "all"


def metrics(docs: DataFrame, path: str | None = None, ranks: tuple[str, str] | None = None) -> DataFrame:
    """The base counts and the vocabularies' measures of every whole text. path: the piece vocabulary; ranks: file
    and split pattern of the byte-level one."""
    path, ranks = path or model_file(), ranks or bpe.rank_file()

    def run(batches):
        store = PieceStore(path, ranks)
        is_byte = np.array([store.model.is_byte(i) for i in range(store.model.vocab_size())])
        for batch in slices(batches, "text"):
            if len(store.words) > store.most:
                store.clear()
            texts, rows, numbers = binary(batch.column("text")), [], []
            for text in texts:
                words = text.split()
                lines = [x for x in text.split(b"\n") if x.strip()]
                own = store.number(words)
                numbers.append(own)
                rows.append((len(words), len(b"".join(words).decode("utf-8", "replace")), len(text) - len(text.translate(None, b"#*$%&|<>")), len(lines) - len(set(lines)), repeated_words(own)))
            store.encode()
            measures = []
            for own, row in zip(numbers, rows, strict=True):
                ids = store.stream(own)
                if len(ids) == 0:
                    measures.append((0, None, None, None, None))
                    continue
                ranked = np.sort(ids)
                runs = np.diff(np.concatenate([[0], np.flatnonzero(ranked[1:] != ranked[:-1]) + 1, [len(ranked)]]))
                share = runs / len(ids)
                measures.append((len(ids), row[1] / len(ids), float(is_byte[ids].mean()), float(-(share * np.log2(share)).sum()), row[1] / int(store.byte_tokens[own].sum())))
            band = [x if x is not None else "script:" + script_of(t.decode("utf-8", "replace")) for x, t in zip(batch.column("lang").to_pylist(), texts, strict=True)]
            columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
            n, *values = zip(*measures, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(band, pa.string()), *columns, pa.array(n, pa.int64()), *(pa.array(x, pa.float64()) for x in values)], ["doc_id", "band", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "chars_per_token", "byte_share", "entropy", "chars_per_byte_token"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text", "cast(lang as string) lang").mapInArrow(tidy(run), METRICS)


def quality(docs: DataFrame, path: str | None = None, spread: float = 3.0, least: int = 40, floor: float = 0.02, byte_most: float = 0.3) -> DataFrame:
    """Every text's counts, measures and verdict.

    spread: interquartile ranges by which a band exceeds the quartiles. least: texts that a band
    needs; fewer fall back.
    floor: least interquartile range, as a part of the median. byte_most: a byte-fallback share up to
    this is never rejected.
    """
    m = stage(metrics(docs, path)).withColumn("octave", F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))))
    quarter = lambda c: F.percentile_approx(c, [0.25, 0.5, 0.75], 2000)
    good = m.where("n_tokens > 0 and not (n_words < 50 or 100 * n_repeat_words > 50 * n_words)")
    names = ("chars_per_token", "byte_share", "entropy", "chars_per_byte_token")
    summed = lambda *by: good.groupBy(*by).agg(F.count("*").alias("n"), F.struct(*(quarter(c).alias(c) for c in names)).alias("q"))
    cells = stage(summed("band", "octave"))
    enough = F.col("n") >= least
    # the nearest octave, of two the shorter; lengths have 64 octaves at most, so each cell meets 64 rows at most
    nearest = F.min_by("q", F.struct(F.abs(F.col("near") - F.col("octave")), F.col("near")))
    octaves = lambda x, *by: x.where(enough).select(*by, F.col("octave").alias("near"), "q")
    spots = cells.select("band", "octave")
    own = spots.join(octaves(cells, "band"), "band").groupBy("band", "octave").agg(nearest.alias("own"))
    whole = summed("band").where(enough).select("band", F.col("q").alias("whole"))
    pooled = spots.crossJoin(F.broadcast(octaves(summed("octave")))).groupBy("band", "octave").agg(nearest.alias("pooled"))
    every = summed().select(F.col("q").alias("every"))
    chosen = spots.join(own, ["band", "octave"], "left").join(whole, "band", "left").join(pooled, ["band", "octave"], "left").crossJoin(F.broadcast(every))
    # a staged table has a known size: Spark broadcasts it while small; beyond, the join's hot keys can be split
    bands = stage(chosen.select("band", "octave", F.coalesce("own", "whole", "pooled", "every").alias("q")))
    m = m.join(bands, ["band", "octave"], "left")

    def inside(c: str):
        q = F.col("q")[c]
        wide = F.greatest(q[2] - q[0], F.lit(floor) * q[1]) * spread
        over = F.col(c) > q[2] + wide if c != "byte_share" else (F.col(c) > q[2] + wide) & (F.col(c) > byte_most)
        under = F.col(c) < q[0] - wide if c != "byte_share" else F.lit(False)
        return F.coalesce(~(over | under), F.lit(True))

    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    fits = F.lit(True)
    for c in names:
        fits = fits & inside(c)
    return m.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & fits).alias("kept"), "band", "n_tokens", *names)
