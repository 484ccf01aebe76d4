"""Language identification by words first, then ever shorter character n-grams.

Training counts words and character n-grams (four letters down to one, with word edges) by language on
a bounded sample of labelled texts: about ``sample`` for each language, chosen by a hash of doc_id and text, whole
texts. The model is a classifier fitted on that sample, and three documented parameters bound it: ``sample``;
``least``, the times the sample must hold an entry (2: an entry met once tells little of its language, and the next
shorter n-grams stand in for it); and ``keep``, the entries of each kind at most, the most frequent ones, which bounds
the table that every task is sent whatever the texts hold. Texts to be judged are never cut. A word of a text that the word table
knows scores its log frequency in each language; another word scores by its n-grams, each position
by the longest n-gram known, at a discount for each step back. The word's scores add up over
the text; ``score`` is the share of the best language after normalisation.

Defined results: a text that is null or has no letter is ``und`` with score 0; where training has no
labelled text all texts are ``und``; ties go to the language first in the alphabet; repeated rows agree;
an empty table gives an empty table; other columns are ignored. lang, source and doc_id never enter a
prediction.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Vocab, slices, stage, tidy

WORD = re.compile(r"[^\W\d_]+")
#: Labelled texts for each language (about), entries kept of each kind, times an entry is met, longest n-gram.
SAMPLE, KEEP, LEAST, LONGEST = 600, 20_000, 2, 4
#: Worker's store of scored words; beyond, it starts anew.
STORE_WORDS = 300_000
STEP_BACK = np.log(0.4)


def words_of(text: str) -> list[str]:
    """The lower-cased words that hold a letter; signs such as superscript digits alone are none."""
    return [w for w in WORD.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))]


def grams(word: str, n: int) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def count_sample(batches):
    """Counts by kind (0: word, n: n-gram), language and key of each task's texts."""
    counts: dict[tuple[int, str], Counter] = {}
    for batch in slices(batches, "text"):
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            counts.setdefault((0, lang), Counter()).update(words_of(text))
    for _, lang in list(counts):
        for n in range(1, LONGEST + 1):
            own = counts[n, lang] = Counter()
            for word, times in counts[0, lang].items():
                for g in grams(word, n):
                    own[g] += times
    for (kind, lang), own in counts.items():
        yield pa.RecordBatch.from_arrays([pa.array([kind] * len(own), pa.int32()), pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], ["kind", "lang", "key", "n"])


class Model:
    """Log frequencies: tables[0] of words, tables[n] of n-grams, an array over languages for each entry."""

    def __init__(self, langs: list[str], rows: list[tuple[int, str, str, int]], totals: dict[tuple[int, str], int]):
        self.langs = langs
        place = {lang: i for i, lang in enumerate(langs)}
        self.tables: list[dict[str, np.ndarray]] = [{} for _ in range(LONGEST + 1)]
        counts: list[dict[str, np.ndarray]] = [{} for _ in range(LONGEST + 1)]
        for kind, lang, key, n in rows:
            counts[kind].setdefault(key, np.zeros(len(langs)))[place[lang]] = n
        for kind, own in enumerate(counts):
            total = np.array([totals.get((kind, lang), 0) for lang in langs], dtype=float)
            for key, n in own.items():
                self.tables[kind][key] = np.log((n + 0.5) / (total + 0.5 * (len(own) + 1)))
        self.unknown = np.full(len(langs), -12.0)

    def word(self, word: str) -> np.ndarray:
        known = self.tables[0].get(word)
        if known is not None:
            return known
        padded, score, at = f"^{word}$", np.zeros(len(self.langs)), 0
        while at < len(padded):
            back = 0.0
            for n in range(LONGEST, 0, -1):
                found = self.tables[n].get(padded[at : at + n]) if at + n <= len(padded) else None
                if found is not None:
                    score = score + found + back
                    at += max(1, n - 1)
                    break
                back += STEP_BACK
            else:
                score = score + self.unknown
                at += 1
        return score


def held_out() -> Column:
    return F.coalesce(F.expr("crc32(cast(doc_id as string)) % 3 = 1"), F.lit(False))


def train(docs: DataFrame, left_out: Column, sample: int = SAMPLE, keep: int = KEEP, least: int = LEAST) -> Model:
    """The model from labelled texts of ``docs`` for which the column ``left_out`` is false."""
    labelled = docs.where(~left_out & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = labelled.groupBy("lang").count().collect()  # a row for each language that the model tells apart
    hashed = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], float(sample) / r["count"]))) if sizes else F.create_map(F.lit(""), F.lit(0.0))
    chosen = labelled.where(hashed < share[F.col("lang")]).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = stage(chosen.mapInArrow(tidy(count_sample), "kind int, lang string, key string, n bigint").groupBy("kind", "lang", "key").agg(F.sum("n").alias("n")))
    totals = {(r.kind, r.lang): r.n for r in counts.groupBy("kind", "lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted({lang for _, lang in totals})
    rows: list[tuple[int, str, str, int]] = []
    for kind in range(LONGEST + 1):
        own = counts.where(F.col("kind") == kind)
        top = own.groupBy("key").agg(F.sum("n").alias("all"), F.collect_list(F.struct("lang", "n")).alias("by")).where(F.col("all") >= least).orderBy(F.desc("all"), "key").limit(keep)
        rows += [(kind, x.lang, r.key, x.n) for r in top.collect() for x in r.by]
    return Model(langs, rows, totals)


class Judge:
    """Predicts texts by a model, scoring each distinct word once while the store lasts."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self):
        self.names, self.table, self.done = Vocab(), np.zeros((1 << 12, len(self.model.langs))), 0

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Languages and scores of whole texts."""
        if len(self.names) > STORE_WORDS:
            self.clear()
        preds, scores = [], []
        for text in texts:
            words = words_of(text or "")
            if not words or not self.model.langs:
                preds.append("und")
                scores.append(0.0)
                continue
            ids = np.fromiter(map(self.names.__getitem__, words), dtype=np.int64, count=len(words))
            if len(self.names) > self.done:
                new = [self.model.word(w) for w in dict.fromkeys(words) if self.names[w] >= self.done]
                while len(self.table) < len(self.names):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.table[self.done : len(self.names)] = new
                self.done = len(self.names)
            total = self.table[ids].sum(axis=0)
            best = int(total.argmax())
            preds.append(self.model.langs[best])
            scores.append(float(1.0 / np.exp(total - total[best]).sum()))
        return preds, scores


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most (LONGEST + 1) * keep entries

    def run(batches):
        judge = Judge(shared.value)
        for batch in slices(batches, "text"):
            preds, scores = judge(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(tidy(run), "doc_id bigint, lang_pred string, score double")


def identify(docs: DataFrame, sample: int = SAMPLE, keep: int = KEEP) -> DataFrame:
    """doc_id, held_out, lang_pred, score: trained on the documents that aren't held out."""
    out = predict(docs, train(docs, held_out(), sample, keep))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def told(docs: DataFrame, least: float, sample: int = SAMPLE, keep: int = KEEP) -> DataFrame:
    """The rows of ``docs``, all columns, whose own text has a language with a score above ``least``.

    Rows are judged one by one where they lie: nothing is shuffled, and a null or repeated doc_id changes nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, held_out(), sample, keep))

    def run(batches):
        judge = Judge(shared.value)
        for batch in slices(batches, "text"):
            preds, scores = judge(batch.column("text").to_pylist())
            yield batch.filter(pa.array([p != "und" and s > least for p, s in zip(preds, scores, strict=True)]))

    return docs.mapInArrow(tidy(run), docs.schema)
