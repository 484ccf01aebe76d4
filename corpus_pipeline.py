"""A cleaning run over ``documents``: five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents. An empty table passes every stage as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import bpe, language, mixing, secrets, simhash
from tilewright.llm.common import documents, stage

#: A document whose best language has no more than this share of the normalised likelihood has none.
LEAST_LANGUAGE = 0.34


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a language can be told; what has no letters, or no clear language, goes.

    Null and empty texts have no letters and go; long texts are judged whole; repeated rows stay or go alike.
    """
    return language.told(docs, LEAST_LANGUAGE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id.

    The groups are those of the SimHash operator, with the shingles (three words) and the threshold (two bits) that
    its contract fixes. Two bits reach copies and texts that differ in a few words out of many; most pairs of a word
    similarity just above 0.8 differ in more bits and stay both (README, figures). Null and empty texts share the
    fingerprint zero and are one group.

    Of rows that repeat a doc_id and its text one stays; rows of one doc_id with several texts stay while
    any of them stands for a group; rows without doc_id belong to no group and stay.
    """
    judged = simhash.near_duplicates(docs).where("doc_id is not null").groupBy("doc_id")
    judged = stage(judged.agg(F.max("component_id").alias("stands"), F.count("*").alias("n")).where("n > 1 or stands < doc_id"))
    single = docs.join(judged, "doc_id", "left_anti").select(docs.columns)
    repeated = docs.join(judged.where("stands = doc_id"), "doc_id", "left_semi").select(docs.columns)
    return single.union(repeated.dropDuplicates(["doc_id", "text"]))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark.

    n_chars follows the new text; null and empty texts stay as they are, long ones are scanned whole, repeated rows
    are redacted alike.
    """
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents sampled so that source, language and register meet their target shares of tokens.

    Null source or lang is a value of its own; null and empty texts weigh nothing and are kept with their cell's
    probability; rows of equal doc_id are decided alike.
    """
    return mixing.sample(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids: each text as byte-level BPE ids. As the last stage it returns these columns alone.

    Null and empty texts have no ids; long texts are encoded whole; a row for each row.
    """
    return bpe.encode_rows(docs)


STAGES = [("language ID", language_id), ("SimHash near-dedup", near_duplicates), ("secret scan", secret_scan), ("mixing", mixture), ("byte-level BPE", token_ids)]

#: SQL expresses none of the trained stages; tests hold the run against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = documents(spark, sf_dir)
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
