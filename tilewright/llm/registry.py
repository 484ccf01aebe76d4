"""Queries of the corpus operators, and SQL for those that DuckDB can express."""

from __future__ import annotations

from . import attention, bpe, fertility, hamming, language, licenses, mixing, pages, secrets, simhash
from .common import documents


def op1_language(spark, sf_dir):
    return language.identify(documents(spark, sf_dir))


def op2_simhash(spark, sf_dir):
    return simhash.near_duplicates(documents(spark, sf_dir))


def op3_licenses(spark, sf_dir):
    return licenses.scan(documents(spark, sf_dir))


def op4_html(spark, sf_dir):
    return pages.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_embeddings(spark, sf_dir):
    return hamming.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_quality(spark, sf_dir):
    return fertility.quality(documents(spark, sf_dir))


def op7_mixing(spark, sf_dir):
    return mixing.report(documents(spark, sf_dir))


def op8_secrets(spark, sf_dir):
    return secrets.scan(documents(spark, sf_dir))


def op9_bpe(spark, sf_dir):
    return bpe.round_trip(documents(spark, sf_dir))


def op10_lm(spark, sf_dir):
    return attention.score(documents(spark, sf_dir))


def queries():
    return {"op1_language": op1_language, "op2_simhash": op2_simhash, "op3_licenses": op3_licenses, "op4_html": op4_html, "op5_embeddings": op5_embeddings, "op6_quality": op6_quality, "op7_mixing": op7_mixing, "op8_secrets": op8_secrets, "op9_bpe": op9_bpe, "op10_lm": op10_lm}


#: All pairs of equal labels by brute force, then the smallest vec_id that links reach.
EMBEDDINGS = """
with recursive usable as (
    select vec_id, label, [x::double for x in embedding] as e
    from embeddings
    where label is not null and embedding is not null
      and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0 and len([x for x in embedding if x <> 0]) > 0
), unit as (
    select vec_id, label, e, len(e) as dims, sqrt(list_dot_product(e, e)) as norm from usable
), links as (
    select a.vec_id as a, b.vec_id as b
    from unit a join unit b on a.label = b.label and a.dims = b.dims and a.vec_id <> b.vec_id
    where list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), reach(node, root) as (
    select vec_id, vec_id from embeddings
    union
    select l.b, r.root from reach r join links l on l.a = r.node where r.root < l.b
), least as (
    select node, min(root) as root from reach group by node
), counted as (
    select a, count(*) as n from links group by a
)
select v.vec_id, coalesce(c.n, 0)::bigint as n_links, l.root::bigint as component_id, l.root = v.vec_id as kept
from embeddings v join least l on l.node = v.vec_id left join counted c on c.a = v.vec_id
"""


def oracle_sql():
    return {"op5_embeddings": EMBEDDINGS}
