"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import byte_bpe, gray_simhash, language, licences, main_text, packing, prefix_trie, quality, range_join, shard_tree, structure, suffix_lm, token_files
from millrace.llm.common import table
from millrace.session import fresh_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    """Register ``fn`` under its own name."""
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document; the trees learn from a bounded sample of ``labels``."""
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query
def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_text.extract(table(spark, sf_dir, "pages"))


@query
def op3_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors with a cosine of at least 0.9."""
    return range_join.near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLES["op3_range_join"] = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
), links as (
  select a.vec_id as a, b.vec_id as b from v a join v b
    on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.9
), reach(vec_id, near) as (
  select vec_id, vec_id from v union select r.vec_id, l.b from reach r join links l on l.a = r.near
), component as (
  select vec_id, min(near) as component_id from reach group by vec_id
), counted as (
  select a as vec_id, count(*) as n from links group by a
)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from component left join counted using (vec_id)
"""


@query
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.round_trip_digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; the network learns from a bounded sample outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


@query
def op6_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document among 16, and among 17."""
    return shard_tree.assign(table(spark, sf_dir, "documents"), 16)


@query
def op7_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 4096 tokens over all documents."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op8_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of every document."""
    return suffix_lm.score_documents(table(spark, sf_dir, "documents"))


@query
def op9_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return gray_simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families of every document."""
    return licences.scan(table(spark, sf_dir, "documents"))


@query
def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest edits of every conversation, after damage."""
    return structure.damage_report(table(spark, sf_dir, "conversations"))


@query
def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back."""
    path = fresh_path(spark, "token_files")
    token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return token_files.digests(spark, path)


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all conversations, rebuilt with shared openings."""
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))
