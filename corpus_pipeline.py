"""From raw documents to packed windows: quality rules, language ID, SimHash near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. The first three keep the columns of ``documents`` and drop rows; the last returns the pieces of all kept
documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import gray_simhash, language, packing, quality
from millrace.llm.common import BATCH_BYTES, table
from millrace.session import stage


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the boosted trees, which learn from the labelled ones among them."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network recognises; texts without letters and undecided ones go."""
    return language.keep_identified(docs, language.fit(docs))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest id (those without one last), then text hash.

    Rows are told apart by id and text together, so different texts that share an id, or have none, are judged each for
    itself; of rows that are equal in both one stays.
    """
    found = stage(gray_simhash.grouped(docs), "groups")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    first = found.groupBy("root").agg(F.min(place).alias("stays"))
    marked = found.join(first, "root").withColumn("goes", ~place.eqNullSafe(F.col("stays")))
    names = [F.col("doc_id").alias("_id_"), F.col("text_key").alias("_key_")]

    def same(df: DataFrame):
        return df["doc_id"].cast("long").eqNullSafe(F.col("_id_")) & (gray_simhash.text_key(df["text"]) == F.col("_key_"))

    goes = marked.where("goes").select(*names).distinct()
    kept = docs.join(goes, same(docs), "left_anti")
    repeated = marked.where("not goes").groupBy(*names).agg(F.count(F.lit(1)).alias("_n_")).where("_n_ > 1").drop("_n_")
    if repeated.isEmpty():
        return kept
    again = kept.join(repeated, same(kept), "left_semi").withColumn("_key_", gray_simhash.text_key(F.col("text")))
    once = kept.join(repeated, same(kept), "left_anti")
    return once.unionByName(again.dropDuplicates(["doc_id", "_key_"]).drop("_key_"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 4096 tokens over all kept documents."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", good_quality),
    ("language ID", known_language),
    ("SimHash near-dedup", without_near_duplicates),
    ("packing", packed),
]

# Trees, network, fingerprints and packing are beyond SQL; tests/llm checks each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
