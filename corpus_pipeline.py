"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes the documents its predecessor kept and calls one operator of `custscope.llm`; a stage is written as
Parquet and read again before the next one starts.

Rows are documents, not ids: rows that share a doc_id keep their own columns and texts, and rows without doc_id pass the
two deduplicating stages without being counted or compared.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custscope.llm import line_dedup, ngram_join, packing, pii, quality_rules
from custscope.llm.common import ship, table
from custscope.llm.queries import pseudonym_key
from custscope.sources.staging import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, unchanged."""
    ship(spark)
    return docs.select(*COLUMNS).where(quality_rules.keeps(F.col("text")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many documents share; a document that keeps no word goes.

    Each row keeps its own other columns. Rows without doc_id keep all their lines.
    """
    ship(spark)
    kept = line_dedup.dedup_lines(docs, carry=("lang", "source"))
    kept = kept.withColumns({"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("bigint")})
    return kept.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of documents alike in at least 0.8 of their runs of five words: the smallest doc_id.

    Rows are compared each, by a row key that is written once. Of rows of a group that share the smallest doc_id one stays;
    rows of one doc_id in several groups do not touch each other. Rows without doc_id link with nothing and all stay.
    """
    ship(spark)
    keyed = stage(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")), "keyed")
    known = keyed.where("doc_id IS NOT NULL")
    found = ngram_join.similar_documents(known.select(F.col("_row").alias("doc_id"), "text")).select(
        F.col("doc_id").alias("_row"), "component_id")
    ranked = known.select("_row", F.struct("doc_id", F.xxhash64("text"), "_row").alias("_rank"))
    first = ranked.join(found, "_row").groupBy("component_id").agg(F.min("_rank")["_row"].alias("_row"))
    kept = known.join(first, "_row", "left_semi").select(*COLUMNS)
    return kept.unionByName(keyed.where("doc_id IS NULL").select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data."""
    ship(spark)
    hidden = pii.pseudonyms(docs.select(*COLUMNS), pseudonym_key(spark)).drop("pii")
    return hidden.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in training sequences."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("pii", personal_data),
    ("best_fit_packing", sequences),
]
#: SQL cannot express the pseudonyms and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
