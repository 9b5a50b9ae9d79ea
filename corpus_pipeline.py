"""Corpus pipeline: toxicity, quality rules, near-duplicates, mixing, piece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last return the columns of
``documents``; the last adds the piece ids of each text and the text they decode to.  Rows count for themselves, whatever their ids:
null and repeated ids are kept where their texts are.  Other columns of the input are not looked at.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm import minhash, mixing, pieces, quality, toxicity
from ledgerspark.llm.common import cut, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score toxic.  Null and empty texts have no toxic passage and stay."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality rules reject.  Texts of fewer than ten words go, null and empty ones among them."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the smallest id (null ids last, ties by hash of all columns)."""
    return minhash.keep_one(docs).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources to target weights: a row for each document and pass that takes words of it.  A null source is a source, the last."""
    return mixing.mix_documents(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text of the mix as piece ids (``piece_ids``), and decoded from them again (``piece_text``); a null text is an empty one."""
    return pieces.round_trip(docs, pieces.public_model())


STAGES = [("toxicity", clean), ("quality", good), ("near_duplicates", unique), ("mixing", mixed), ("pieces", encoded)]
#: The stages score with trained models and hashes, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each to all that the one before it kept."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:  # later stages read their input more than once
            docs = cut(docs)
    return docs
