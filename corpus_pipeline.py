"""Corpus pipeline: toxic documents go, one of each near-duplicate group stays, repeated passages and secrets are cut,
and what is left is packed into training sequences.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and reread as the next
stage's docs. All but the last return the columns of documents.

Defined results: a null or empty text is scored by the rate of such examples, has no near-duplicates, repeats or
secrets, stays null, and packs as one end token. Null ids and nulls in other columns pass; of several rows with
one id all are one document to near-dedup, so they stay or go together. Very long texts go through whole. Repeated rows are
scored alike; an empty table gives empty results. Extra columns come back unchanged, whatever their names; a column
n_chars is counted anew where texts change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ticketloom.llm import minhash_dedup, packing, queries, secret_scan, substring_dedup, toxicity
from ticketloom.llm._store import materialise, read_table, temporary


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars of the texts as they now are."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.7 or more go."""
    return toxicity.reject_toxic(docs, read_table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return minhash_dedup.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 35 words that occur more than once go; documents stay, even if nothing is left of them."""
    return _recounted(substring_dedup.drop_repeats(docs, window=35))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return _recounted(secret_scan.redact_secrets(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 1024."""
    return packing.pack_documents(docs, queries.vocabulary("json"), end_id=2, capacity=1024)


STAGES = [
    ("toxicity", reject_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with temporary() as keep:  # what a stage writes on its way goes with it
            docs = keep(materialise(stage(spark, docs, sf_dir), name))
    return docs


#: Neither nearest examples nor token merges can be said in SQL; tests/llm holds the rows against plain Python.
ORACLE_SQL = None
