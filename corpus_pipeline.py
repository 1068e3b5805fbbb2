"""A training-data pipeline over ``documents``: toxicity, exact and near duplicates, mixing, tokens.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the columns
of documents; the last one returns digests of the piece ids.  ``run`` writes each stage's rows as Parquet in the
shared folder and rereads them, so a lost executor never costs more than one stage.

Every row is judged by itself, also where its id is repeated or null: a toxic row goes whatever rows share
its id, and of each group of copies one row stays.  Every column passes through; an empty table passes as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.llm import exact_dedup, mixing, queries, simhash, toxicity
from demandloom.plans.storage import scratch_path

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator doesn't reject."""
    model = queries.toxic_model(docs, queries.table(spark, sf_dir, "labels"))
    return toxicity.rows_below(docs, model, queries.TOXIC_FROM)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.distinct_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component (shingles of 3 words, 2 bits)."""
    return simhash.distinct_rows(docs, shingle=3, distance=2)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    _, plan = mixing.mix(docs, F.array("source"))
    return mixing.mixed_documents(docs, F.array("source"), plan)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes) of every row."""
    return queries.encoded_digest(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
