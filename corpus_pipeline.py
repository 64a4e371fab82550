"""Corpus pipeline: language ID, near-duplicates, secrets, source mixing, tokens.

Each stage reads all that its predecessor kept. ``run`` writes every stage as Parquet to the shared scratch folder and
reads it again, so a lost executor repeats one stage at most. The last two stages have no SQL form (a bisection over
floating-point powers, and a transducer), so the pipeline is tested against a brute-force version instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finfacts.llm import op03_sentencepiece, op04_secret_scans, op05_minhash, op07_language_id, op10_source_mixing
from finfacts.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; null texts, texts without a letter and doubtful ones go."""
    return op07_language_id.accepted(docs).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least doc_id, of each group at similarity 0.8 or more on five-word shingles."""
    return op05_minhash.deduplicated(docs, width=5, percent=80).select(COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with strong secrets and linked weak parts masked; n_chars follows the text."""
    masked = op04_secret_scans.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents repeated or left out as the budget says."""
    return op10_source_mixing.realise(docs).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, round_trip of every remaining row."""
    return op03_sentencepiece.encode(docs)


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secrets),
    ("source_mixing", mixture),
    ("sentencepiece", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
