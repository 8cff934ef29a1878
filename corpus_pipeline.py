"""A training-data pipeline: clean, dedupe, dedupe nearly, mix, encode.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the one before
kept. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrylog.llm import bpe, exact_dedup, minhash_dedup, mixing, quality_rules
from quarrylog.llm.queries import tokenizer_path
from quarrylog.session import cut_lineage


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: rejected documents go."""
    return quality_rules.drop_rejected(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the row of the largest id stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: five-word shingles, similarity of 0.8 or more; the smallest id of a group stays."""
    return minhash_dedup.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: documents sampled so that source, language and topic meet their target shares of words."""
    words = quality_rules.words_of(F.coalesce("text", F.lit("")))
    return mixing.sample(docs, "doc_id", F.size(words), mixing.topic_of(words))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE: token ids of every document and the text they decode to."""
    return bpe.encode_decode(docs, tokenizer_path())


STAGES = [("quality rules", clean), ("exact dedup", exact), ("near dedup", near), ("source mixing", mix), ("bpe encode", encode)]

#: BPE and the chosen-path join have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
