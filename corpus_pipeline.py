"""The corpus pipeline: rules, exact copies, near copies, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and all rows that its predecessor kept, and
returns documents; the last returns the pieces of packed sequences. Missing texts, ids
and sources, repeated rows and empty tables are handled as the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartloom.llm import exact_dedup, minhash, mixing, packing, quality_rules
from cartloom.llm.queries import vocabulary
from cartloom.plans.pinning import pin_table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality_rules.keep_passing(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_one(docs, exact_dedup.exact_duplicates(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return minhash.keep_first(docs, minhash.near_duplicates(docs, width=5, percent=80))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often, and as far, as the mix takes them."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of full sequences of 4,096 tokens."""
    pieces = packing.pack(docs, vocabulary("word_bpe_49k.json"), end_id=2)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES = [("rules", rules), ("exact", exact), ("near", near), ("mix", mix), ("pack", packed)]

#: Near copies, the mix and tokens are beyond SQL; a test compares every stage and the run with brute force on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = pin_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
