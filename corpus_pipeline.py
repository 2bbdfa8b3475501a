"""The corpus pipeline: quality rules, near and exact deduplication, mixing and packing of `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.llm.minhash import distinct_documents
from planloom.llm.mixing import mixed_documents, placed_documents
from planloom.llm.packing import packed
from planloom.llm.queries import tokenizer_file
from planloom.llm.rules import kept_documents
from planloom.llm.storage import saved
from planloom.llm.suffix import cleaned_documents
from planloom.llm.tokens import counted

# How sources are mixed, for the stage that orders documents and for the one that fills batches in that order.
MIX = {"weights": None, "power": 0.5}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the learned decision list."""
    return kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return distinct_documents(docs, width=5, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the 200-byte strings that start anywhere else."""
    return cleaned_documents(docs, length=200)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of a mix of their sources, weighted by the square root of their bytes."""
    return mixed_documents(docs, **MIX)


def length_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in batches of 65,536 padded tokens from 16 length buckets, each filled in the order of the mix.

    Rows of files have no order, so places are worked out again from the same documents and weights.
    """
    placed = placed_documents(docs, **MIX).select("doc.doc_id", "doc.text", "place")
    docs = counted(placed, tokenizer_file("byte_bpe_50k.json"), "doc_id", "text", "place")
    return packed(docs, F.col("n_tokens"), buckets=16, budget=65536, order=F.col("place"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("source_mixing", source_mixing),
    ("length_packing", length_packing),
]

# Learned rules, near duplicates and bucket bounds are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; each one's rows are written and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
