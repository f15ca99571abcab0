"""Cleaning a corpus in stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assetflow.llm import bpe, decontam, neardup, quality, toxicity
from assetflow.shared import stage


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the repetition rules; those without a text go."""
    return quality.keep_good(docs)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier chain, fitted on those with labels, does not call toxic."""
    chain = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, chain)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates."""
    return neardup.keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token ids and the text decoded from them of each document."""
    return bpe.encode(docs.select("doc_id", "text"))


STAGES = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("near-duplicates", without_copies),
    ("decontamination", uncontaminated),
    ("encoding", encoded),
]

# SQL has no trained classifier and no tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
