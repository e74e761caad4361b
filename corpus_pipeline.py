"""Corpus pipeline: toxicity, exact dedup, near-dedup, mixing, packing; each stage on what the last kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoledger.llm.exact_dedup import exact_dedup
from geoledger.llm.minhash import near_dedup
from geoledger.llm.mixing import emit, mix
from geoledger.llm.packing import pack_documents
from geoledger.llm.toxicity import drop_toxic
from geoledger.operators.storage import materialize


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold; labels learn on these documents' texts."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return near_dedup(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for."""
    return emit(mix(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenized documents in sequences of several context sizes."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("near-dedup", near), ("mixing", mixing), ("packing", packing)]

#: Tokenization, scores and min-hashes are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
