"""The training-data pipeline: five stages from documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read
again as the next one's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeatlas.llm import exact, mixing, packing, shingles, toxicity
from codeatlas.llm.common import scratch


def clean_of_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier scores under 0.5; it learns from labels."""
    model = toxicity.train_in_task(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject_toxic(docs, model)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the smallest id."""
    return exact.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingle sets of similarity 0.8 or more, the one with the smallest id; SimHash and MinHash propose the links."""
    return shingles.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: up to three rows each, or none."""
    return mixing.take(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 ids, each sequence in the mix's proportions."""
    return packing.pack(docs, "word_bpe_49k.json", end=1)


STAGES = [
    ("toxicity", clean_of_toxic),
    ("exact_dedup", without_copies),
    ("simhash_dedup", without_near_copies),
    ("source_mix", mixed),
    ("packing", packed),
]

#: SQL can express neither the classifier nor the sampling.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
