"""From documents to packed training sequences: quality, near duplicates, personal data, mixing, packing.

Every stage gets what its predecessor kept, decides over all of it, and is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import minhash, mixing, packing, quality, surrogates
from tidemark.llm.workers import importable
from tidemark.sources.lineage import stage_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    labels = importable(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return quality.score_quality(docs, labels).filter("predicted = 1").select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    importable(spark)
    return minhash.one_of_each(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates."""
    importable(spark)
    return surrogates.replace_personal_data(docs).select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, from not at all to twice."""
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences and places."""
    importable(spark)
    return packing.pack(docs, packing.public_files())


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", one_of_each_group),
    ("PII", without_personal_data),
    ("mixing", mixed_sources),
    ("best-fit packing", packed),
]

ORACLE_SQL = None  # tokens and models are beyond SQL; tests hold each stage against a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = stage_path(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
