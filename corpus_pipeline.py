"""The corpus pipeline: quality, near duplicates, benchmark, personal data, mixture.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept.  All but the
last return the columns of ``documents``; the last adds the mixture's columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.llm import decontaminate, minhash_dedup, mixing, pii, quality_bands


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_bands.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.deduplicate(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of any item: one whole item is contamination (op2's contract asks for two)."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), min_items=1)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes words of, with the number of those."""
    return mixing.take(docs)


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("benchmark decontamination", benchmark), ("personal data", personal_data), ("mixing", mixture)]

#: zstandard sizes, boosted trees and sketches are beyond SQL; tests compare with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
