"""Where the documents known to be relevant stand in a ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.functions import fixed


def relevance(spark: SparkSession) -> DataFrame:
    """(query_id, document_id): the built-in topics."""
    return spark.createDataFrame([(q, d) for q, ids in fixed.RELEVANCE.items() for d in ids], "query_id string, document_id string")


def relevance_rank(qrels: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, document_id, rank): rank from 0 at first sight, null where a document is not found."""
    first = results.groupBy("query_id", "document_id").agg(F.min("rank").alias("rank"))
    return qrels.select("query_id", "document_id").join(first, ["query_id", "document_id"], "left")
