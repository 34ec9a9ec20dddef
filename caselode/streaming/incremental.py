"""Postings of arriving case files: an append-only stream beside the batch index.

Each micro-batch is tokenised and appended to the postings table; document frequencies are
aggregated when it is read, so late files need no rewriting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from caselode.functions import text
from caselode.operators import index
from caselode.sources.corpus import CSV_SCHEMA


def follow(spark: SparkSession, folder: str, postings_path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append the postings of new CSV files under ``folder``; with ``once`` stop when all present files are read."""
    arriving = spark.readStream.schema(CSV_SCHEMA).option("header", True).option("multiLine", True).option("escape", '"').csv(folder)
    lemmas = text.default_lemmas(spark)

    def append(batch: DataFrame, number: int) -> None:
        zoned = index.zones(index.searchable(batch.fillna("", ["title", "content", "court"])))
        index.postings(index.tokens(zoned, lemmas)).write.mode("overwrite").parquet(f"{postings_path}/batch={number}")  # a repeated batch replaces itself

    writer = arriving.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
