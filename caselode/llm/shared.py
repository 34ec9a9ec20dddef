"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Delete a query's shuffle files when it ends, rather than when the driver's collector finds it gone.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_setting = threading.Lock()
_tables: dict[str, list[str]] = {}


def folder(df: DataFrame) -> str:
    """The session's checkpoint folder.  Only a local session without that setting gets one of its own."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, computed once into ``spark.checkpoint.dir``; survives the loss of any executor."""
    folder(df)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: for large steps.

    Compressed, computed in one pass, and the shuffle files behind it go as soon as it is written.
    Tables stay until ``release``, as results that read them are lazy.
    """
    spark, path = df.sparkSession, f"{folder(df)}/table-{uuid.uuid4().hex}"
    with _setting:  # one thread at a time holds the setting; the plan is made while it holds
        before = spark.conf.get(CLEAN, "false")
        spark.conf.set(CLEAN, "true")
        try:
            df.select("*").write.parquet(path)  # a new plan: the setting is read when a plan is made
        finally:
            spark.conf.set(CLEAN, before)
    _tables.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables that ``stored`` made in this application: once the results that read them are written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _tables.pop(spark.sparkContext.applicationId, []):
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
