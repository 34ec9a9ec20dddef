"""Where documents, queries and results come from and go to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.functions import fixed

#: By position; everything is a string, ids too.
CSV_SCHEMA = "document_id string, title string, content string, date_posted string, court string"
#: Rows of a written case file: a file with line breaks in its fields is read by one task.
FILE_ROWS = 20_000


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores where its files have fewer splits than those.

    One small file is one task however many cores there are; a large input has more splits than
    cores and is left where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Case files: quoted fields may hold line breaks and doubled quotes; empty fields are empty strings."""
    raw = spark.read.schema(CSV_SCHEMA).option("header", True).option("enforceSchema", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8").csv(path)
    return raw.fillna("", ["title", "content", "court"])


def write_cases(cases: DataFrame, path: str) -> None:
    """Case files as ``read_cases`` reads them, blanks and control characters at a field's ends among the rest; what has no date has an empty one."""
    dated = cases.withColumn("date_posted", F.lit("")).select("document_id", "title", "content", "date_posted", "court")
    dated.write.mode("overwrite").option("header", True).option("quoteAll", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("maxRecordsPerFile", FILE_ROWS).csv(path)


def cases_from_documents(docs: DataFrame) -> DataFrame:
    """The ``documents`` table as cases: the first line is the title; a source's number picks its court."""
    names = F.array(*[F.lit(c) for c in (*fixed.HIGH_COURTS, *fixed.MEDIUM_COURTS)])
    number = F.regexp_extract("source", r"^src(\d{1,3})$", 1)
    court = F.when(number == "", None).otherwise(F.try_element_at(names, number.try_cast("int") + 1))
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("string").alias("document_id"), F.substring_index(text, "\n", 1).alias("title"), text.alias("content"), F.coalesce(court, F.lit("")).alias("court"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Query files, one query each: (query_id, query, relevant_docs); line ends may be CRLF."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("query_id"), F.split("value", "\r?\n").alias("lines"))
    rest = F.filter(F.slice("lines", 2, F.greatest(F.size("lines"), F.lit(1))), lambda x: F.trim(x) != "")
    return raw.select("query_id", F.col("lines")[0].alias("query"), F.transform(rest, lambda x: F.trim(x).cast("bigint")).alias("relevant_docs"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir; only a local session without that setting gets one of its own."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="shared-")


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, for what is read more than once."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def files(spark: SparkSession, path: str):
    """(the file system of ``path``, its path): for small files that the driver writes."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_small(spark: SparkSession, path: str, content: str) -> None:
    """One file with this content, without a line's end added."""
    system, at = files(spark, path)
    out = system.create(at, True)
    try:
        if content:
            out.write(bytearray(content.encode()))
    finally:
        out.close()


def write_queries(spark: SparkSession, queries: list[tuple[str, str]], path: str) -> None:
    """Query files, one for each (name, query)."""
    for name, query in queries:
        write_small(spark, f"{path}/{name}.txt", query)


def result_lines(results: DataFrame) -> DataFrame:
    """(query_id, line): ranked ids, each followed by a space; a query without results has an empty line.

    This is the text format; a result that is too long for one line should stay in rows.
    """
    ordered = F.array_sort(F.collect_list(F.struct("rank", "document_id")))
    ids = F.transform(ordered, lambda r: F.concat(r["document_id"], F.lit(" ")))
    return results.where("document_id is not null").groupBy("query_id").agg(F.array_join(ids, "").alias("line"))


def write_results(results: DataFrame, path: str) -> None:
    """Ranked rows, partitioned by query."""
    results.write.mode("overwrite").partitionBy("query_id").parquet(path)


def read_result_file(spark: SparkSession, path: str) -> DataFrame:
    """(rank, document_id) of a text result: the last line's ids, numbered from 0."""
    lines = spark.read.text(path, wholetext=True).select(F.filter(F.split("value", "\r?\n"), lambda x: x != "").alias("lines"))
    last = F.coalesce(F.try_element_at("lines", F.lit(-1)), F.lit(""))
    return lines.select(F.posexplode(F.filter(F.split(last, " "), lambda x: x != "")).alias("rank", "document_id"))
