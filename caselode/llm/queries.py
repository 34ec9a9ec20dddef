"""The contract queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.llm import decontaminate, language_id, minhash_dedup, mixing, pii, quality_bands, quote_links, secret_scan, substring_dedup, url_reputation
from caselode.llm import spans as S
from caselode.llm.shared import checkpointed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quote_links.relink(table(spark, sf_dir, "conversations"))
    return got.select("conv_id", "turn", "role", "reply_to", "root", "depth", "position", "max_level", "n_linked", F.sha2("said", 256).alias("said_sha256"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return got.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    training = language_id.fit(docs, "text", "lang", ~held_out)
    return language_id.predict(docs.select("doc_id", "text"), training).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def counts(spans: str, kinds: list[str]) -> list:
    def numbered(k):
        return lambda s: s["ord"] == k

    return [F.size(F.filter(spans, numbered(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(kinds)]


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts are read once: their candidates are few and small, and are checkpointed for fitting and selecting."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = checkpointed(pii.find_candidates(docs).drop("text"))
    got = pii.select(found, pii.fit(found))
    base = S.spelled(F.col("base_spans"), pii.KINDS)
    return got.select("doc_id", *counts("base_spans", pii.KINDS[: pii.BASE]), F.sha2(base, 256).alias("base_sha256"), S.spelled(F.col("spans"), pii.KINDS).alias("spans"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = secret_scan.kinds()
    base = S.spelled(F.col("base_spans"), kinds)
    return got.select("doc_id", *counts("base_spans", kinds[: secret_scan.BASE]), F.sha2(base, 256).alias("base_sha256"), S.spelled(F.col("spans"), kinds).alias("spans"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return taken.select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken", "first_slot")


def op8_quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_bands.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.drop("text")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = minhash_dedup.group(table(spark, sf_dir, "documents"), shingle=3, percent=85)
    return got.withColumnRenamed("id", "doc_id")


def op10_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are by id: a page's outcome is bad where the label of its id says low quality or toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    got = url_reputation.judge(pages, labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")))
    return got.select("page_id", "host", "path", "rule", "verdict")


QUERIES = {f.__name__: f for f in (op1_quote_links, op2_decontaminate, op3_language_id, op4_substring_dedup, op5_pii, op6_secrets, op7_mix_sources, op8_quality_bands, op9_minhash, op10_url_reputation)}
