"""End to end: index a collection, search it with query files, evaluate a result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.functions import fixed, text
from caselode.operators import boolean, evaluate, expand, feedback, index, queryparse, score
from caselode.sources import corpus


def index_cases(spark: SparkSession, csv_path: str, index_path: str, with_feedback: bool = True) -> None:
    made = index.build(corpus.read_cases(spark, csv_path), text.default_lemmas(spark), with_feedback)
    index.save(made, index_path)


def terms_of(queries: DataFrame, sets: DataFrame | None = None, thesaurus: DataFrame | None = None, lemmas: DataFrame | None = None, stemmed: bool = False) -> DataFrame:
    """(query_id, term, qtf) of valid queries; Boolean and phrase queries are ranked as free text."""
    parsed = queryparse.raw_tokens(queryparse.parse(queries))
    sets = expand.synonym_sets(queries.sparkSession) if sets is None else sets
    return expand.query_terms(expand.expand(parsed, sets, thesaurus), lemmas, stemmed)


def search(queries: DataFrame, found: index.Index, *, mode: str = "ranked", k: int | None = None, sets: DataFrame | None = None, thesaurus: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """(query_id, rank, document_id, score) of queries (query_id, query).

    mode: ranked, feedback (needs an index built with feedback; query terms are stemmed there), or strict
    (Boolean and phrases as asked, by frequency).  queries may have tags, Penn tags of their raw tokens;
    digits rounds scores before they are compared, so that sums of another order rank alike.
    """
    spark = queries.sparkSession
    if mode == "strict":
        zones = boolean.retrieve(queryparse.parse(queries), found.postings)
        folded = zones.groupBy("query_id", "document_id").agg(F.sum("freq").cast("double").alias("score"), F.max(F.struct(F.col("freq").cast("double").alias("zscore"), "zone_doc_id")).alias("best"))
        return score.rank(folded, k=k)
    if mode == "feedback":
        sets = expand.synonym_sets(spark, fixed.FEEDBACK_SYNONYM_SETS) if sets is None else sets
        tops = found.doc_weights.select("zone_doc_id", F.explode("top_terms").alias("term"))
        out = feedback.rank_with_feedback(terms_of(queries, sets, thesaurus, text.default_lemmas(spark), stemmed=True), found, tops, digits)
        return out if k is None else out.where(F.col("rank") < k)
    return score.search(terms_of(queries, sets, thesaurus, text.default_lemmas(spark)), found, k, digits)


def search_files(spark: SparkSession, index_path: str, query_path: str, out_path: str, mode: str = "ranked", digits: int | None = None) -> None:
    """Ranked ids of each query file as a line of text; an invalid query's file has no bytes."""
    queries = queryparse.parse(corpus.read_queries(spark, query_path))
    valid = queries.where("type <> 'invalid'").select("query_id", "query")
    lines = corpus.result_lines(search(valid, index.load(spark, index_path), mode=mode, digits=digits))
    full = valid.select("query_id").join(lines, "query_id", "left").select("query_id", F.coalesce("line", F.lit("")).alias("line"))
    full.write.mode("overwrite").partitionBy("query_id").text(out_path)
    for row in queries.where("type = 'invalid'").select("query_id").toLocalIterator():
        corpus.write_small(spark, f"{out_path}/query_id={row['query_id']}/part-0.txt", "")


def sift(spark: SparkSession, result_path: str, topic: str) -> DataFrame:
    ranked = corpus.read_result_file(spark, result_path).withColumn("query_id", F.lit(topic))
    return evaluate.relevance_rank(evaluate.relevance(spark).where(F.col("query_id") == topic), ranked)
