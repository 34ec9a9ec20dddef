"""Pseudo-relevance feedback: the best zones' top terms join the query; Rocchio weights as the formula says."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselode.functions import fixed
from caselode.operators import score
from caselode.operators.index import Index


def feedback_terms(scores: DataFrame, tops: DataFrame, docs: int = fixed.FEEDBACK_DOCS) -> DataFrame:
    """(query_id, term): top terms of each query's best zones, with repeats.  Fewer zones are no error."""
    return score.best_zones(scores, docs).select("query_id", "zone_doc_id").join(tops.select("zone_doc_id", "term"), "zone_doc_id").select("query_id", "term")


def add_terms(terms: DataFrame, more: DataFrame) -> DataFrame:
    """Query terms with each feedback term counted once more per occurrence."""
    extra = more.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    return terms.unionByName(extra).groupBy("query_id", "term").agg(F.sum("qtf").alias("qtf"))


def rank_with_feedback(terms: DataFrame, index: Index, tops: DataFrame, digits: int | None = None, zones: int = fixed.FEEDBACK_ZONES) -> DataFrame:
    """Two passes of the same scoring; zones are cut to the best before documents are formed of halves."""
    first = score.zone_scores(terms, index.postings, index.dictionary, index.n)
    return rank_again(add_terms(terms, feedback_terms(first, tops)), index, digits, zones)


def rank_again(terms: DataFrame, index: Index, digits: int | None = None, zones: int = fixed.FEEDBACK_ZONES) -> DataFrame:
    """The second pass, of a query that feedback has been added to."""
    second = score.best_zones(score.zone_scores(terms, index.postings, index.dictionary, index.n), zones)
    return score.rank(score.fold(second, fixed.FEEDBACK_SHARE, fixed.FEEDBACK_SHARE), digits)


def rocchio(terms: DataFrame, more: DataFrame, docs: int = fixed.FEEDBACK_DOCS, alpha: float = fixed.ROCCHIO_ALPHA) -> DataFrame:
    """(query_id, term, weight): alpha * qtf + (1 - alpha) * frequency / docs, over the terms of either side."""
    freq = more.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("freq"))
    weight = F.lit(alpha) * F.coalesce("qtf", F.lit(0)) + F.lit(1 - alpha) * F.coalesce("freq", F.lit(0)) / F.lit(float(docs))
    return terms.join(freq, ["query_id", "term"], "full_outer").select("query_id", "term", weight.alias("weight"))
