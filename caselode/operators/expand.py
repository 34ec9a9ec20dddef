"""Query expansion by synonym sets, then by a ranked synonym table for what the sets do not know."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselode.functions import fixed, text


def synonym_sets(spark: SparkSession, sets=fixed.SYNONYM_SETS) -> DataFrame:
    """(set_id, synonym)."""
    return spark.createDataFrame([(i, word) for i, words in enumerate(sets) for word in words], "set_id int, synonym string")


def custom(toks: DataFrame, sets: DataFrame, token: str = "token") -> DataFrame:
    """``toks`` joined with all members of every set that holds the token, itself among them; in its own case."""
    pairs = sets.withColumnRenamed("synonym", token).join(sets, "set_id").select(token, "set_id", "synonym")
    return toks.join(pairs, token)


def valid_synonym(term: Column, synonym: Column) -> Column:
    return synonym.rlike(r"^[\p{L}\p{N}]+$") & (synonym != term) & (synonym != "AND")


def top_synonyms(terms: DataFrame, thesaurus: DataFrame, k: int = fixed.SYNONYMS_PER_TERM) -> DataFrame:
    """(term, pos, synonym, place): the first k different valid synonyms by rank.

    thesaurus: (term, pos, rank, synonym), such as word senses ordered by likeness.
    """
    # an empty word class looks in all classes
    wanted = terms.select("term", "pos").distinct()
    near = thesaurus.withColumnRenamed("pos", "sense_pos").join(wanted, "term").where((F.col("pos") == "") | (F.col("pos") == F.col("sense_pos")))
    first = near.where(valid_synonym(F.col("term"), F.col("synonym"))).groupBy("term", "pos", "synonym").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(W.partitionBy("term", "pos").orderBy("rank", "synonym"))
    return first.withColumn("place", place).where(F.col("place") <= k).select("term", "pos", "synonym", "place")


def expand(parsed: DataFrame, sets: DataFrame, thesaurus: DataFrame | None = None, k: int = fixed.SYNONYMS_PER_TERM) -> DataFrame:
    """(query_id, token, pos): the raw tokens and the synonyms of each, duplicates kept, as they decide term weights.

    parsed: with query_id and raw_tokens, optionally tags (Penn tags, by token).  pos is the word class of a
    tagged token, empty for others and for synonyms.
    """
    tags = F.col("tags") if "tags" in parsed.columns else F.array().cast("array<string>")
    flat = parsed.select("query_id", tags.alias("tags"), F.posexplode("raw_tokens").alias("at", "token"))
    toks = flat.select("query_id", "at", "token", text.wordnet_pos(F.coalesce(F.try_element_at("tags", F.col("at") + 1), F.lit(""))).alias("pos"))
    new = ["query_id", F.col("synonym").alias("token"), F.lit("").alias("pos")]
    out = toks.select("query_id", "token", "pos").unionByName(custom(toks, sets).select(*new))
    if thesaurus is not None:
        unknown = toks.join(sets.select(F.col("synonym").alias("token")).distinct(), "token", "left_anti")
        ranked = top_synonyms(unknown.select(F.col("token").alias("term"), "pos"), thesaurus, k)
        more = unknown.join(ranked.select(F.col("term").alias("token"), "pos", "synonym"), ["token", "pos"])
        out = out.unionByName(more.select(*new))
    return out


def query_terms(expanded: DataFrame, lemmas: DataFrame | None = None, stemmed: bool = False) -> DataFrame:
    """(query_id, term, qtf): the expanded query tokenised again, so that synonyms of several words fall apart.

    Lemmas are those of the token's word class where ``expanded`` has pos, else of verbs.
    """
    kind = F.col("pos") if "pos" in expanded.columns else F.lit("")
    terms = expanded.select("query_id", kind.alias("pos"), F.explode(text.tokens(F.col("token"))).alias("surface"))
    terms = text.lemmatized(terms, lemmas, pos=F.col("pos"))
    if stemmed:
        terms = terms.withColumn("term", text.stem(F.col("term")))
    return terms.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
