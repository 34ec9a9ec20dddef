"""The zoned positional inverted index.

A zone's terms, frequencies, positions, length and top terms all lie in its own row, so they are made
there, by sorting the row's tokens (``forward``), and no corpus is shuffled for them.  What is
shuffled are document frequencies, after map-side combination, and postings once, when ``save`` sorts them
by term.  A lexicon too large for a map is joined to tokens; only then are postings grouped.

Arrays are exploded as outer ones and empty rows dropped behind that: for an inner explode the optimizer
infers a filter on the array's size, in which the whole expression that makes the array is computed once more.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselode.functions import fixed, text
from caselode.functions.arrays import runs
from caselode.functions.weighting import tf_log
from caselode.sources import corpus

#: Bytes of the forward table whose postings one task sorts, about ten times as many in memory.
RANGE_BYTES = 8 << 20


def searchable(cases: DataFrame) -> DataFrame:
    """Cases whose title does not start with a CJK character."""
    return cases.where(~text.starts_with_cjk(F.col("title")))


def zones(cases: DataFrame) -> DataFrame:
    """(document_id, zone, zone_doc_id, text, importance): a row for title and one for content."""
    both = F.array(F.struct(F.lit("t").alias("zone"), F.col("title").alias("text")), F.struct(F.lit("c").alias("zone"), F.col("content").alias("text")))
    out = cases.select("document_id", text.importance(F.col("court")).alias("importance"), F.explode(both).alias("z"))
    return out.select("document_id", "z.zone", F.concat_ws(".", "document_id", "z.zone").alias("zone_doc_id"), F.coalesce("z.text", F.lit("")).alias("text"), "importance")


def tokens(zoned: DataFrame, lemmas: DataFrame | None = None, terms: list[str] | None = None) -> DataFrame:
    """(document_id, zone, zone_doc_id, importance, pos, term), positions from 0 per zone.

    A small lexicon is looked up inside the token array, so that no join is planned.  ``terms``, a
    short list, keeps only those before rows are made.
    """
    made = text.tokens(F.col("text"))
    lookup = None if lemmas is None else text.lemma_map(lemmas)
    if lookup is not None:
        made = F.transform(made, lambda t: F.coalesce(F.try_element_at(lookup, t), t))
    keep = ["document_id", "zone", "zone_doc_id", "importance"]
    if terms is not None and (lemmas is None or lookup is not None):
        at = F.transform(made, lambda t, i: F.struct(i.alias("pos"), t.alias("term")))
        return zoned.select(*keep, F.explode_outer(F.filter(at, lambda x: x["term"].isin(*terms))).alias("x")).where("x is not null").select(*keep, "x.pos", "x.term")
    out = zoned.select(*keep, F.posexplode_outer(made).alias("pos", "surface")).where("pos is not null")
    out = out.withColumnRenamed("surface", "term") if lemmas is None or lookup is not None else text.lemmatized(out, lemmas).drop("surface")
    return out if terms is None else out.where(F.col("term").isin(*terms))


def forward(zoned: DataFrame, lemmas: DataFrame | None = None, positions: bool = True, terms: list[str] | None = None) -> DataFrame:
    """(zone_doc_id, document_id, zone, importance, terms): each zone's terms with tf[, positions]; narrow for a small lexicon."""
    keep = ["zone_doc_id", "document_id", "zone", "importance"]
    lookup = None if lemmas is None else text.lemma_map(lemmas)
    made = text.tokens(F.col("text"))
    if lemmas is None or lookup is not None:
        if lookup is not None:
            made = F.transform(made, lambda t: F.coalesce(F.try_element_at(lookup, t), t))
        return zoned.select(*keep, runs(made, positions, terms).alias("terms"))
    posts = postings(tokens(zoned, lemmas, terms), positions)
    entry = F.struct("term", "tf", *(["positions"] if positions else []))
    held = posts.groupBy("zone_doc_id").agg(F.array_sort(F.collect_list(entry)).alias("terms"))
    kind = held.schema["terms"].dataType.simpleString()
    return zoned.select(*keep).join(held, "zone_doc_id", "left").select(*keep, F.coalesce("terms", F.array().cast(kind)).alias("terms"))


def by_document(cases: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """(document_id, importance, c, t): the terms of both zones with tf, of ``terms`` only if given; narrow."""
    made = {z: runs(text.tokens(F.col(c)), False, terms).alias(z) for z, c in (("c", "content"), ("t", "title"))}
    return cases.select("document_id", text.importance(F.col("court")).alias("importance"), made["c"], made["t"])


def unrolled(held: DataFrame) -> DataFrame:
    """Postings of a forward table: (term, zone_doc_id, document_id, zone, importance, tf[, positions])."""
    keep = ["zone_doc_id", "document_id", "zone", "importance"]
    return held.select(*keep, F.explode_outer("terms").alias("x")).where("x is not null").select("x.term", *keep, *["x." + f.name for f in held.schema["terms"].dataType.elementType.fields[1:]])


def document_frequencies(zoned: DataFrame) -> DataFrame:
    """(term, df), counted from each zone's different terms."""
    return zoned.select(F.explode_outer(F.array_distinct(text.tokens(F.col("text")))).alias("term")).where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def postings(toks: DataFrame, positions: bool = True) -> DataFrame:
    """(term, zone_doc_id, document_id, zone, importance, tf[, positions])."""
    extra = [F.sort_array(F.collect_list("pos")).alias("positions")] if positions else []
    return toks.groupBy("term", "zone_doc_id", "document_id", "zone", "importance").agg(F.count(F.lit(1)).alias("tf"), *extra)


def dictionary(posts: DataFrame) -> DataFrame:
    """(term, df): the zones that hold each term.

    It reads tf, so that both uses of unsaved postings are one and the same shuffle, made once.
    """
    return posts.groupBy("term").agg(F.sum(F.when(F.col("tf") > 0, 1).otherwise(0)).cast("long").alias("df"))


def length_of(terms: Column) -> Column:
    """The length of a zone's vector of log-tf weights; 0 without terms."""
    return F.sqrt(F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + F.pow(tf_log(x["tf"]), 2.0)))


def top_of(terms: Column, k: int = fixed.FEEDBACK_TERMS, stopwords=fixed.STOPWORDS) -> Column:
    """array<struct<tf, term>>: a zone's most frequent topical terms; ties by term, descending."""
    topical = F.filter(terms, lambda x: (F.length(x["term"]) > 2) & ~x["term"].isin(*stopwords))
    return F.slice(F.sort_array(F.transform(topical, lambda x: F.struct(x["tf"].alias("tf"), x["term"].alias("term"))), asc=False), 1, k)


def top_terms(held: DataFrame, k: int = fixed.FEEDBACK_TERMS, stopwords=fixed.STOPWORDS) -> DataFrame:
    """(zone_doc_id, term, tf, place) of a forward table, places from 1."""
    out = held.select("zone_doc_id", F.posexplode_outer(top_of(F.col("terms"), k, stopwords)).alias("at", "x")).where("at is not null")
    return out.select("zone_doc_id", "x.term", "x.tf", (F.col("at") + 1).alias("place"))


def strict_postings(toks: DataFrame, order: str) -> DataFrame:
    """Postings as appended one after the other: tokens merge into a term's last posting only if that is of the same zone.

    With repeated document ids a term gets several postings of one zone.  ``order`` gives the tokens' order of arrival.
    Runs are numbered per term, so all tokens of a term are sorted in one task: for collections whose ids repeat, not for large ones.
    """
    arrival = W.partitionBy("term").orderBy(order, "pos")
    fresh = F.when(F.lag("zone_doc_id").over(arrival) == F.col("zone_doc_id"), 0).otherwise(1)
    runs = toks.withColumn("fresh", fresh).withColumn("posting", F.sum("fresh").over(arrival.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("term", "posting", "zone_doc_id").agg(F.count(F.lit(1)).alias("tf"), F.transform(F.array_sort(F.collect_list(F.struct(order, "pos"))), lambda x: x["pos"]).alias("positions"))


@dataclass(frozen=True)
class Index:
    """The tables of an index; ``n`` has one row, the number of zones.  forward is there until the index is saved."""

    postings: DataFrame
    dictionary: DataFrame
    doc_weights: DataFrame
    forward: DataFrame | None = None

    @property
    def n(self) -> DataFrame:
        return self.doc_weights.agg(F.count(F.lit(1)).alias("n"))


def weights(held: DataFrame, feedback: bool = False) -> DataFrame:
    """The doc_weights table of a forward table, with top_terms for feedback."""
    tops = [F.transform(top_of(F.col("terms")), lambda x: x["term"]).alias("top_terms")] if feedback else []
    return held.select("zone_doc_id", "document_id", "zone", "importance", length_of(F.col("terms")).alias("doc_length"), *tops)


def build(cases: DataFrame, lemmas: DataFrame | None = None, feedback: bool = False) -> Index:
    """An index as lazy tables.  ``save`` it to search it more than once."""
    held = forward(zones(searchable(cases)), lemmas)
    posts = unrolled(held)
    return Index(posts, dictionary(posts), weights(held, feedback), held)


def save(index: Index, path: str) -> None:
    """Postings sorted by term, so that a term's row groups are found by their statistics.

    The corpus is tokenised once, into the forward table; all others are made from that.  Postings are
    shuffled without what their zone's id and positions tell, into so many ranges that no task's sort spills.
    """
    spark = index.forward.sparkSession
    index.forward.write.mode("overwrite").parquet(f"{path}/forward")
    held = spark.read.parquet(f"{path}/forward")
    weights(held, "top_terms" in index.doc_weights.columns).write.mode("overwrite").parquet(f"{path}/doc_weights")
    system, at = corpus.files(spark, f"{path}/forward")
    ranges = -(-system.getContentSummary(at).getLength() // RANGE_BYTES)
    many = [ranges] if ranges > int(spark.conf.get("spark.sql.shuffle.partitions")) else []
    ordered = unrolled(held).select("term", "zone_doc_id", "importance", "positions").repartitionByRange(*many, "term", "zone_doc_id").sortWithinPartitions("term", "zone_doc_id")
    zone_id = F.col("zone_doc_id")
    document_id = F.when(F.length(zone_id) > 1, F.left(zone_id, F.length(zone_id) - 2))  # zones have names of one letter; without an id there is no dot
    full = ordered.select("term", zone_id, document_id.alias("document_id"), F.right(zone_id, F.lit(1)).alias("zone"), "importance", F.size("positions").cast("long").alias("tf"), "positions")
    full.write.mode("overwrite").parquet(f"{path}/postings")
    dictionary(spark.read.parquet(f"{path}/postings")).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/dictionary")


def load(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "dictionary", "doc_weights")))


def lookup(index: Index, term: str) -> DataFrame:
    """One term's postings with its document frequency; no rows for an unknown term."""
    return index.postings.where(F.col("term") == term).join(index.dictionary.where(F.col("term") == term), "term")
