"""One registered query per operator, over the ``documents`` table as a collection of cases."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.functions import fixed, text
from caselode.functions.weighting import idf
from caselode.operators import boolean, evaluate, expand, feedback, index, queryparse, score
from caselode.plans import retrieval
from caselode.plans import workloads as L
from caselode.sources import corpus


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return index.searchable(corpus.cases_from_documents(docs))


def zoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.zones(cases(spark, sf_dir))


def posts(spark: SparkSession, sf_dir: str, positions: bool = False) -> DataFrame:
    return index.unrolled(index.forward(zoned(spark, sf_dir), positions=positions))


def short_list(terms: DataFrame, most: int = 20_000) -> list[str] | None:
    """The different terms, if there are ``most`` of them at the most."""
    rows = terms.select("term").distinct().limit(most + 1).collect()
    return sorted(r["term"] for r in rows) if len(rows) <= most else None


def adhoc(zones: DataFrame, terms: DataFrame, positions: bool = False, literal: list[str] | None = None) -> index.Index:
    """An index of the query's terms only: others are dropped as soon as they are made, inside the token arrays if the terms are few."""
    literal = short_list(terms) if literal is None else literal
    toks = index.tokens(zones, terms=literal)
    if literal is None:
        toks = toks.join(score.if_small(terms.select("term").distinct()), "term", "left_semi")
    made = index.postings(toks, positions)
    return index.Index(made, index.dictionary(made), zones.select("zone_doc_id"))


def zone_unpivot(spark, sf_dir):
    return zoned(spark, sf_dir).select("document_id", "zone", "zone_doc_id", "importance", text.multiplier(F.col("importance")).alias("multiplier"), F.length("text").cast("long").alias("n_chars"))


def cjk_filter(spark, sf_dir):
    rows = spark.createDataFrame(L.TITLES, "document_id string, title string")
    return index.searchable(rows).select("document_id", "title")


def tokenize_positions(spark, sf_dir):
    toks = index.tokens(zoned(spark, sf_dir))
    return toks.groupBy("zone_doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.max("pos").cast("long").alias("last_pos"), F.sum(F.col("pos") * F.length("term")).cast("long").alias("position_sum"))


def lemma_join(spark, sf_dir):
    lexicon = spark.createDataFrame(L.LEXICON, "surface string, pos string, lemma string")
    toks = index.tokens(zoned(spark, sf_dir)).withColumnRenamed("term", "surface").withColumn("tag", F.when(F.col("zone") == "t", "NN").otherwise(""))
    got = text.lemmatized(toks, lexicon, pos=text.wordnet_pos(F.col("tag")))
    return got.groupBy("zone", "term").agg(F.count(F.lit(1)).alias("n"))


def postings_tf(spark, sf_dir):
    return posts(spark, sf_dir).select("term", "zone_doc_id", "tf")


def positional_postings(spark, sf_dir):
    got = posts(spark, sf_dir, True)
    return got.select("term", "zone_doc_id", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


def doc_freq_idf(spark, sf_dir):
    n = zoned(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))
    return index.document_frequencies(zoned(spark, sf_dir)).crossJoin(F.broadcast(n)).select("term", "df", F.round(idf(F.col("n"), F.col("df")), 6).alias("idf"))


def corpus_n(spark, sf_dir):
    return zoned(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))


def doc_length(spark, sf_dir):
    held = index.weights(index.forward(zoned(spark, sf_dir), positions=False))
    return held.select("zone_doc_id", F.round("doc_length", 6).alias("doc_length"))


def parse_query_types(spark, sf_dir):
    rows = spark.createDataFrame([(q, t) for q, t, *_ in L.QUERIES], "query_id string, query string")
    got = queryparse.raw_tokens(queryparse.parse(rows)).unionByName(queryparse.parse(rows).where("type = 'invalid'").withColumn("raw_tokens", F.array().cast("array<string>")))
    return got.select("query_id", "type", F.when(F.col("type") == "invalid", 0).otherwise(F.size("clauses")).cast("long").alias("n_clauses"), F.size("raw_tokens").cast("long").alias("n_raw"))


def parsed_words(spark):
    rows = spark.createDataFrame(L.PLAIN, "query_id string, query string")
    return queryparse.raw_tokens(queryparse.parse(rows))


def expand_custom(spark, sf_dir):
    got = expand.expand(parsed_words(spark), expand.synonym_sets(spark))
    return got.groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("n"))


def expand_topk(spark, sf_dir):
    thesaurus = spark.createDataFrame(L.THESAURUS, "term string, pos string, rank int, synonym string")
    words = spark.createDataFrame(L.WORDS, "term string, pos string")
    return expand.top_synonyms(words, thesaurus, 3).select("term", "synonym", F.col("place").cast("long").alias("place"))


def expand_thesaurus(spark, sf_dir):
    """Custom sets first, ranked synonyms for the words that no set holds."""
    words = queryparse.raw_tokens(queryparse.parse(spark.createDataFrame(L.UNKNOWN, "query_id string, query string")))
    thesaurus = spark.createDataFrame(L.THESAURUS, "term string, pos string, rank int, synonym string")
    got = expand.expand(words, expand.synonym_sets(spark), thesaurus, 3)
    return got.groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("n"))


def query_tf(spark, sf_dir):
    return expand.query_terms(expand.expand(parsed_words(spark), expand.synonym_sets(spark)))


def literal_terms(spark, words: list[str]) -> DataFrame:
    return spark.createDataFrame([("q", w, words.count(w)) for w in sorted(set(words))], "query_id string, term string, qtf long")


def rank_free_text(spark, sf_dir):
    """The flagship: one query over all zones, ranked."""
    terms = literal_terms(spark, L.RANKED)
    found = adhoc(zoned(spark, sf_dir), terms, literal=sorted(set(L.RANKED)))
    got = score.rank(score.fold(score.zone_scores(terms, found.postings, found.dictionary, found.n, True)), 6)
    return got.select("query_id", "rank", "document_id", "score")


def bench_terms(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("token"))
    return expand.query_terms(items)


def rank_batch_topk(spark, sf_dir):
    """Every benchmark text as a query; its ten best documents.  The documents are tokenised once, and a workload of many terms is joined."""
    terms = bench_terms(spark, sf_dir)
    if terms.limit(score.SMALL + 1).count() <= score.SMALL:
        held = corpus.stored(index.by_document(cases(spark, sf_dir), short_list(terms)))
        return score.search_documents(terms, held, k=10, digits=6)
    found = adhoc(zoned(spark, sf_dir), terms)
    return score.search(terms, found, k=10, digits=6)


def strict(spark, sf_dir, query: str) -> DataFrame:
    parsed = queryparse.parse(spark.createDataFrame([("q", query)], "query_id string, query string"))
    words = boolean.clause_words(parsed).select("term").distinct()
    got = boolean.retrieve(parsed, adhoc(zoned(spark, sf_dir), words, True).postings)
    return got.select("zone_doc_id", "document_id", F.col("freq").cast("long").alias("freq"))


def boolean_and(spark, sf_dir):
    return strict(spark, sf_dir, L.AND_QUERY)


def phrase_match(spark, sf_dir):
    return strict(spark, sf_dir, L.PHRASE_QUERY)


def boolean_phrase(spark, sf_dir):
    return strict(spark, sf_dir, L.MIXED_QUERY)


def boolean_rank(spark, sf_dir):
    """Matches of the mixed query as they are ranked: by frequency, then by zone."""
    return boolean.ranked(strict(spark, sf_dir, L.MIXED_QUERY).withColumn("query_id", F.lit("q"))).drop("query_id")


def top_terms(spark, sf_dir):
    held = index.forward(zoned(spark, sf_dir), positions=False)
    return index.top_terms(held).select("zone_doc_id", "term", "tf", F.col("place").cast("long").alias("place"))


def fed_back(spark, sf_dir, digits: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(zones, the query's terms, the top terms of its best zones): only those few zones are looked into."""
    zones, terms = zoned(spark, sf_dir), literal_terms(spark, L.RANKED)
    found = adhoc(zones, terms, literal=sorted(set(L.RANKED)))
    scores = score.zone_scores(terms, found.postings, found.dictionary, found.n, True)
    if digits is not None:
        scores = scores.withColumn("zscore", F.round("zscore", digits))
    best = score.best_zones(scores, fixed.FEEDBACK_DOCS).select("query_id", "zone_doc_id")
    near = zones.join(F.broadcast(best), "zone_doc_id")  # FEEDBACK_DOCS rows
    more = index.top_terms(index.forward(near, positions=False))
    return zones, terms, more.join(best, "zone_doc_id").select("query_id", "term")


def prf_rank(spark, sf_dir):
    """The few terms that feedback adds are fetched, so that the second pass keeps only the query's terms from the start, too."""
    zones, terms, more = fed_back(spark, sf_dir)
    added = [r["term"] for r in more.collect()]  # FEEDBACK_DOCS * FEEDBACK_TERMS at most
    again = literal_terms(spark, L.RANKED + added)
    found = adhoc(zones, again, literal=sorted({*L.RANKED, *added}))
    return feedback.rank_again(again, found, 6)


def bonus_zone_fold(spark, sf_dir):
    terms = literal_terms(spark, L.RANKED)
    found = adhoc(zoned(spark, sf_dir), terms, literal=sorted(set(L.RANKED)))
    zones = score.best_zones(score.zone_scores(terms, found.postings, found.dictionary, found.n, True))
    return score.fold(zones, 0.5, 0.5).select("document_id", F.round("score", 6).alias("score"))


def rocchio_weights(spark, sf_dir):
    _, terms, more = fed_back(spark, sf_dir, 6)
    return feedback.rocchio(terms, more).select("term", F.round("weight", 6).alias("weight"))


def relevance_rank(spark, sf_dir):
    """Labelled documents of quality 1 as the relevant ones of the flagship query."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    qrels = labels.select(F.lit("q").alias("query_id"), F.col("doc_id").cast("string").alias("document_id")).distinct()
    got = evaluate.relevance_rank(qrels, rank_free_text(spark, sf_dir))
    return got.select("document_id", F.coalesce("rank", F.lit(-1)).cast("long").alias("rank"))  # -1: not found


def duplicate_postings(spark, sf_dir):
    rows = spark.createDataFrame(L.ARRIVALS, "arrival int, term string, zone_doc_id string, pos int")
    got = index.strict_postings(rows, "arrival")
    return got.select("term", F.col("posting").cast("long").alias("posting"), "zone_doc_id", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


def porter_stems(spark, sf_dir):
    return spark.createDataFrame([(w,) for w, _ in L.STEMS], "word string").select("word", text.stem(F.col("word")).alias("stem"))


def courts(spark, sf_dir):
    rows = spark.createDataFrame([(c,) for c, _ in L.COURTS], "court string")
    return rows.select("court", text.multiplier(text.importance(F.col("court"))).alias("multiplier"))


def stem_counts(spark, sf_dir):
    """Porter stems of all different words of the documents, and how many words share each."""
    words = index.document_frequencies(zoned(spark, sf_dir)).select("term")
    return words.select(text.stem(F.col("term")).alias("stem")).groupBy("stem").agg(F.count(F.lit(1)).alias("words"))


_saved: dict = {}


def saved(spark: SparkSession, sf_dir: str) -> str:
    """The folder of a saved index of the documents, made once a session: written as case CSVs, read, indexed and stored as a user would."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _saved:
        folder = f"{corpus.shared_folder(spark)}/index-{uuid.uuid4().hex}"
        docs = corpus.cases_from_documents(corpus.spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")))
        corpus.write_cases(docs, f"{folder}/cases")
        retrieval.index_cases(spark, f"{folder}/cases", f"{folder}/index")
        _saved[key] = f"{folder}/index"
    return _saved[key]


def case_csv(spark, sf_dir):
    """Documents written as case CSVs and read back."""
    got = corpus.read_cases(spark, saved(spark, sf_dir).removesuffix("index") + "cases")
    return got.select("document_id", F.length("title").cast("long").alias("title_chars"), F.length("content").cast("long").alias("content_chars"), "court")


def index_lookup(spark, sf_dir):
    """Postings of two words and an unknown one, by point lookup in the saved index."""
    found = index.load(spark, saved(spark, sf_dir))
    rows = [index.lookup(found, t) for t in L.LOOKUPS]
    out = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return out.select("term", "zone_doc_id", "tf", "df", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


def saved_search(spark, sf_dir, mode: str) -> DataFrame:
    """All stages of a search from query files to result files, in ``mode``; read back as (query_id, rank, document_id)."""
    folder = saved(spark, sf_dir)
    queries, out = f"{folder}-queries-{uuid.uuid4().hex}", f"{folder}-results-{uuid.uuid4().hex}"
    corpus.write_queries(spark, L.SEARCHED, queries)
    retrieval.search_files(spark, folder, queries, out, mode, 6)
    lines = spark.read.text(out).select(F.col("query_id").cast("string").alias("query_id"), F.posexplode_outer(F.filter(F.split("value", " "), lambda x: x != "")).alias("rank", "document_id")).where("rank is not null")
    return lines.select("query_id", F.col("rank").cast("long").alias("rank"), "document_id")


def search_ranked(spark, sf_dir):
    return saved_search(spark, sf_dir, "ranked")


def search_feedback(spark, sf_dir):
    return saved_search(spark, sf_dir, "feedback")


def search_strict(spark, sf_dir):
    return saved_search(spark, sf_dir, "strict")


QUERIES = {
    f.__name__: f
    for f in (
        zone_unpivot, cjk_filter, courts, tokenize_positions, lemma_join, postings_tf, positional_postings, doc_freq_idf, corpus_n, doc_length, parse_query_types, expand_custom,
        expand_topk, query_tf, rank_free_text, rank_batch_topk, boolean_and, phrase_match, boolean_phrase, top_terms, prf_rank, bonus_zone_fold, rocchio_weights, relevance_rank,
        duplicate_postings, porter_stems, boolean_rank, stem_counts, case_csv, index_lookup, search_ranked, search_feedback, search_strict, expand_thesaurus,
    )
}
