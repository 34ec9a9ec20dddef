"""The engine on hand-computed cases."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from caselode.functions import arrays, fixed, text, topk, weighting
from caselode.operators import boolean, evaluate, expand, feedback, index, queryparse, score
from caselode.plans import oracles, queries, retrieval, workloads
from caselode.sources import corpus

CSV = """document_id,title,content,date_posted,court
246391,Test document,The quick brown fox. This is second sentence. This is third sentence.,13/10/1997 0:00,SG High Court
"""


@pytest.fixture(scope="module")
def golden(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("csv") / "data.csv"
    path.write_text(CSV)
    return index.build(corpus.read_cases(spark, str(path)), text.default_lemmas(spark), True)


def terms(spark, *words):
    return spark.createDataFrame([("q", w, words.count(w)) for w in sorted(set(words))], "query_id string, term string, qtf long")


def test_golden_lengths_and_scores(spark, golden):
    lengths = {r["zone_doc_id"]: r["doc_length"] for r in golden.doc_weights.collect()}
    assert lengths["246391.t"] == pytest.approx(math.sqrt(2), abs=1e-6)
    assert lengths["246391.c"] == pytest.approx(3.641418, abs=1e-6)
    assert golden.n.first()["n"] == 2
    assert score.search(terms(spark, "fox"), golden).first()["score"] == pytest.approx(2.047004, abs=1e-6)
    assert score.search(terms(spark, "test"), golden).first()["score"] == pytest.approx(0.511751, abs=1e-6)
    dot = golden.postings.where("term = '.'").first()
    assert (dot["tf"], dot["positions"]) == (3, [4, 9, 14])
    assert score.search(terms(spark, "nowhere"), golden).count() == 0


def test_save_load_lookup(spark, golden, tmp_path):
    index.save(golden, str(tmp_path))
    again = index.load(spark, str(tmp_path))
    assert {r["zone_doc_id"]: r["positions"] for r in index.lookup(again, "this").collect()} == {"246391.c": [5, 10]}
    assert again.dictionary.where("term = 'be'").first()["df"] == 1
    tops = {r["zone_doc_id"]: r["top_terms"] for r in again.doc_weights.collect()}
    assert tops["246391.c"][:2] == ["sentence", "third"] and len(tops["246391.c"]) == 5


def test_csv_quoting_nulls_and_courts(spark, tmp_path):
    rows = 'document_id,title,content,date_posted,court\n1,,"line one\nline ""two""",x,UK Supreme Court\n2,中文 abc,x,x,\n3,Abc 中文,,x,HK High Court\n'
    (tmp_path / "a.csv").write_text(rows)
    cases = corpus.read_cases(spark, str(tmp_path / "a.csv"))
    got = {(r["document_id"], r["zone"]): (r["text"], r["importance"]) for r in index.zones(index.searchable(cases)).collect()}
    assert got == {("1", "t"): ("", "H"), ("1", "c"): ('line one\nline "two"', "H"), ("3", "t"): ("Abc 中文", "M"), ("3", "c"): ("", "M")}


def test_parser_on_fixture_queries(spark):
    got = {r["query_id"]: (r["type"], r["n_clauses"], r["n_raw"]) for r in queries.parse_query_types(spark, "").collect()}
    assert got == {q: (t, c, n) for q, _, t, c, n in workloads.QUERIES}


def test_phrase_edges(spark):
    rows = [("a", '"open phrase never closed'), ("b", 'stray close" here'), ("c", '"one" two')]
    got = {r["query_id"]: (r["type"], r["clauses"]) for r in queryparse.parse(spark.createDataFrame(rows, "query_id string, query string")).collect()}
    assert got["a"] == ("phrasal", [])
    assert got["b"] == ("free-text", [["stray"], ["close"], ["''"], ["here"]])
    assert got["c"] == ("phrasal", [["one"], ["two"]])


def test_expansion_sizes(spark):
    got = queries.query_tf(spark, "").where("query_id = 'q1'").collect()
    assert sum(r["qtf"] for r in got) == 25
    assert {r["term"]: r["qtf"] for r in got if r["qtf"] > 1} == {"quiet": 2, "phone": 2, "call": 2}
    custom = {(r["query_id"], r["token"]): r["n"] for r in queries.expand_custom(spark, "").collect()}
    assert custom["q4", "fraud"] == 2 * 3 and ("q4", "in vitro") in custom and custom["q4", "ivf"] == 1


def test_ranked_thesaurus_only_for_unknown_words(spark):
    thesaurus = spark.createDataFrame(workloads.THESAURUS + [("phone", "n", 1, "horn")], "term string, pos string, rank int, synonym string")
    parsed = queryparse.raw_tokens(queryparse.parse(spark.createDataFrame([("q", "big phone")], "query_id string, query string")))
    got = [r["token"] for r in expand.expand(parsed, expand.synonym_sets(spark), thesaurus, 2).collect()]
    assert "large" in got and "great" in got and "huge" not in got and "horn" not in got and got.count("phone") == 2


def test_weights_reject_bad_settings(spark):
    with pytest.raises(ValueError):
        weighting.TfIdf("log", "none")
    with pytest.raises(Exception, match="document frequency"):
        spark.range(1).select(weighting.idf(F.lit(1), F.lit(2))).collect()
    row = spark.range(1).select(weighting.QUERY.weight(F.lit(10), F.lit(100), F.lit(10)).alias("w"), weighting.idf(F.lit(5), F.lit(0)).alias("z"), weighting.tf_log(F.lit(0)).alias("t")).first()
    assert tuple(row) == (2.0, 0.0, 0.0)


def test_strict_phrases_with_repeated_and_unknown_words(spark):
    cases = spark.createDataFrame([("1", "x", "the the cat the the the", ""), ("2", "the cat", "cat the", ""), ("3", "y", "the", "")], "document_id string, title string, content string, court string")
    found = index.build(cases)

    def hits(query):
        parsed = queryparse.parse(spark.createDataFrame([("q", query)], "query_id string, query string"))
        return {r["zone_doc_id"]: r["freq"] for r in boolean.retrieve(parsed, found.postings).collect()}

    assert hits('"the the"') == {"1.c": 3}
    assert hits('"the cat"') == {"1.c": 1, "2.t": 1}
    assert hits('cat AND "cat the"') == {"1.c": 1, "2.c": 1}
    assert hits('"the dog"') == {} and hits("cat AND dog") == {} and hits("the AND AND cat") == {}
    assert {r["document_id"] for r in retrieval.search(spark.createDataFrame([("q", "cat")], "query_id string, query string"), found, mode="strict").collect()} == {"1", "2"}


def test_ties_and_zero_scores_keep_their_order(spark):
    rng = random.Random(5)
    rows = [("q", f"{d}.{z}", str(d), z, float(rng.choice([0, 1, 2]))) for d in range(12) for z in "tc"]
    got = [r["document_id"] for r in score.rank(score.fold(spark.createDataFrame(rows, "query_id string, zone_doc_id string, document_id string, zone string, zscore double"))).orderBy("rank").collect()]
    order, total = [], {}
    for _, zone_id, d, z, s in sorted(rows, key=lambda r: (r[4], r[1]), reverse=True):
        if d not in total:
            order.append(d)
            total[d] = 0.0
        total[d] += (0.8 if z == "c" else 0.2) * s
    assert got == sorted(order, key=lambda d: -round(total[d], 12)) and len(got) == 12


def test_feedback_and_rocchio(spark, golden):
    q = terms(spark, "fox")
    tops = golden.doc_weights.select("zone_doc_id", F.explode("top_terms").alias("term"))
    ranked = feedback.rank_with_feedback(q, golden, tops).collect()
    # fox is one of the five top terms? sentence, third, second, quick, fox: qtf 2
    assert ranked[0]["document_id"] == "246391" and ranked[0]["score"] > 0.5 * 8.5 * math.log10(2)
    more = spark.createDataFrame([("q", "fox"), ("q", "dog"), ("q", "dog")], "query_id string, term string")
    got = {r["term"]: r["weight"] for r in feedback.rocchio(q, more).collect()}
    assert got == pytest.approx({"fox": 0.8 + 0.2 / 5, "dog": 0.2 * 2 / 5})


def test_query_files_results_and_sift(spark, tmp_path, golden):
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "q1.txt").write_bytes(b"quick fox\r\n6807771\r\n4001247")
    (tmp_path / "q" / "bad.txt").write_text("fox AND AND quick")
    read = {r["query_id"]: (r["query"], r["relevant_docs"]) for r in corpus.read_queries(spark, str(tmp_path / "q")).collect()}
    assert read == {"q1": ("quick fox", [6807771, 4001247]), "bad": ("fox AND AND quick", [])}
    index.save(golden, str(tmp_path / "index"))
    retrieval.search_files(spark, str(tmp_path / "index"), str(tmp_path / "q"), str(tmp_path / "out"))
    lines = {r["query_id"]: r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()}
    assert lines == {"q1": "246391 "}
    empty = [f for f in (tmp_path / "out" / "query_id=bad").iterdir() if not f.name.endswith(".crc")]
    assert [f.stat().st_size for f in empty] == [0]
    (tmp_path / "result.txt").write_text("9 2748529 8 2211154 9 ")
    got = {r["document_id"]: r["rank"] for r in retrieval.sift(spark, str(tmp_path / "result.txt"), "2").collect()}
    assert got == {"2211154": 3, "2748529": 1}
    assert evaluate.relevance(spark).count() == 3 + 2 + 3 + 60


def test_duplicate_ids_in_strict_mode(spark):
    got = [(r["term"], r["zone_doc_id"], r["tf"]) for r in queries.duplicate_postings(spark, "").orderBy("term", "posting").collect()]
    assert got == [("a", "1.t", 1), ("a", "1.c", 2), ("a", "2.c", 1), ("a", "1.c", 1), ("b", "1.c", 1)]


def test_stems_and_tags(spark):
    assert [text.porter(w) for w, _ in workloads.STEMS] == [s for _, s in workloads.STEMS]
    tags = [("JJ", "a"), ("VBD", "v"), ("NNS", "n"), ("RB", "r"), ("IN", "")]
    assert [r[0] for r in spark.createDataFrame([(t,) for t, _ in tags], "t string").select(text.wordnet_pos(F.col("t"))).collect()] == [p for _, p in tags]
    assert len(fixed.SYNONYM_SETS) == 16 and len(fixed.FEEDBACK_SYNONYM_SETS) == 22


def test_index_invariants(spark):
    cases = spark.createDataFrame([(str(i), f"t {i}", "a b a. " * (i + 1), "") for i in range(5)], "document_id string, title string, content string, court string")
    zoned = index.zones(cases)
    toks = index.tokens(zoned)
    posts = index.postings(toks)
    assert posts.agg(F.sum("tf")).first()[0] == toks.count()
    assert posts.where(F.size("positions") != F.col("tf")).count() == 0
    assert index.dictionary(posts).where("df > 10").count() == 0
    per = toks.groupBy("zone_doc_id").agg(F.max("pos").alias("m"), F.count(F.lit(1)).alias("n"), F.count_distinct("pos").alias("d"))
    assert per.where("m <> n - 1 or d <> n").count() == 0


def test_streamed_postings_equal_batch(spark, tmp_path):
    from caselode.streaming import incremental

    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.csv").write_text(CSV.replace("246391", str(i)))
    incremental.follow(spark, str(tmp_path / "in"), str(tmp_path / "posts"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "posts")).where("term = 'fox'").count() == 2


def test_every_core_query_has_an_oracle():
    assert set(queries.QUERIES) == set(oracles.sql())


def test_ranks_do_not_depend_on_bands(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(f"q{i % 2}", f"{i}.c", str(i), "c", float(rng.choice([1, 1, 1, 2, 3]))) for i in range(400)]
    scores = spark.createDataFrame(rows, "query_id string, zone_doc_id string, document_id string, zone string, zscore double")
    plain = sorted(map(tuple, score.rank(score.fold(scores)).collect()))
    monkeypatch.setattr(score, "BAND_ROWS", 20)
    monkeypatch.setattr(score, "SAMPLE", 50)
    assert sorted(map(tuple, score.rank(score.fold(scores)).collect())) == plain
    want = sorted((r for r in rows if r[0] == "q0"), key=lambda r: (r[4], r[1]), reverse=True)
    assert [r[2] for r in plain if r[0] == "q0"] == [r[2] for r in want] and [r[1] for r in plain if r[0] == "q0"] == list(range(200))


def test_forward_rows_equal_grouped_postings(spark, monkeypatch):
    rows = [("1", "t", "1.t", "to be or not to be", "L"), ("1", "c", "1.c", "", "L"), ("2", "c", "2.c", "Went to town; went home. " * 50, "H")]
    zoned = spark.createDataFrame(rows, "document_id string, zone string, zone_doc_id string, text string, importance string")
    lexicon = text.default_lemmas(spark)
    want = sorted((r["zone_doc_id"], r["term"], r["tf"], tuple(r["positions"])) for r in index.postings(index.tokens(zoned, lexicon)).collect())
    for small in (True, False):
        if not small:
            monkeypatch.setattr(text, "lemma_map", lambda lemmas: None)  # as for a lexicon that is joined
        held = index.forward(zoned, lexicon)
        assert sorted((r["zone_doc_id"], r["term"], r["tf"], tuple(r["positions"])) for r in index.unrolled(held).collect()) == want
        lengths = {r["zone_doc_id"]: r["doc_length"] for r in index.weights(held).collect()}
        assert lengths["1.c"] == 0 and lengths["1.t"] == pytest.approx((2 * (1 + math.log10(2)) ** 2 + 2) ** 0.5)


def test_documents_searched_in_their_rows(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(9))) + "\n" + " ".join(rng.choice("abcdefghijk") for _ in range(rng.randrange(30))) for _ in range(60)]
    docs = [(i, (texts * 5)[i], rng.choice(["src0", "src7", "src19"])) for i in range(300)]
    cases = index.searchable(corpus.cases_from_documents(spark.createDataFrame(docs, "doc_id long, text string, source string"))).repartition(3)
    asked = spark.createDataFrame([(f"q{i}", w, 1 + i % 3) for i in range(9) for w in rng.sample("abcdefghijkz", 4)], "query_id string, term string, qtf long")
    want = sorted(map(tuple, score.search(asked, index.build(cases), 7, 6).collect()))
    monkeypatch.setattr(topk, "HELD", 150)
    monkeypatch.setattr(topk, "CANDIDATES", 100)
    for terms in (None, list("abcdefghijkz")):
        held = corpus.stored(index.by_document(cases, terms))
        assert sorted(map(tuple, score.search_documents(asked, held, 7, 6).collect())) == want
    copies = index.by_document(cases.where("document_id % 60 = 0").unionAll(cases.where("document_id % 60 = 0")), None).withColumn("multiplier", F.lit(1.0))
    found = topk.best(iter(copies.toArrow().to_batches()), ["a"], topk.np.array([0, 1]), topk.np.array([0]), topk.np.array([1.0]), ["q"], 2, 2e-6, 0.8, 0.2)
    assert sum(b.num_rows for b in found) <= 2
    assert score.search_documents(asked.where("false"), held, 7, 6).count() == 0


def test_case_files_keep_blanks_and_control_characters(spark, tmp_path):
    odd = ["plain", " lead", "trail ", "\ttab\t", "  ", "a\nb\n", "\r\n", "\r", "a\r\nb", "\n\nx", "\x00a", "\x00", "\x01", ' "q" ', '"', "a\\", ",", "", None]
    docs = corpus.cases_from_documents(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").withColumn("source", F.lit("src3")))
    corpus.write_cases(docs, str(tmp_path))
    got = corpus.read_cases(spark, str(tmp_path)).select(*docs.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.collect()))


@pytest.mark.parametrize("name", ["positional_postings", "postings_tf"])
def test_texts_are_tokenised_once(spark, name):
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_terms_are_sorted_without_structs_where_no_positions_are_asked_for(spark):
    rows = [(1, ["b", "a", "b", "é", "A", "b"]), (2, []), (3, None), (4, ["x"] * 500), (5, ["", "a", ""])]
    frame = spark.createDataFrame(rows, "i long, terms array<string>")
    for only in (None, ["a", "b"]):
        want = {i: sorted(((t, n) for t, n in Counter(ts or []).items() if only is None or t in only), key=lambda x: x[0].encode()) for i, ts in rows}
        for positions in (False, True):
            got = frame.select("i", arrays.runs(F.col("terms"), positions, only).alias("r"))
            assert {r["i"]: [(x["term"], x["tf"]) for x in r["r"]] for r in got.collect()} == want
    plan = frame.select(arrays.runs(F.col("terms"), False))._jdf.queryExecution().optimizedPlan().toString()
    assert ", pos, " not in plan


def test_phrases_are_matched_without_a_row_for_each_occurrence(spark):
    rng = random.Random(7)
    rows = [(str(i), "c", f"{i}.c", " ".join(rng.choice("abc") for _ in range(rng.randrange(40))), "L") for i in range(60)]
    posts = index.postings(index.tokens(spark.createDataFrame(rows, "document_id string, zone string, zone_doc_id string, text string, importance string")))
    phrases = ["a", "a a", "a b a", "c b b a", "a z"]
    words = spark.createDataFrame([("q", len(phrases), c, o, w, len(p.split())) for c, p in enumerate(phrases) for o, w in enumerate(p.split())], "query_id string, clauses int, clause int, offset int, term string, width int")
    found = boolean.clause_matches(words, posts)
    want = {(c, r[2]): n for c, p in enumerate(phrases) for r in rows if (n := sum(r[3].split()[i : i + len(p.split())] == p.split() for i in range(len(r[3].split()))))}
    assert {(r["clause"], r["zone_doc_id"]): r["freq"] for r in found.collect()} == want
    assert "explode(positions" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_postings_are_sorted_in_ranges_that_follow_the_input(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "RANGE_BYTES", 512)
    docs = [(i, f"title {i}\nbody of {i} and of {i * 7} here", "src1") for i in range(200)]
    made = index.build(index.searchable(corpus.cases_from_documents(spark.createDataFrame(docs, "doc_id long, text string, source string"))))
    index.save(made, str(tmp_path))
    assert len(list((tmp_path / "postings").glob("part-*.parquet"))) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = ["term", "zone_doc_id", "document_id", "zone", "importance", "tf", "positions"]
    saved = index.load(spark, str(tmp_path)).postings
    assert saved.columns == names and sorted(map(repr, saved.collect())) == sorted(map(repr, made.postings.select(*names).collect()))
