"""The contract queries on the smallest tables: DuckDB where SQL can express them, plain versions elsewhere."""

import os

import duckdb
import plain
import pytest

from caselode.llm import oracles
from caselode.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]


@pytest.mark.parametrize("name", sorted(oracles.sql()))
def test_same_rows_as_sql(spark, name):
    got = QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    con.execute(oracles.sql()[name])
    names = [d[0] for d in con.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(map(repr, con.execute(oracles.sql()[name]).fetchall()))
    assert sorted(repr(tuple(r[c] for c in names)) for r in got.collect()) == want


def test_all_ten_are_registered():
    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 11)}


def test_op1_returns_every_message(spark):
    got = QUERIES["op1_quote_links"](spark, SF).collect()
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    assert sorted((r["conv_id"], r["turn"], r["said_sha256"]) for r in got) == sorted((r["conv_id"], r["turn"], plain.sha(r["text"].strip(" \n\r\t"))) for r in rows if ">" not in r["text"])


def test_op3_on_held_out_documents(spark, docs):
    got = {r["doc_id"]: r for r in QUERIES["op3_language_id"](spark, SF).collect()}
    held = [(lang, got[d]["lang_pred"]) for d, _, lang in docs if got[d]["held_out"]]
    assert len(got) == len(docs) and sum(a == b for a, b in held) / len(held) > 0.95


def test_op5_base_spans(spark, docs):
    got = {r["doc_id"]: r for r in QUERIES["op5_pii"](spark, SF).collect()}
    for d, text, _ in docs:
        found = plain.spans(text, plain.PII)
        assert got[d]["base_sha256"] == plain.sha(plain.spelled(found))
        assert [got[d][f"n_{k}"] for k, *_ in plain.PII] == [sum(s[3] == k for s in found) for k, *_ in plain.PII]
        assert set(plain.spelled(found).split(",")) <= set(got[d]["spans"].split(","))


def test_op8_base_columns(spark, docs):
    got = {r["doc_id"]: r for r in QUERIES["op8_quality_bands"](spark, SF).collect()}
    for d, text, _ in docs:
        assert (got[d]["n_words"], got[d]["word_chars"], got[d]["n_symbols"], got[d]["n_dup_lines"], got[d]["n_repeat_words"], got[d]["base_failed"]) == plain.quality(text)
        assert got[d]["kept"] == (not got[d]["base_failed"] and plain.in_band(text or ""))
