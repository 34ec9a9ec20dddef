"""Registered queries against DuckDB on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from caselode.functions import text
from caselode.operators import index
from caselode.plans import oracles, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(oracles.sql()))
def test_same_rows(spark, name):
    got = queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    con.execute(oracles.sql()[name])
    names = [d[0] for d in con.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(map(repr, con.execute(oracles.sql()[name]).fetchall()))
    assert sorted(repr(tuple(r[c] for c in names)) for r in got.collect()) == want


def test_stems_of_all_words(spark):
    got = {r["stem"]: r["words"] for r in queries.stem_counts(spark, SF).collect()}
    words = {r["term"] for r in index.tokens(queries.zoned(spark, SF)).select("term").distinct().collect()}
    assert got == Counter(text.porter(w) for w in words)
