"""Queries: operators, phrases and validity, as array expressions; one row per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselode.functions import text

AND = "AND"
CLAUSES = "array<array<string>>"


def kind(toks: Column) -> Column:
    """free-text, boolean, phrasal, boolean with phrasal, or invalid: AND first, last or next to another AND."""
    ands = F.filter(F.transform(toks, lambda t, i: F.when(t == AND, i).otherwise(-1)), lambda i: i >= 0)
    touching = F.exists(F.zip_with(F.slice(ands, 2, F.size(ands)), ands, lambda b, a: b - a), lambda gap: F.coalesce(gap == 1, F.lit(False)))
    bad = (F.size(ands) > 0) & ((F.try_element_at(toks, F.lit(1)) == AND) | (F.try_element_at(toks, F.lit(-1)) == AND) | touching)
    phrase, boolean = F.exists(toks, lambda t: t == text.OPEN), F.size(ands) > 0
    return F.when(bad, "invalid").when(boolean & phrase, "boolean with phrasal").when(boolean, "boolean").when(phrase, "phrasal").otherwise("free-text")


def clauses(toks: Column) -> Column:
    """The terms between ANDs, phrases as one clause of several; an unclosed phrase drops its tail."""

    def step(acc, x):
        tok, at = x["tok"], x["at"]
        inside = F.slice(toks, acc["open"] + 2, at - acc["open"] - 1)
        one = F.when(tok == text.CLOSE, inside).otherwise(F.array(tok))
        add = (tok == text.CLOSE) | ((tok != text.OPEN) & (tok != AND) & (acc["open"] < 0))
        state = F.when(tok == text.OPEN, at).when(tok == text.CLOSE, -1).otherwise(acc["open"])
        return F.struct(state.cast("int").alias("open"), F.when(add, F.concat(acc["made"], F.array(one))).otherwise(acc["made"]).alias("made"))

    rows = F.transform(toks, lambda t, i: F.struct(t.alias("tok"), i.alias("at")))
    grouped = F.aggregate(rows, F.struct(F.lit(-1).alias("open"), F.array().cast(CLAUSES).alias("made")), step, lambda acc: acc["made"])
    grouped = F.transform(grouped, lambda c: F.transform(c, lambda t: F.lower(t)))
    return F.when(kind(toks) == "free-text", F.transform(toks, lambda t: F.array(F.lower(t)))).otherwise(grouped)


def parse(queries: DataFrame, query: str = "query") -> DataFrame:
    """``queries`` with tokens, type and clauses."""
    out = queries.withColumn("tokens", text.query_tokens(F.coalesce(F.col(query), F.lit(""))))
    return out.withColumns({"type": kind(F.col("tokens")), "clauses": clauses(F.col("tokens"))})


def raw_tokens(parsed: DataFrame) -> DataFrame:
    """``parsed`` with the tokens that a valid query is ranked by: operators go, unless it is free text as it is."""
    bare = F.filter("tokens", lambda t: ~t.isin("", text.OPEN, text.CLOSE, AND))
    return parsed.where("type <> 'invalid'").withColumn("raw_tokens", F.when(F.col("type") == "free-text", F.col("tokens")).otherwise(bare))
