"""Array expressions that built-in functions lack."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it, in lambdas also."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def runs(terms: Column, positions: bool = True, only: list[str] | None = None) -> Column:
    """array<struct<term, tf[, positions]>>: a row's different terms in order, by sorting its terms once.

    ``only``, a short list, keeps those terms before anything is sorted.  Without positions the terms
    themselves are sorted, as structs take longer.
    """
    at = F.transform(terms, lambda t, i: F.struct(t.alias("term"), i.alias("pos"))) if positions else terms

    def term(x: Column) -> Column:
        return x["term"] if positions else x

    if only is not None:
        at = F.filter(at, lambda x: term(x).isin(*only))

    def grouped(s):
        fresh = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: ~term(F.get(s, i)).eqNullSafe(term(F.get(s, i - 1))))

        def cut(starts):
            def one(a, k):
                n = F.coalesce(F.get(starts, k + 1), F.size(s)) - a
                extra = [F.transform(F.sequence(a, a + n - 1), lambda i: F.get(s, i)["pos"]).alias("positions")] if positions else []
                return F.struct(term(F.get(s, a)).alias("term"), n.cast("long").alias("tf"), *extra)

            return F.transform(starts, one)

        made = let(fresh, cut)
        return F.when(F.size(s) > 0, made)

    none = "array<struct<term:string,tf:bigint,positions:array<int>>>" if positions else "array<struct<term:string,tf:bigint>>"
    return F.coalesce(let(F.sort_array(at), grouped), F.array().cast(none))
