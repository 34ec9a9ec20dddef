"""Regex matches with code-point offsets, from built-in functions only.

``split`` gives the gaps between the matches that ``regexp_extract_all`` gives, so adding up the
lengths of gaps and matches in turn yields every offset.  Both run Java's engine on the same
pattern.  Patterns use possessive quantifiers, which Java runs as loops: no deep recursion and no
quadratic retries on very long texts.  Sums and searches run in two levels, over groups of ``GROUP``
matches and inside them, so a text of very many matches costs about the power 1.5 of their number at most, and
no match is looked up in the text again: what stands before and after it comes from the neighbouring gaps.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caselode.functions.arrays import let

SPAN = "array<struct<start:bigint,ord:int,end:bigint>>"
MATCH = "array<struct<start:bigint,end:bigint,hit:string,part:string,before:string,after:string>>"
GROUP = 128


def none(kind: str) -> Column:
    return F.array().cast(kind)


def grouped(items: Column) -> Column:
    """Consecutive groups of ``GROUP`` elements; none for an empty array."""
    some = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / GROUP).cast("int"))
    return F.when(F.size(items) > 0, F.transform(some, lambda i: F.slice(items, i * GROUP + 1, F.lit(GROUP)))).otherwise(F.slice(F.array(items), F.lit(1), F.lit(0)))


def running(lengths: Column) -> Column:
    """For each length the sum of those before it."""

    def add(acc, n):
        return F.struct((acc["at"] + n).alias("at"), F.concat(acc["made"], F.array(acc["at"])).alias("made"))

    def raised(g, base):
        return F.transform(g["made"], lambda x: x + base)

    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("made"))
    inner = let(lengths, lambda n: F.transform(grouped(n), lambda g: F.aggregate(g, zero, add)))
    return let(inner, lambda x: F.flatten(F.zip_with(x, F.aggregate(x, zero, lambda acc, g: add(acc, g["at"]), lambda acc: acc["made"]), raised)))


def matches(text: Column, pattern: str, may: Column, part: int = 0, context: int = 0) -> Column:
    """array<struct<start, end, hit, part, before, after>> of the pattern's matches; not looked for where ``may`` is false.

    With ``context``, before holds as many characters in front of the match (of the eight matches and
    gaps there at most) and after the one behind it; else both are null.
    """

    def found(b):
        inner = F.slice(b["gaps"], 1, F.size(b["hits"]))
        lengths = F.zip_with(inner, b["hits"], lambda g, h: (F.length(g) + F.length(h)).cast("bigint"))

        def one(x, i):
            start = x["at"] + F.length(x["gap"])
            before = after = F.lit(None).cast("string")
            if context:
                low = F.greatest(F.lit(0), i - 7)
                near = F.array_join(F.zip_with(F.slice(b["gaps"], low + 1, i - low), F.slice(b["hits"], low + 1, i - low), lambda g, h: F.concat(g, h)), "")
                before = F.right(F.concat(near, x["gap"]), F.lit(context))
                after = F.left(F.concat(F.get(b["gaps"], i + 1), F.coalesce(F.get(b["hits"], i + 1), F.lit(""))), F.lit(1))
            return F.struct(start.alias("start"), (start + F.length(x["hit"])).alias("end"), x["hit"].alias("hit"), x["part"].alias("part"), before.alias("before"), after.alias("after"))

        return F.transform(F.arrays_zip(running(lengths).alias("at"), inner.alias("gap"), b["hits"].alias("hit"), b["parts" if part else "hits"].alias("part")), one)

    pieces = [F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps")]
    if part:
        pieces.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(part)).alias("parts"))
    return F.when(may & text.rlike(pattern), let(F.struct(*pieces), found)).otherwise(none(MATCH))


def overlapped(spans: Column) -> Column:
    """``spans``, sorted by start, in groups with the borders of each: for ``overlaps``."""
    return F.transform(grouped(spans), lambda g: F.struct(F.array_min(F.transform(g, lambda s: s["start"])).alias("low"), F.array_max(F.transform(g, lambda s: s["end"])).alias("high"), g.alias("own")))


def overlaps(m: Column, groups: Column) -> Column:
    """Whether the match shares a character with one of ``overlapped`` spans; looks into the groups it may meet only."""

    def meets(s):
        return (s["start"] < m["end"]) & (m["start"] < s["end"])

    return F.exists(groups, lambda g: (g["low"] < m["end"]) & (m["start"] < g["high"]) & F.exists(g["own"], meets))


def ordered(found: list[Column]) -> Column:
    """One array of (start, ord, end), sorted, of match arrays in the order of their kinds."""

    def numbered(k):
        return lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("ord"), m["end"].alias("end"))

    flat = [F.transform(x, numbered(k)) for k, x in enumerate(found)]
    return F.array_sort(F.concat(none(SPAN), *flat))


def spelled(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["ord"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, kinds: list[str]) -> Column:
    """``text`` with each span replaced by ``[KIND]``; of overlapping spans the first counts, grown to the last's end."""
    names = F.array(*[F.lit(k.upper()) for k in kinds])

    def step(acc, s):
        fresh = F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("["), F.element_at(names, s["ord"] + 1), F.lit("]"))
        out = F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    done = F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
