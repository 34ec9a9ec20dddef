"""PII: high-recall span generators, boosted trees over format and context, calibrated thresholds.

Base rules find well-formed addresses, cards and phones.  Wider generators propose overlapping
spans: number groups of any punctuation, and addresses with a spelled-out ``[at]`` or ``(at)``.  Each
candidate becomes a small vector of format and context features, none of which holds what the base
rules themselves test (the leading ``+``, ``@`` or the check digit).  Candidates that a base rule
confirms are positives, so the trees learn how confirmed data look in this corpus, and candidates of
the same look that no base rule can express are added when their calibrated precision is at least
``precision``.  A candidate that a base pattern matched and its check refused stays refused.

Fitting: one aggregation counts candidates by feature vector and by half of the texts, over all
documents.  The vectors are small integers, so there are at most ``2 * CELLS`` counts whatever the
corpus; the trees are boosted on the driver on one half's counts, the threshold is calibrated on the
other half's, and both are applied as SQL CASE expressions.  Copies of a text share a half.

Bounds in the generators' patterns: a spelled-out address has a local part of up to 64 characters
and up to eight labels of up to 63 behind the first; a wide number has 7 to 30 digits with up to two
separators between neighbours.  Longer ones are no candidates (base spans have no such bounds).

Native: DataFrame functions only.  Defined cases: null and empty texts have no candidates or spans;
without positives or negatives nothing is added; repeated rows count and are judged again; other
columns, of any name, are carried through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselode.functions.arrays import let
from caselode.llm import spans as S
from caselode.llm.shared import stored

KINDS = ["email", "ip", "card", "phone", "contact", "number"]
BASE = 4
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
WIDE_CONTACT = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:@|\[at\]|\(at\)) ?[A-Za-z0-9-]{1,63}+(?:(?: ?(?:\[dot\]|\(dot\)) ?|\.)[A-Za-z0-9-]{1,63}+){1,8}+"
WIDE_NUMBER = r"(?<![A-Za-z0-9.])\(?[0-9](?:[ ().-]{0,2}[0-9]){6,29}+(?![0-9])"
#: Cue words in the text before a span.
CUES = (("phone", "tel|phone|call|fax|mobile|cell|whatsapp"), ("card", "card|visa|amex|mastercard|account|iban"), ("id", "ssn|social|passport|licen[cs]e|tax"), ("contact", "mail|contact|write|reach"), ("other", "version|page|isbn|order|invoice|date|year|chapter|section|serial|part"))
FEATURES = ("shape", "digits", "seps", "style", "cue", "left", "right")
#: Values that each feature takes; their product bounds the cells that reach the driver.
LEVELS = (2, 8, 5, 6, 6, 4, 4)
CELLS = math.prod(LEVELS)
CONTEXT = 40
PRECISION, ROUNDS, RATE, LEAST_SUPPORT = 0.95, 24, 0.3, 20


def luhn(digits: Column) -> Column:
    def add(acc, i):
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def only_digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def good_card(m: Column) -> Column:
    return F.length(only_digits(m["hit"])).between(14, 19) & luhn(only_digits(m["hit"]))


def good_ip(m: Column) -> Column:
    def fits(part):
        bare = F.ltrim(part, F.lit("0"))
        return (F.length(bare) <= 2) | ((F.length(bare) == 3) & (bare <= "255"))

    return F.forall(F.split(m["hit"], r"\."), fits)


def good_phone(m: Column) -> Column:
    return F.length(only_digits(m["hit"])).between(10, 15)


def bucket(x: Column, borders: list[int]) -> Column:
    out = F.lit(0)
    for i, b in enumerate(borders):
        out = F.when(x >= b, i + 1).otherwise(out)
    return out


def features(m: Column, shape: int) -> Column:
    """The candidate's vector as one packed integer, mixed-radix by LEVELS."""

    def vector(v):
        seps, before, after = v["seps"], v["before"], v["after"]
        style = F.when(F.length(seps) == 0, 0).when(seps.rlike(r"^ +$"), 1).when(seps.rlike(r"^-+$"), 2).when(seps.rlike(r"^\.+$"), 3).when(seps.rlike(r"[(]"), 4).otherwise(5)
        cue = F.lit(0)
        for i, (_, names) in enumerate(CUES):
            cue = F.when(before.rlike(rf"\b(?:{names})"), i + 1).otherwise(cue)
        edge = F.regexp_replace(F.right(before, F.lit(2)), r"\+", " ")  # the plus sign is what the base rule tests
        left = F.when(edge.rlike(r"(?:^|[\s])$"), 0).when(edge.rlike(r"[$#€£%]$"), 1).when(edge.rlike(r"[\p{L}\p{N}_]$"), 2).otherwise(3)
        right = F.when((after == "") | after.rlike(r"\s"), 0).when(after.rlike("[%€$£]"), 1).when(after.rlike(r"[\p{L}\p{N}_]"), 2).otherwise(3)
        values = (F.lit(shape), bucket(v["digits"], [1, 7, 9, 10, 11, 14, 17]), F.least(F.length(seps), F.lit(4)), style, cue, left, right)
        packed = F.lit(0)
        for value, n in zip(values, LEVELS):
            packed = packed * n + value
        return packed.cast("int")

    made = F.struct(F.length(only_digits(m["hit"])).alias("digits"), F.regexp_replace(m["hit"], r"[^ ().\-\[\]]", "").alias("seps"), F.lower(m["before"]).alias("before"), m["after"].alias("after"))
    return let(made, vector)


def find_candidates(docs: DataFrame, text: str = "text", p: str = "__pii_") -> DataFrame:
    """``docs`` with p+base (arrays of (start, ord, end)), p+half and p+wide: (start, end, ord, cell, good, tried)."""
    t = F.col(p + "text")
    number = t.rlike("[0-9]")
    out = docs.withColumn(p + "text", F.coalesce(F.col(text), F.lit("")))
    out = out.withColumns({p + "may": number, p + "at": F.contains(t, F.lit("@"))})
    may = F.col(p + "may")
    raw = {"email": S.matches(t, EMAIL, F.col(p + "at")), "ip": S.matches(t, IP, may), "card": S.matches(t, CARD, may), "phone": S.matches(t, PHONE, may & F.contains(t, F.lit("+")))}
    spelled_out = F.col(p + "at") | F.contains(t, F.lit("at]")) | F.contains(t, F.lit("at)"))
    wide = {"contact": S.matches(t, WIDE_CONTACT, spelled_out, context=CONTEXT), "number": S.matches(t, WIDE_NUMBER, may, context=CONTEXT)}
    out = out.withColumns({p + k: v for k, v in (raw | wide).items()})
    checks = {"email": lambda m: F.lit(True), "ip": good_ip, "card": lambda m: good_card(m), "phone": good_phone}
    good = [F.filter(F.col(p + k), checks[k]) for k in KINDS[:BASE]]
    out = out.withColumns({p + "base": S.ordered(good), p + "tried": S.ordered([F.col(p + "ip"), F.filter(F.col(p + "card"), lambda m: F.length(only_digits(m["hit"])) >= 14), F.col(p + "phone")])})

    out = out.withColumns({p + "known": S.overlapped(F.col(p + "base")), p + "refused": S.overlapped(F.col(p + "tried"))})

    def vector(m, ord, shape):
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(ord).alias("ord"), features(m, shape).alias("cell"), S.overlaps(m, F.col(p + "known")).alias("good"), S.overlaps(m, F.col(p + "refused")).alias("tried"))

    made = F.concat(F.transform(F.col(p + "contact"), lambda m: vector(m, 4, 0)), F.transform(F.col(p + "number"), lambda m: vector(m, 5, 1)))
    half = F.pmod(F.xxhash64(p + "text"), F.lit(2)).cast("int")
    return out.withColumns({p + "wide": made, p + "half": half}).drop(p + "text", p + "may", p + "at", p + "tried", p + "known", p + "refused", *[p + k for k in KINDS])


@dataclass
class Model:
    """Boosted trees of depth two as ((feature, border), (feature, border) x 2, four leaves); their calibrated threshold."""

    trees: list
    bias: float
    threshold: float


def unpacked(cell: int) -> tuple[int, ...]:
    out = []
    for n in reversed(LEVELS):
        out.append(cell % n)
        cell //= n
    return tuple(reversed(out))


def scored(trees, bias: float, x: np.ndarray) -> np.ndarray:
    """Scores of the rows of x, as ``score`` gives them."""
    out = np.full(len(x), bias)
    for (f, b), sides, leaves in trees:
        top = x[:, f] >= b
        low, high = x[:, sides[0][0]] >= sides[0][1], x[:, sides[1][0]] >= sides[1][1]
        out += np.where(top, np.where(high, leaves[3], leaves[2]), np.where(low, leaves[1], leaves[0]))
    return out


def best_split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int]:
    """(feature, border) of the greatest gain, from one histogram a feature; the first of equal ones."""
    top, G, H = (0.0, (0, 99)), g.sum(), h.sum()
    for f, n in enumerate(LEVELS):
        a = np.cumsum(np.bincount(x[:, f], g, n)[::-1])[::-1]
        c = np.cumsum(np.bincount(x[:, f], h, n)[::-1])[::-1]
        gain = a**2 / (c + 1) + (G - a) ** 2 / (H - c + 1) - G**2 / (H + 1)
        for b in range(1, n):
            if gain[b] > top[0] + 1e-9:
                top = (float(gain[b]), (f, b))
    return top[1]


def boost(x: np.ndarray, pos: np.ndarray, n: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> tuple[list, float]:
    """Newton boosting of the logistic loss over counted feature vectors: rows of x, with their positives of n."""
    bias = math.log((pos.sum() + 1) / (n.sum() - pos.sum() + 1))
    score, trees = np.full(len(x), bias), []
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-score))
        g, h = pos - n * q, n * q * (1 - q)
        f, b = best_split(x, g, h)
        top = x[:, f] >= b
        sides = tuple(best_split(x[half], g[half], h[half]) for half in (~top, top))
        leaves = []
        for half, (f2, b2) in zip((~top, top), sides):
            for side in (False, True):
                part = half & ((x[:, f2] >= b2) == side)
                leaves.append(float(rate * g[part].sum() / (h[part].sum() + 1)))
                score[part] += leaves[-1]
        trees.append(((f, b), sides, tuple(leaves)))
    return trees, bias


def fit(found: DataFrame, p: str = "__pii_", *, precision: float = PRECISION) -> Model:
    """Boost on the candidates of one half of the texts; on the other half's, the threshold is the least
    score above which precision holds.

    The table collected has a row per feature vector that occurs and half, ``2 * CELLS`` at most.
    """
    one = found.select(p + "half", F.explode(p + "wide").alias("c"))
    counted = one.groupBy(F.col(p + "half").alias("half"), "c.cell").agg(F.sum(F.col("c.good").cast("int")).alias("k"), F.count(F.lit(1)).alias("n"))
    rows = sorted((r["half"], unpacked(r["cell"]), r["k"], r["n"]) for r in counted.collect())
    learn, hold = ([r[1:] for r in rows if r[0] == half] for half in (0, 1))
    pos, n = sum(c[1] for c in learn), sum(c[2] for c in learn)
    if not hold or not pos or pos == n:
        return Model([], 0.0, math.inf)
    trees, bias = boost(*[np.array(c) for c in zip(*learn)])
    by = sorted(zip(scored(trees, bias, np.array([c[0] for c in hold])).tolist(), [c[1] for c in hold], [c[2] for c in hold]), reverse=True)
    threshold, got, seen = math.inf, 0, 0
    for i, (s, k, m) in enumerate(by):
        got, seen = got + k, seen + m
        if seen >= LEAST_SUPPORT and got / seen >= precision and (i + 1 == len(by) or by[i + 1][0] < s):
            threshold = s
    return Model(trees, bias, threshold)


def score(model: Model, cell: Column) -> Column:
    """The trees as CASE expressions over the packed vector."""
    value, rest = {}, cell
    for f in range(len(LEVELS) - 1, -1, -1):
        value[f], rest = F.pmod(rest, F.lit(LEVELS[f])), F.floor(rest / LEVELS[f])
    out = F.lit(model.bias)
    for (f, b), ((f0, b0), (f1, b1)), (a, c, d, e) in model.trees:
        low = F.when(value[f0] >= b0, c).otherwise(a)
        high = F.when(value[f1] >= b1, e).otherwise(d)
        out = out + F.when(value[f] >= b, high).otherwise(low)
    return out


def select(found: DataFrame, model: Model, p: str = "__pii_", prefix: str = "") -> DataFrame:
    """Base spans, and all spans: those and the candidates that the calibrated trees add."""
    base = F.col(p + "base")
    wide = F.col(p + "wide")
    if math.isinf(model.threshold):
        added = S.none(S.SPAN)
    else:
        chosen = F.filter(wide, lambda c: ~c["good"] & ~c["tried"] & (score(model, c["cell"]) >= model.threshold - 1e-9))
        added = F.transform(chosen, lambda c: F.struct(c["start"].alias("start"), c["ord"].alias("ord"), c["end"].alias("end")))
    every = F.when(F.size(wide) > 0, F.array_sort(F.concat(base, added))).otherwise(base)
    return found.withColumns({prefix + "base_spans": base, prefix + "spans": every}).drop(p + "base", p + "wide", p + "half")


def redact(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by its kind.  The candidates are found once and stored for fitting and applying."""
    own = docs.columns
    found = stored(find_candidates(docs, text))
    got = select(found, fit(found, **options), prefix="__pii_out_")
    clean = F.when(F.col(text).isNotNull(), S.redacted(F.col(text), F.col("__pii_out_spans"), KINDS))
    return got.withColumn(text, clean).select(*own)
