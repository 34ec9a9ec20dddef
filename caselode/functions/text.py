"""Text functions as columns: tokens, lemmas, parts of speech, stems, courts."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.functions import fixed

#: A word with inner hyphens and apostrophes, or one other character.  Possessive: no deep recursion on long chains.
TOKEN = r"[\p{L}\p{N}]++(?:[-'][\p{L}\p{N}]++)*+|[^\s\p{L}\p{N}]"
OPEN, CLOSE = "``", "''"


def tokens(text: Column) -> Column:
    """Lower-cased tokens; punctuation counts and takes positions."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def query_tokens(query: Column) -> Column:
    """Tokens in their own case; straight double quotes become an opening or a closing mark."""
    opened = F.regexp_replace(query, r'(^|[\s(\[{<])"', f"$1 {OPEN} ")
    return F.regexp_extract_all(F.regexp_replace(opened, '"', f" {CLOSE} "), F.lit(f"{OPEN}|{CLOSE}|{TOKEN}"), F.lit(0))


def starts_with_cjk(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"^[\x{4e00}-\x{9fff}]")


def importance(court: Column) -> Column:
    return F.when(court.isin(*fixed.HIGH_COURTS), "H").when(court.isin(*fixed.MEDIUM_COURTS), "M").otherwise("L")


def multiplier(label: Column) -> Column:
    out = F.lit(0.0)
    for name, value in fixed.MULTIPLIERS.items():
        out = F.when(label == name, value).otherwise(out)
    return out


def wordnet_pos(tag: Column) -> Column:
    """A Penn tag's word class; empty where it has none."""
    return F.when(tag.startswith("J"), "a").when(tag.startswith("V"), "v").when(tag.startswith("N"), "n").when(tag.startswith("R"), "r").otherwise("")


def default_lemmas(spark: SparkSession) -> DataFrame:
    """(surface, pos, lemma): irregular verb forms.  Any table of this shape can stand in its place."""
    rows = [(form, "v", lemma) for lemma, forms in fixed.IRREGULAR_VERBS.items() for form in forms.split()]
    return spark.createDataFrame(rows, "surface string, pos string, lemma string")


def lemma_map(lemmas: DataFrame, most: int = 20_000) -> Column | None:
    """A verb lexicon as one literal map, if it has ``most`` entries at the most; a larger one is joined instead."""
    rows = lemmas.where("pos = 'v'").select("surface", "lemma").limit(most + 1).collect()
    if len(rows) > most:
        return None
    return F.create_map(*[x for r in sorted(rows) for x in (F.lit(r["surface"]), F.lit(r["lemma"]))]) if rows else F.create_map().cast("map<string,string>")


def lemmatized(df: DataFrame, lemmas: DataFrame | None, surface: str = "surface", pos: Column | None = None, out: str = "term") -> DataFrame:
    """``df`` with the lemma of ``surface``; the surface itself where the lexicon has none.

    pos defaults to verb; an empty class falls back to verb as well.
    """
    if lemmas is None:
        return df.withColumn(out, F.col(surface))
    kind = F.lit("v") if pos is None else F.when(pos == "", "v").otherwise(pos)
    lex = lemmas.select(F.col("surface").alias("__surface"), F.col("pos").alias("__pos"), F.col("lemma").alias("__lemma"))
    return df.withColumn("__kind", kind).join(lex, (F.col(surface) == F.col("__surface")) & (F.col("__kind") == F.col("__pos")), "left").withColumn(out, F.coalesce("__lemma", surface)).drop("__kind", "__surface", "__pos", "__lemma")


def _measure(stem: str) -> int:
    """Number of vowel-consonant sequences."""
    shape = "".join("v" if _vowel(stem, i) else "c" for i in range(len(stem)))
    return sum(a == "v" and b == "c" for a, b in zip(shape, shape[1:]))


def _vowel(word: str, i: int) -> bool:
    return word[i] in "aeiou" or word[i] == "y" and i > 0 and not _vowel(word, i - 1)


def _has_vowel(stem: str) -> bool:
    return any(_vowel(stem, i) for i in range(len(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and not _vowel(word, len(word) - 1)


def _cvc(word: str) -> bool:
    n = len(word)
    return n > 2 and not _vowel(word, n - 3) and _vowel(word, n - 2) and not _vowel(word, n - 1) and word[-1] not in "wxy"


# Suffixes of Porter's steps 2, 3 and 4 (1980), and what the first two are replaced by.
STEP2 = "ational ate tional tion enci ence anci ance izer ize abli able alli al entli ent eli e ousli ous ization ize ation ate ator ate alism al iveness ive fulness ful ousness ous aliti al iviti ive biliti ble".split()
STEP3 = "icate ic ative - alize al iciti ic ical ic ful - ness -".split()
STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def porter(word: str) -> str:
    """Porter's stemmer as published in 1980."""
    if len(word) < 3:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]):
            word = word[:-1]
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and _has_vowel(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _cvc(word):
                    word += "e"
                break
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP2, STEP3):
        ends = sorted(zip(table[::2], table[1::2]), key=lambda x: -len(x[0]))
        found = next(((a, b) for a, b in ends if word.endswith(a)), None)
        if found and _measure(word[: -len(found[0])]):
            word = word[: -len(found[0])] + found[1].strip("-")
    found = next((a for a in sorted([*STEP4, "ion"], key=len, reverse=True) if word.endswith(a)), None)
    if found and _measure(word[: -len(found)]) > 1 and (found != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(found)]
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _cvc(word[:-1])):
        word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def stem(term: Column) -> Column:
    """Porter stems, in Arrow batches; meant for query terms, of which there are few."""

    @F.pandas_udf("string")
    def stems(words: pd.Series) -> pd.Series:
        return words.map(lambda w: None if w is None else porter(w))

    return stems(term)


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package
