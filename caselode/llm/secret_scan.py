"""Secret scans through a trigram inverted index.

Each rule's regular expression is parsed into a Boolean query over the trigrams that any match must
hold: concatenations AND their literal runs, alternations OR their branches, and what is optional or
unbounded adds nothing.

The index covers exactly the trigrams that the rules ask for, over case-folded text.  A text is known
by the hash of its content, so copies are one entry; texts are dealt by that hash into blocks of about
``BLOCK_TEXTS``, and a posting list is the sorted texts of one block that hold one trigram.  A rule's
candidates are the intersections and unions of the block's lists, as its query says.  Only those
texts are verified with the regular expression; a rule without mandatory trigrams (runs of hex)
scans every text fully.  Texts that share a hash share an entry, which may add a candidate, never lose one.

Candidates meet the documents by content hash: broadcast while they are counted to be few
(``BROADCAST_ROWS``), by a shuffled join beyond that.  Lists are bounded by the block, whatever the skew.

Native: DataFrame functions only.  Defined cases: null and empty texts have no spans; a repeated row
gets the same spans again; other columns, of any name, are carried through.
"""

from __future__ import annotations

from re import _constants as C  # the standard library's own regular expression parser
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselode.llm import spans as S
from caselode.llm.shared import checkpointed

#: Kind, pattern for the index, Java's pattern, group whose length counts, its least length.
RULES = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", None, 1, 6),
    ("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]++", 0, 20),
    ("hex", r"[0-9a-f]+", r"(?<![0-9a-f])[0-9a-f]{24,}+", 0, 24),
    ("forge", r"gh[pousr]_[A-Za-z0-9]+", r"gh[pousr]_[A-Za-z0-9]++", 0, 40),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]+", r"xox[abprs]-[A-Za-z0-9-]++", 0, 16),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", None, 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r"eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++", 0, 0),
    ("cloud", r"AIza[A-Za-z0-9_-]+", r"AIza[A-Za-z0-9_-]++", 0, 39),
    ("payment", r"[sr]k_live_[A-Za-z0-9]+", r"[sr]k_live_[A-Za-z0-9]++", 0, 24),
)
BASE = 3
ANY = ("any",)
MOST_STRINGS = 32
BLOCK_TEXTS, BROADCAST_ROWS = 4096, 1 << 20
WORD_BITS = 62


def both(op: str, a: tuple, b: tuple) -> tuple:
    """``a`` and ``b`` under AND or OR, with the unrestricted query simplified away."""
    if op == "and" and ANY in (a, b):
        return b if a == ANY else a
    if op == "or" and ANY in (a, b):
        return ANY
    return a if a == b else (op, a, b)


def grams(strings: set[str]) -> tuple:
    """The query that one of the strings occurs."""
    out = None
    for s in sorted(strings):
        one = ANY
        for i in range(len(s) - 2):
            one = both("and", one, ("has", s[i : i + 3]))
        out = one if out is None else both("or", out, one)
    return out or ANY


def derive(nodes) -> tuple[set[str] | None, tuple]:
    """(the strings that the nodes can match, if few; the trigram query of what is before the last of them)."""
    now, query, exact = {""}, ANY, True

    def flush():
        nonlocal now, query, exact
        query, now, exact = both("and", query, grams(now)), {""}, False

    for op, arg in nodes:
        strings, inner = None, ANY
        if op is C.LITERAL:
            strings = {chr(arg).lower()}
        elif op is C.IN and all(k is C.LITERAL for k, _ in arg) and len(arg) <= 6:
            strings = {chr(v).lower() for _, v in arg}
        elif op is C.SUBPATTERN:
            strings, inner = derive(arg[-1])
        elif op is C.BRANCH:
            got = [derive(branch) for branch in arg[1]]
            if all(s is not None for s, _ in got):
                strings = set().union(*(s for s, _ in got))
            else:
                for i, (s, q) in enumerate(got):
                    q = grams(s) if s is not None else q
                    inner = q if i == 0 else both("or", inner, q)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, sub = arg
            s, q = derive(sub)
            if (low, high) == (0, 1) and s is not None:
                strings = s | {""}
            elif low >= 1:
                if s is not None and len(now) * len(s) <= MOST_STRINGS:
                    now = {a + b for a in now for b in s}
                inner = q
        if strings is not None and len(now) * len(strings) <= MOST_STRINGS:
            now = {a + b for a in now for b in strings}
        else:
            flush()
            query = both("and", query, inner if strings is None else grams(strings))
    if exact:
        return now, ANY
    return None, both("and", query, grams(now))


def trigram_query(pattern: str) -> tuple:
    strings, query = derive(_parser.parse(pattern))
    return grams(strings) if strings is not None else query


def asked(query: tuple) -> set[str]:
    return {query[1]} if query[0] == "has" else set().union(*(asked(q) for q in query[1:] if isinstance(q, tuple)))


def vocabulary(rules=RULES) -> list[str]:
    return sorted(set().union(*(asked(trigram_query(r[1])) for r in rules)))


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def held_trigrams(docs: DataFrame, text: Column, vocab: list[str]) -> DataFrame:
    """(key, mask0, mask1 ..) per different text that holds a trigram: bit i of the masks says that it holds the i-th.

    The only pass over the texts that the index takes: each is folded once.
    """
    low = docs.select(F.coalesce(text, F.lit("")).alias("text")).select(text_key(F.col("text")).alias("key"), F.lower("text").alias("low"))
    masks = []
    for a in range(0, len(vocab), WORD_BITS):
        bits = [F.when(F.contains("low", F.lit(t)), 1 << i).otherwise(0) for i, t in enumerate(vocab[a : a + WORD_BITS])]
        total = bits[0].cast("long")
        for b in bits[1:]:
            total = total.bitwiseOR(b.cast("long"))
        masks.append(total.alias(f"mask{a // WORD_BITS}"))
    names = [f"mask{k}" for k in range(len(masks))]
    return low.select("key", *masks).where(" or ".join(f"{n} <> 0" for n in names)).groupBy("key").agg(*[F.bit_or(n).alias(n) for n in names])


def postings(docs: DataFrame, text: str = "text", rules=RULES, block_texts: int = BLOCK_TEXTS) -> DataFrame:
    """The index: (block, trigram, keys), a sorted posting list for each block and trigram."""
    vocab = vocabulary(rules)
    held = checkpointed(held_trigrams(docs, F.col(text), vocab))
    blocks = held.count() // block_texts + 1
    dealt = held.withColumn("block", F.pmod("key", F.lit(blocks))).repartition("block")
    found = [F.when(F.col(f"mask{i // WORD_BITS}").bitwiseAND(F.lit(1 << i % WORD_BITS)) != 0, F.lit(t)) for i, t in enumerate(vocab)]
    entries = dealt.select("block", "key", F.explode(F.array_compact(F.array(*found))).alias("trigram"))
    return entries.groupBy("block", "trigram").agg(F.array_sort(F.collect_list("key")).alias("keys"))


def matching(query: tuple, lists: Column) -> Column:
    """The keys that satisfy ``query``, from a block's map of posting lists."""
    if query[0] == "has":
        return F.coalesce(F.try_element_at(lists, F.lit(query[1])), F.array().cast("array<bigint>"))
    a, b = matching(query[1], lists), matching(query[2], lists)
    return F.array_intersect(a, b) if query[0] == "and" else F.array_union(a, b)


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """(key, rules): bit k of rules says that the text may match the k-th rule."""
    block = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("lists"))
    queries = [(k, trigram_query(r[1])) for k, r in enumerate(rules)]

    def marked(k):
        return lambda key: F.struct(key.alias("key"), F.lit(1 << k).cast("long").alias("rule"))

    found = [F.transform(matching(q, F.col("lists")), marked(k)) for k, q in queries if q != ANY]
    if not found:
        return index.select(F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("rules")).limit(0)
    return block.select(F.explode(F.concat(*found)).alias("c")).groupBy("c.key").agg(F.bit_or("c.rule").alias("rules"))


def long_enough(least: int):
    return lambda m: F.length(m["part"]) >= least


def scan(docs: DataFrame, text: str = "text", *, rules=RULES, prefix: str = "", block_texts: int = BLOCK_TEXTS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with ``spans`` and ``base_spans``: arrays of (start, ord, end), ord numbering the rules."""
    p = "__secret_"
    own = docs.columns
    some = checkpointed(candidates(postings(docs, text, rules, block_texts), rules)).select(F.col("key").alias(p + "key"), F.col("rules").alias(p + "rules"))
    if some.count() <= broadcast_rows:
        some = F.broadcast(some)
    out = docs.withColumn(p + "text", F.coalesce(F.col(text), F.lit("")))
    out = out.join(some, text_key(F.col(p + "text")) == F.col(p + "key"), "left")
    found = {}
    for k, (kind, pattern, java, group, least) in enumerate(rules):
        scans = trigram_query(pattern) == ANY
        may = F.lit(True) if scans else F.coalesce(F.col(p + "rules").bitwiseAND(F.lit(1 << k)) != 0, F.lit(False))
        hits = S.matches(F.col(p + "text"), java or pattern, may, group)
        found[p + kind] = F.filter(hits, long_enough(least))
    out = out.withColumns(found)
    every = S.ordered([F.col(p + r[0]) for r in rules])
    base = S.ordered([F.col(p + r[0]) for r in rules[:BASE]])
    return out.select(*own, *[F.col(p + r[0]) for r in rules]).withColumns({prefix + "spans": every, prefix + "base_spans": base}).drop(*found)


def kinds(rules=RULES) -> list[str]:
    return [r[0] for r in rules]
