"""Benchmark decontamination by one Aho-Corasick automaton over normalised items.

Normalising lower-cases A-Z and joins the words by one space, so a window of item words is a plain
substring ``" w1 .. w8 "`` of the padded text; the automaton holds all windows of all items and
scans each text once.  Word numbers found there map back to character offsets of the original.

The items are the stated query set.  Their total size is measured first; up to ``block_chars`` of
them make one broadcast automaton, and documents are scanned once, in a narrow pass.  A larger
benchmark is cut into blocks of that size.  One block at a time is collected, broadcast, scanned and
released; what is stored of each are the hits, by the digest of the text that has them, and
the hits of all blocks meet the documents in one join.  So neither the driver nor an executor ever
holds more than one block, and words, items and spans are those of one automaton.

Defined cases: null, empty and wordless texts (on either side) have no words, no windows and no
hits; items without an id are ignored, repeated items count once; a repeated document row gets the
same result again; extra columns of any name are carried through.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselode.llm import kernels as K
from caselode.llm.shared import stored

WINDOW = 8
MIN_ITEMS = 2
BLOCK_CHARS = 1 << 20
FIELDS = (
    ("n_words", "long"),
    ("hit_words", "array<int>"),
    ("items", "array<string>"),
    ("spans", "array<struct<start:int,end:int>>"),
)


def fold_table() -> bytes:
    """Bytes to their normalised form: lower case, or a space for what is in no word."""
    return bytes(b + 32 if 65 <= b <= 90 else 0x20 if b in K.NOT_ITEM_WORD else b for b in range(256))


def item_windows(items, window: int) -> dict[str, tuple[int, list[str]]]:
    """Padded pattern -> (its words, ids of the items that have it)."""
    fold, out = fold_table(), {}
    for item_id, text in items:
        toks = (text or "").encode().translate(fold).decode("latin-1").split(" ")
        toks = [t for t in toks if t]
        n = min(window, len(toks))
        for i in range(len(toks) - n + 1 if toks else 0):
            ids = out.setdefault(f" {' '.join(toks[i : i + n])} ", (n, []))[1]
            if item_id not in ids:
                ids.append(item_id)
    return out


_built: dict = {}


def automaton(shared, window: int):
    """The automaton of a broadcast block; built once a worker."""
    import ahocorasick

    items = shared.value
    key = (hash(tuple(items)), window)
    if key not in _built:
        _built.clear()
        made = ahocorasick.Automaton()
        for pattern, found in item_windows(items, window).items():
            made.add_word(pattern, found)
        if len(made):
            made.make_automaton()
        _built[key] = made
    return _built[key]


def hits_in(raw: bytes, fold: bytes, machine) -> tuple[np.ndarray, list[str]]:
    """(numbers of the words in windows, items) of one text."""
    # cut as bytes: as characters, \x85 and \xa0 of a word's UTF-8 would be blanks
    flat = f" {b' '.join(raw.translate(fold).split()).decode('latin-1')} "
    found = list(machine.iter(flat))
    if not found:
        return np.zeros(0, np.int64), []
    gaps = np.flatnonzero(np.frombuffer(flat.encode("latin-1"), np.uint8) == 32)
    last = np.searchsorted(gaps, [e for e, _ in found])  # the space behind the window's last word
    hit = np.zeros(len(gaps), dtype=np.int64)
    n = np.array([n for _, (n, _) in found])
    np.add.at(hit, last - n, 1)
    np.add.at(hit, last, -1)
    return np.flatnonzero(np.cumsum(hit)[:-1] > 0), sorted({str(x) for _, (_, ids) in found for x in ids})


def spans_of(raw: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> list[dict]:
    """Character ranges of the runs of words ``at``; start, end: the words' bytes in the text."""
    if not len(at):
        return []
    lead = np.cumsum((raw & 0xC0) != 0x80)
    runs = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    a, b = start[at[runs]], end[at[np.append(runs[1:], len(at)) - 1]]
    return [{"start": int(lead[x] - 1), "end": int(lead[y - 1])} for x, y in zip(a, b)]


def item_bytes() -> np.ndarray:
    return ~K.byte_table(bytes(b for b in K.NOT_ITEM_WORD if not 65 <= b <= 90))


def described(batch, text_at: int, hits) -> pa.RecordBatch:
    """``batch`` with the columns of ``FIELDS``; hits(slice, i): hit words and items of its i-th text."""
    word_byte, n_words, hit_words, items, spans = item_bytes(), [], [], [], []
    for s in K.slices(batch.column(text_at)):
        start, end, first = K.words(s, word_byte)
        n_words.append(np.diff(first))
        for i in range(len(s)):
            at, names = hits(s, i) if first[i + 1] > first[i] else (np.zeros(0, np.int64), [])
            own = slice(first[i], first[i + 1])
            hit_words.append(at.tolist())
            items.append(names)
            spans.append(spans_of(s.data[s.offs[i] : s.offs[i + 1]], start[own] - s.offs[i], end[own] - s.offs[i], at))
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    made = [pa.array(np.concatenate(n_words), pa.int64()), pa.array(hit_words, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(span))]
    return pa.RecordBatch.from_arrays([*batch.columns, *made], names=[f"c{i}" for i in range(batch.num_columns + len(made))])


def scan_batches(batches, shared, window, text_at):
    """One block: every row with what it holds."""
    fold, machine = fold_table(), automaton(shared, window)
    nothing = (np.zeros(0, np.int64), [])
    for batch in batches:
        if batch.num_rows:
            yield described(batch, text_at, lambda s, i: hits_in(s.text(i), fold, machine) if len(machine) else nothing)


def hit_batches(batches, shared, window):
    """One of several blocks: (digest, hit_words, items) of the different texts that it hits."""
    fold, machine = fold_table(), automaton(shared, window)
    for batch in batches:
        out = {}
        for s in K.slices(batch.column(0)) if len(machine) else ():
            for i in range(len(s)):
                at, names = hits_in(s.text(i), fold, machine)
                if names:
                    out[hashlib.md5(s.text(i)).hexdigest()] = (at.tolist(), names)
        if out:
            at, names = zip(*out.values())
            yield pa.RecordBatch.from_arrays([pa.array(list(out)), pa.array(at, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))], names=["digest", "hit_words", "items"])


def merged_batches(batches, text_at):
    """Rows whose last two columns are the united hit words and items of all blocks, or null."""
    for batch in batches:
        if batch.num_rows:
            words, names = (c.to_pylist() for c in batch.columns[-2:])
            rest = pa.RecordBatch.from_arrays(batch.columns[:-2], names=batch.schema.names[:-2])
            yield described(rest, text_at, lambda s, i, words=words, names=names: (np.array(words[s.lo + i] or [], np.int64), names[s.lo + i] or []))


def item_blocks(bench: DataFrame, item_id: str, text: str, block_chars: int) -> tuple[int, Iterator[list[tuple[str, str]]]]:
    """(number of blocks, the blocks): of bounded size, collected one at a time as they are asked for."""
    rows = bench.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).distinct()
    total = rows.agg(F.sum(F.length("text") + 16).alias("n")).first()["n"] or 0
    n = int(total // block_chars) + 1
    part = F.pmod(F.xxhash64("id", "text"), F.lit(n))
    return n, (sorted((r["id"], r["text"]) for r in rows.where(part == i).collect()) for i in range(n))


def scan(docs: DataFrame, bench: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", *, window: int = WINDOW, min_items: int = MIN_ITEMS, block_chars: int = BLOCK_CHARS, prefix: str = "") -> DataFrame:
    """``docs`` with n_words, hit_words, items, spans, n_hit, n_items, contaminated (named with ``prefix``).

    For a benchmark of one block this is narrow and lazy; more blocks are scanned at once and stored.
    """
    spark, own = docs.sparkSession, [f.name for f in docs.schema.fields]
    text_at, at = own.index(text), len(own)
    numbered = docs.toDF(*[f"c{i}" for i in range(at)])
    made = T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in FIELDS))
    schema = T.StructType([T.StructField(f"c{i}", f.dataType, True) for i, f in enumerate([*docs.schema.fields, *made.fields])])
    n, blocks = item_blocks(bench, item_id, item_text, block_chars)
    if n == 1:
        shared = spark.sparkContext.broadcast(next(blocks))
        out = numbered.mapInArrow(lambda it: scan_batches(it, shared, window, text_at), schema)
    else:
        found = None
        for block in blocks:
            shared = spark.sparkContext.broadcast(block)
            part = stored(numbered.select(f"c{text_at}").mapInArrow(lambda it, shared=shared: hit_batches(it, shared, window), "digest string, hit_words array<int>, items array<string>"))
            shared.destroy()
            found = part if found is None else found.unionByName(part)
        # copies have the same hits in a block: sets unite them
        united = found.groupBy("digest").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("hit_words")))).alias("hit_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        full = numbered.join(united, F.md5(F.coalesce(f"c{text_at}", F.lit(""))) == F.col("digest"), "left").drop("digest")
        out = full.mapInArrow(lambda it: merged_batches(it, text_at), schema)
    cols = [F.col(f"c{i}").alias(name) for i, name in enumerate(own)]
    hits, items = F.col(f"c{at + 1}"), F.col(f"c{at + 2}")
    named = {"n_words": F.col(f"c{at}"), "hit_words": hits, "items": items, "spans": F.col(f"c{at + 3}"), "n_hit": F.size(hits).cast("long"), "n_items": F.size(items).cast("long"), "contaminated": F.size(items) >= min_items}
    return out.select(*cols, *[c.alias(prefix + n) for n, c in named.items()])


def drop_contaminated(docs: DataFrame, bench: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with windows of fewer than ``min_items`` items, and their own columns only."""
    own = docs.columns
    mark = "__scan_"
    return scan(docs, bench, text, prefix=mark, **options).where(~F.col(mark + "contaminated")).drop(*[mark + n for n in ("n_words", "hit_words", "items", "spans", "n_hit", "n_items", "contaminated")]).toDF(*own)


K.ship(sys.modules[__name__])
