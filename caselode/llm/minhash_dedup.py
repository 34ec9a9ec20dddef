"""MinHash near-dedup with bottom-k sketches from one hash function.

1. Each text becomes its set of distinct word shingles (64-bit hashes) and keeps the set's size, a
   128-bit hash of the set and its ``SKETCH`` smallest values.  Equal sets form a class; one
   member, the smallest id, stands for it from here on, so copies cost one row each.
2. Inverted lists: neighbouring pairs among the ``LISTED`` smallest values are the keys.  (With
   Jaccard 0.85 a pair of neighbours is common with probability 0.72; that none of 19 is, has
   probability 1e-8.  A single value would put all texts with one common passage in one list.)
   A list of more than ``BLOCK`` texts, or of more than ``BLOCK_SHINGLES`` shingles together, is cut
   into hash blocks, and pairs of blocks are compared.
3. Union-sketch estimation: inside a list, texts whose sketches share too few values for the
   threshold (by more than five standard deviations) are no candidates.  Each candidate pair is
   handled in one list only, its smallest common key.  What leaves the list are members with a
   candidate, not pairs.
4. Exact Jaccard on full sets, again inside the lists' blocks, where words are compared by their
   bytes and not by hashes; a block emits a spanning forest of its links, so a dense group of g
   texts gives at most about 2 g links a block pair, never g * g.
5. Components by star contraction; every document joins its class's component.

Blocks keep tasks small, but g different texts that share a key still cost g * g / 2 sketch
comparisons (about 0.2 microseconds each), spread over (g / BLOCK)**2 / 2 tasks.

Defined cases: null, empty and wordless texts have empty sets and are linked with nothing; fewer
words than a shingle make one shingle of the whole sequence; repeated rows belong to one class; rows
with the same id count as one node; a null id is never a node, such a row's component is that
of its class, or null.  Extra columns are not read.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselode.llm import kernels as K
from caselode.llm.graph import components
from caselode.llm.shared import checkpointed

SHINGLE, PERCENT = 5, 80
SKETCH, LISTED, BLOCK, BLOCK_SHINGLES = 64, 20, 512, 1 << 20
PAD = np.uint32(0xFFFFFFFF)
SIGNATURE = "id long, n long, c1 long, c2 long, sketch binary"


def shingle_sets(s: K.Slice, k: int, word_byte: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, borders): each text's distinct shingles, sorted by hash."""
    start, end, first = K.words(s, word_byte)
    wh = K.word_hashes(lower[s.data], start, end)
    at, h = K.windows(wh, first, k)
    doc = K.owners(first)[at] if len(at) else np.zeros(0, np.int64)
    count = np.diff(first)
    hashes, docs = [h], [doc]
    for n in range(1, k):  # texts of fewer words than a shingle
        short = np.flatnonzero(count == n)
        if len(short):
            hashes.append(K.combined(K.in_a_row(wh, n)[first[short]], np.full(len(short), n, np.uint64)))
            docs.append(short)
    h, doc = np.concatenate(hashes), np.concatenate(docs)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[fresh], doc[fresh]
    return h, np.searchsorted(doc, np.arange(len(s) + 1))


def exact_sets(slices, k: int, word_byte: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, sizes): the shingle sets of a group's texts; equal numbers are equal words, by their bytes."""
    known: dict[bytes, int] = {}
    words, count = [], []
    for s in slices:
        start, end, first = K.words(s, word_byte)
        words.append(K.word_ids(lower[s.data], start, end, known))
        count.append(np.diff(first))
    words, count = np.concatenate(words), np.concatenate(count)
    first = np.concatenate([[0], np.cumsum(count)])
    at = K.within(len(words), first, k)
    ids, doc, base = [K.rows_of(words, k)[at]] if len(at) else [np.zeros(0, np.int64)], [K.owners(first)[at]] if len(at) else [np.zeros(0, np.int64)], len(words)
    for n in range(1, k):
        short = np.flatnonzero(count == n)
        if len(short):
            ids.append(K.rows_of(words, n)[first[short]] + n * base)
            doc.append(short)
    pair = np.unique(np.stack([np.concatenate(doc), np.concatenate(ids)], axis=1), axis=0)
    return pair[:, 1], np.bincount(pair[:, 0], minlength=len(count))


def tables() -> tuple[np.ndarray, np.ndarray]:
    return ~K.byte_table(K.SPACES), K.ascii_lower_table()


def sign_batches(batches, k):
    word_byte, lower = tables()
    for batch in batches:
        ids = batch.column(0)
        for s in K.slices(batch.column(1)):
            h, at = shingle_sets(s, k, word_byte, lower)
            n = np.diff(at)
            sums = []
            for salt in (0, 0x9E3779B97F4A7C15):
                total = np.zeros(len(h) + 1, dtype=np.uint64)
                np.cumsum(K.mix(h ^ np.uint64(salt)), out=total[1:])
                sums.append((total[at[1:]] - total[at[:-1]]).astype(np.int64))
            top = np.minimum(h >> np.uint64(32), np.uint64(0xFFFFFFFE)).astype(np.uint32)  # the last value pads
            sketch = [top[a : min(b, a + SKETCH)].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([ids.slice(s.lo, len(s)), pa.array(n, pa.int64()), pa.array(sums[0]), pa.array(sums[1]), pa.array(sketch, pa.binary())], names=["id", "n", "c1", "c2", "sketch"])


def list_keys(values: np.ndarray) -> np.ndarray:
    """The keys of a sketch: neighbouring pairs of its LISTED smallest values, as 64-bit numbers."""
    v = values[:LISTED].astype(np.uint64)
    return ((v[:-1] << np.uint64(32)) | v[1:]).view(np.int64)


def key_batches(batches):
    for batch in batches:
        keys = [list_keys(np.frombuffer(x, np.uint32)) for x in batch.column(2).to_pylist()]
        rep = np.repeat(np.arange(batch.num_rows), [len(x) for x in keys])
        flat = np.concatenate([*keys, np.zeros(0, np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(flat), batch.column(0).take(pa.array(rep)), batch.column(1).take(pa.array(rep))], names=["key", "id", "n"])


def pairs_in(count, block, cross: bool, size, percent):
    """For each row i, the later rows that it may be linked with: by block rule and by size."""
    for i in range(count - 1):
        j = np.arange(i + 1, count)
        ok = np.minimum(size[i], size[j]) * 100 >= percent * np.maximum(size[i], size[j])
        if cross:
            ok &= block[i] != block[j]
        j = j[ok]
        if len(j):
            yield i, j


def least_shared(percent: int, k: int) -> int:
    """Shared values of a union's k smallest that a linked pair falls short of once in a million at most."""
    p = percent / 100
    return int(k * p - 4.9 * (k * p * (1 - p)) ** 0.5)


def union_shared(one: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shared, size) of the union's SKETCH smallest values, of one padded sketch with each of others."""
    merged = np.sort(np.concatenate([np.broadcast_to(one, others.shape), others], axis=1), axis=1)
    real = merged != PAD
    twice = np.zeros(merged.shape, dtype=bool)
    twice[:, 1:] = (merged[:, 1:] == merged[:, :-1]) & real[:, 1:]
    place = np.cumsum(real & ~twice, axis=1)
    return (twice & (place <= SKETCH)).sum(axis=1), np.minimum(place[:, -1], SKETCH)


def filter_batches(batches, percent):
    """In each (key, bi, bj) group: the members that have a candidate whose smallest common key is this one.

    Two members that are marked already meet in the next step anyway, so only pairs that would mark
    somebody are looked at: a dense group costs little more than its size.
    """
    enough = least_shared(percent, SKETCH)
    for group in K.runs(batches, 3):
        count = group.num_rows
        if count < 2:
            continue
        key, bi, bj = (group.column(c)[0].as_py() for c in range(3))
        block, size = group.column(3).to_numpy(), group.column(5).to_numpy()
        rows = [np.frombuffer(x, np.uint32) for x in group.column(6).to_pylist()]
        padded = np.full((count, SKETCH), PAD, dtype=np.uint32)
        for i, r in enumerate(rows):
            padded[i, : len(r)] = r
        flat, ids = np.unique(padded, return_inverse=True)
        ids = ids.reshape(padded.shape)
        table = np.zeros(len(flat), dtype=bool)
        smaller = [k[k < key] for k in map(list_keys, rows)]
        keys, key_ids = np.unique(np.concatenate(smaller), return_inverse=True)
        key_cuts = np.concatenate([[0], np.cumsum([len(k) for k in smaller])])
        key_table = np.zeros(len(keys), dtype=bool)
        marked = np.zeros(count, dtype=bool)
        for i, js in pairs_in(count, block, bi != bj, size, percent):
            if marked[i]:
                js = js[~marked[js]]
                if not len(js):
                    continue
            own = ids[i, : len(rows[i])]
            table[own] = True
            shared = table[ids[js]].sum(axis=1)
            table[own] = False
            union = np.minimum(size[i] + size[js] - shared, SKETCH)
            js = js[shared >= np.where(union < SKETCH, (percent * union + 99) // 100, enough)]
            if not len(js):
                continue
            own = key_ids[key_cuts[i] : key_cuts[i + 1]]
            key_table[own] = True
            total = np.concatenate([[0], np.cumsum(key_table[key_ids])])
            key_table[own] = False
            js = js[total[key_cuts[js + 1]] == total[key_cuts[js]]]
            if not len(js):
                continue
            held, width = union_shared(padded[i], padded[js])
            js = js[held >= np.where(width == SKETCH, enough, (percent * width) // 100)]
            if len(js):
                marked[i] = True
                marked[js] = True
        if marked.any():
            at = pa.array(np.flatnonzero(marked))
            yield pa.RecordBatch.from_arrays([flat_column(group, c).take(at) for c in (0, 1, 2, 3, 4)], names=["key", "bi", "bj", "block", "id"])


def flat_column(table: pa.Table, c: int) -> pa.Array:
    column = table.column(c)
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def verify_batches(batches, k, percent):
    """In each (key, bi, bj) group: a spanning forest of the links that exact Jaccard on the full sets confirms."""
    word_byte, lower = tables()
    for group in K.runs(batches, 3):
        count = group.num_rows
        if count < 2:
            continue
        bi, bj = group.column(1)[0].as_py(), group.column(2)[0].as_py()
        block, node = group.column(3).to_numpy(), group.column(4).to_numpy()
        numbers, size = exact_sets(K.slices(group.column(5)), k, word_byte, lower)
        flat, ids = np.unique(numbers, return_inverse=True)
        cuts = np.concatenate([[0], np.cumsum(size)])
        table = np.zeros(len(flat) + 1, dtype=bool)
        ids = np.append(ids, len(flat))  # reduceat needs an element after the last border
        part = np.arange(count)  # the component of each member, as linked so far
        links = []
        for i, js in pairs_in(count, block, bi != bj, size, percent):
            js = js[part[js] != part[i]]
            if not len(js):
                continue
            own = ids[cuts[i] : cuts[i + 1]]
            table[own] = True
            total = np.concatenate([[0], np.cumsum(table[ids])])
            table[own] = False
            shared = total[cuts[js + 1]] - total[cuts[js]]
            hits = js[(shared > 0) & (100 * shared >= percent * (size[i] + size[js] - shared))]
            for other, at in zip(*np.unique(part[hits], return_index=True)):
                links.append((node[i], node[hits[at]]))
                part[part == other] = part[i]
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])


def links(docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): links between class representatives that together connect what exact links connect.

    docs: (id, text); classes: (id, n, sketch), a row per class.
    """
    members = classes.where("n > 1 and id is not null").select("id", "n", "sketch").mapInArrow(key_batches, "key long, id long, n long")
    lists = members.groupBy("key").agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("held")).where("g > 1")
    blocks = F.greatest(F.ceil(F.col("g") / BLOCK), F.least(F.col("g"), F.ceil(F.col("held") / BLOCK_SHINGLES)))
    block = F.pmod(F.xxhash64("id"), blocks).cast("int")
    met = members.join(lists, "key").select("key", "id", block.alias("block"), F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)).alias("other"))
    met = met.select("key", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "id")
    sketched = met.join(classes.select("id", "n", "sketch"), "id").select("key", "bi", "bj", "block", "id", "n", "sketch")
    grouped = sketched.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    marks = grouped.mapInArrow(lambda it: filter_batches(it, percent), "key long, bi int, bj int, block int, id long")
    marks = checkpointed(marks)
    full = marks.join(docs.select("id", "text"), "id").select("key", "bi", "bj", "block", "id", "text")
    grouped = full.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    return grouped.mapInArrow(lambda it: verify_batches(it, k, percent), "a long, b long")


def group(docs: DataFrame, text: str = "text", key: str = "doc_id", *, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, kept) per document; link where 100 * common >= percent * union."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    signed = checkpointed(rows.mapInArrow(lambda it: sign_batches(it, shingle), SIGNATURE))
    held = signed.where("n > 0")
    reps = held.groupBy("c1", "c2").agg(F.min("id").alias("rep"))
    classes = held.join(reps, ["c1", "c2"]).where("id = rep").dropDuplicates(["c1", "c2"]).select("id", "n", "sketch")
    found = components(links(rows, classes, shingle, percent))
    named = reps.join(found, F.col("rep") == F.col("node"), "left").select("c1", "c2", F.coalesce("component", "rep").alias("component"))
    out = signed.select("id", "n", "c1", "c2").join(named, ["c1", "c2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; repeated rows once.

    The ids to keep are joined to ``docs`` once.  Ids of several kept rows are looked for among the
    ids alone; only where there are any do rows meet by (id, text), and then only those.
    """
    own = docs.columns
    kept = checkpointed(group(docs, text, key, **options).where("kept").groupBy(F.col("id").alias("__dedup_id")).agg(F.count(F.lit(1)).alias("__dedup_n")))
    out = docs.join(kept, F.col(key).cast("long").eqNullSafe(F.col("__dedup_id")))
    if kept.where("__dedup_n > 1").limit(1).count():
        again = out.where("__dedup_n > 1").withColumn("__dedup_text", F.xxhash64(text)).dropDuplicates([key, "__dedup_text"])
        out = out.where("__dedup_n = 1").unionByName(again.drop("__dedup_text"))
    return out.select(*own)


K.ship(sys.modules[__name__])
