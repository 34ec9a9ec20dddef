"""Substring dedup on a compacted de Bruijn graph of token k-mers.

Every window of ``k`` words is an edge of the graph between its two (k-1)-word nodes.

1. Edges travel packed: neighbouring edges that share their minimizer (the least hash among the
   windows' ``anchor``-word grams) form one segment, a row of about five edges.  Rows are merged in
   each batch, so a passage in a third of all documents arrives as a few rows a task; then they meet
   by minimizer, sorted, and stream through one pass.  A different segment keeps its number of
   occurrences, its successor if all of them have the same one, and its source coordinates: the
   least document that has it and the first word there.
2. Branch test.  Where a minimizer has several segments, paths branch inside them: one occurrence of
   each is opened into single edges.  A segment joins its successor when both occur equally often
   and the successor's source follows its own, that is, when the node between them has in-degree and
   out-degree one.  A join compacts the repeated segments so into nonbranching paths; along a path
   all occurrences, and so the source, run side by side, and a path is known by its first segment.
3. Source coordinates are looked up in the sources' texts: each path, and each opened edge, gets a
   128-bit digest of the words that stand there.
4. All occurrences of first segments join their paths; equal single edges join by digest.  A
   document's hits are then verified in its own text: words are removed only where their digest is
   the source's.

An edge is a repeat when its words also start in a document with a smaller id; all words of
repeated edges go, as judged on the input.

Defined cases: null, empty and short texts have no edges and keep all words; a null id is smaller
than none and larger than none, so such rows keep all; repeated rows (same id) are not repeats of
each other; repeats within one document stay.  The different texts of one id meet in one task, and
so do the segments of one minimizer, which stream and are not held.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselode.llm import kernels as K
from caselode.llm.shared import stored

WORDS, ANCHOR = 13, 5
SEGMENT = "mini int, content long, first long, pos int, n int, next long, cnt long, many boolean"
RESULT = "id long, n_words long, n_removed long, kept string, spans array<struct<start:int,end:int>>, sources array<struct<start:int,end:int,source:bigint,source_start:int>>"


class Segments:
    """The segments of a slice: text, first word (in the text), edges, minimizer, content and successor of each."""

    def __init__(self, s: K.Slice, k: int, anchor: int, word_byte: np.ndarray):
        start, end, first = K.words(s, word_byte)
        h = K.word_hashes(s.data, start, end)
        at, edge = K.windows(h, first, k)
        if not len(at):
            self.text = self.pos = self.n = np.zeros(0, np.int64)
            self.mini, self.content, self.next = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        grams = K.in_a_row(h, anchor)
        best = at + np.argmin(np.lib.stride_tricks.sliding_window_view(grams, k - anchor + 1)[at], axis=1)
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = (np.diff(at) != 1) | (np.diff(best) != 0)
        opens = np.flatnonzero(fresh)
        self.n = np.diff(np.append(opens, len(at)))
        self.text = np.searchsorted(first, at[opens], side="right") - 1
        self.pos = at[opens] - first[self.text]
        self.mini = grams[best[opens]].astype(np.uint32).view(np.int32)
        # at most k - anchor + 1 edges: the first and the last one hold all words of the segment
        content = K.combined(K.combined(edge[opens], edge[opens + self.n - 1]), self.n.astype(np.uint64))
        self.content = content.view(np.int64)
        self.next = np.zeros(len(opens), np.int64)
        self.next[:-1] = np.where(self.text[1:] == self.text[:-1], self.content[1:], 0)


def column(batch, i: int) -> np.ndarray:
    return batch.column(i).to_numpy(zero_copy_only=False)


def merged(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Segment rows, sorted by all but the last four columns, with equal (mini, content) made one."""
    mini, content, first, pos, n, nxt, cnt, many = rows
    fresh = np.ones(len(mini), dtype=bool)
    fresh[1:] = (mini[1:] != mini[:-1]) | (content[1:] != content[:-1])
    at = np.flatnonzero(fresh)
    last = np.append(at[1:], len(mini)) - 1
    low, high = np.minimum.reduceat(nxt, at), np.maximum.reduceat(nxt, at)
    return [mini[at], content[at], first[at], pos[at], n[at], np.where(low == high, low, 0), np.add.reduceat(cnt, at), np.logical_or.reduceat(many, at) | (first[at] != first[last])]


SEGMENT_TYPES = (np.int32, np.int64, np.int64, np.int32, np.int32, np.int64, np.int64, bool)
SEGMENT_NAMES = [f.split()[0] for f in SEGMENT.split(", ")]


def as_batch(rows: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(r) for r in rows], names=names)


def segment_batches(batches, k, anchor):
    """Each batch's different segments."""
    word_byte = ~K.byte_table(K.SPACES)
    for batch in batches:
        ids, parts = column(batch, 0), []
        for s in K.slices(batch.column(1)):
            p = Segments(s, k, anchor, word_byte)
            parts.append((p.mini, p.content, ids[s.lo + p.text], p.pos, p.n, p.next))
        if not parts:
            continue
        rows = [np.concatenate(x) for x in zip(*parts)]
        if len(rows[0]):
            order = np.lexsort((rows[3], rows[2], rows[1], rows[0]))
            rows = [r[order] for r in rows] + [np.ones(len(order), np.int64), np.zeros(len(order), bool)]
            yield as_batch([r.astype(t) for r, t in zip(merged(rows), SEGMENT_TYPES)], SEGMENT_NAMES)


def source_batches(batches):
    """The repeated or branching segments of sorted segment rows, streamed; one segment is held between batches."""
    held, before = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [column(batch, i) for i in range(len(SEGMENT_NAMES))]
        if held is not None:
            rows = [np.concatenate([a, b]) for a, b in zip(held, rows)]
        rows = merged(rows)
        held, done = [r[-1:] for r in rows], [r[:-1] for r in rows]
        same = rows[0][1:] == rows[0][:-1]
        branches = same | np.append([before is not None and before == rows[0][0]], same[:-1]) if len(same) else same
        if len(same):
            before = done[0][-1]
        keep = done[7] | branches
        if keep.any():
            yield as_batch([*[r[keep] for r in done], branches[keep]], [*SEGMENT_NAMES, "branches"])
    if held is not None:
        branches = np.array([before is not None and before == held[0][0]])
        if held[7][0] or branches[0]:
            yield as_batch([*held, branches], [*SEGMENT_NAMES, "branches"])


def occurrence_batches(batches, k, anchor):
    word_byte = ~K.byte_table(K.SPACES)
    for batch in batches:
        ids = column(batch, 0)
        for s in K.slices(batch.column(1)):
            p = Segments(s, k, anchor, word_byte)
            if len(p.pos):
                yield as_batch([p.content, ids[s.lo + p.text], p.pos.astype(np.int32)], ["content", "id", "pos"])


def elements(array: pa.Array, fields: list[str]):
    """(row of each element, the elements' fields as arrays) of a list<struct> column that may hold nulls."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    flat, sizes = array.flatten(), np.diff(array.offsets.to_numpy())
    if array.null_count:
        sizes = np.where(array.is_null().to_numpy(zero_copy_only=False), 0, sizes)
    return np.repeat(np.arange(len(array)), sizes), [flat.field(f).to_numpy(zero_copy_only=False) for f in fields]


def digest(words: list[bytes]) -> tuple[int, int]:
    """128 bits of the words as they stand."""
    raw = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def lookup_batches(batches, k):
    """The digests of what stands at asked coordinates: paths whole, branching segments edge by edge."""
    for batch in batches:
        ids = column(batch, 0)
        rows, (key, pos, edges, single) = elements(batch.column(2), ["key", "pos", "edges", "single"])
        cuts = np.searchsorted(rows, np.arange(batch.num_rows + 1))
        for s in K.slices(batch.column(1)):
            out: list[tuple] = []
            for i in range(len(s)):
                own = slice(cuts[s.lo + i], cuts[s.lo + i + 1])
                if own.start == own.stop:
                    continue
                words, doc = s.text(i).split(), int(ids[s.lo + i])
                for what, a, n, one in zip(key[own].tolist(), pos[own].tolist(), edges[own].tolist(), single[own].tolist()):
                    if one:
                        out += [(what, doc, b, *digest(words[b : b + k]), True) for b in range(a, a + n) if b + k <= len(words)]
                    elif a + n + k - 1 <= len(words):
                        out.append((what, doc, a, *digest(words[a : a + n + k - 1]), False))
            if out:
                key_, id_, pos_, d1, d2, single_ = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key_, pa.int64()), pa.array(id_, pa.int64()), pa.array(pos_, pa.int32()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(single_)],
                    names=["key", "id", "pos", "d1", "d2", "single"],
                )


def remove_batches(batches, k):
    """(id, n_words, n_removed, kept, spans, sources): the words outside verified hits, joined by one space."""
    word_byte = ~K.byte_table(K.SPACES)
    for batch in batches:
        rows, fields = elements(batch.column(2), ["pos", "edges", "d1", "d2", "source", "source_pos", "single"])
        cuts = np.searchsorted(rows, np.arange(batch.num_rows + 1))
        for s in K.slices(batch.column(1)):
            n_words, n_removed, kept, spans, sources = [], [], [], [], []
            for i in range(len(s)):
                words = s.text(i).split()
                n_words.append(len(words))
                own = slice(cuts[s.lo + i], cuts[s.lo + i + 1])
                hits = sorted(zip(*[f[own].tolist() for f in fields])) if own.start < own.stop else []
                hits = [h for h in hits if h[0] + h[1] + k - 1 <= len(words) and digest(words[h[0] : h[0] + h[1] + k - 1]) == h[2:4]]
                if not hits:
                    n_removed.append(0)
                    kept.append(b" ".join(words).decode("utf-8", "replace"))
                    spans.append([])
                    sources.append([])
                    continue
                border = np.zeros(len(words) + 1, np.int64)
                for pos, edges, *_ in hits:
                    border[pos] += 1
                    border[pos + edges + k - 1] -= 1
                gone = np.cumsum(border)[:-1] > 0
                singles = [h[0] for h in hits if h[6]]
                if singles:  # the same edge elsewhere in this document goes, too
                    start, end, _ = K.words(K.Slice(0, 1, s.data[s.offs[i] : s.offs[i + 1]], np.array([0, s.offs[i + 1] - s.offs[i]])), word_byte)
                    edge = K.rows_of(K.word_codes(s.data[s.offs[i] : s.offs[i + 1]], start, end)[0], k)
                    gone |= K.covered(len(words), np.flatnonzero(np.isin(edge, edge[singles])), k)
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join(w for w, g in zip(words, gone.tolist()) if not g).decode("utf-8", "replace"))
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])])
                runs: list[dict] = []
                for pos, edges, _, _, source, at, _ in hits:
                    last = runs[-1] if runs else None
                    if last and last["source"] == source and pos <= last["end"] and at - pos == last["source_start"] - last["start"]:
                        last["end"] = max(last["end"], pos + edges + k - 1)
                    else:
                        runs.append({"start": pos, "end": pos + edges + k - 1, "source": source, "source_start": at})
                sources.append(runs)
            span, origin = pa.struct([("start", pa.int32()), ("end", pa.int32())]), pa.struct([("start", pa.int32()), ("end", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(s.lo, len(s)), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(span)), pa.array(sources, pa.list_(origin))],
                names=["id", "n_words", "n_removed", "kept", "spans", "sources"],
            )


def repeated_segments(known: DataFrame, words: int, anchor: int) -> DataFrame:
    """The segments that repeat or branch, with count, successor and source coordinates; a stored table."""
    made = known.mapInArrow(lambda it: segment_batches(it, words, anchor), SEGMENT)
    dealt = made.repartition("mini").sortWithinPartitions("mini", "content", "first", "pos")
    return stored(dealt.mapInArrow(source_batches, SEGMENT + ", branches boolean"))


def paths(segments: DataFrame) -> DataFrame:
    """(content, first, pos, edges) of the nonbranching paths of repeated segments; content is the first segment's."""
    many = segments.where("many").select("content", "first", "pos", "n", "next", "cnt")
    # keyed by successor, count and where the successor's source must be: at most one row per segment
    before = many.where("next <> 0").select(F.col("next").alias("content"), "cnt", "first", (F.col("pos") + F.col("n")).alias("pos"), F.lit(True).alias("inner"))
    along = W.partitionBy("first").orderBy("pos")
    numbered = many.join(before, ["content", "cnt", "first", "pos"], "left").withColumn("path", F.count(F.when(F.col("inner").isNull(), 1)).over(along))
    return numbered.groupBy("first", "path").agg(F.min_by("content", "pos").alias("content"), F.min("pos").alias("pos"), F.sum("n").cast("int").alias("edges")).drop("path")


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", *, words: int = WORDS, anchor: int = ANCHOR) -> DataFrame:
    """(id, n_words, n_removed, kept, spans, sources) per document.

    spans: word ranges taken out; sources: the verified repeats behind them and where their first copies start.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    known = rows.where(F.col("id").isNotNull())
    segments = repeated_segments(known, words, anchor)
    compact = stored(paths(segments))

    whole = compact.select(F.col("first").alias("id"), F.struct(F.col("content").alias("key"), "pos", "edges", F.lit(False).alias("single")).alias("ask"))
    opened = segments.where("branches").select(F.col("first").alias("id"), F.struct(F.col("content").alias("key"), "pos", F.col("n").alias("edges"), F.lit(True).alias("single")).alias("ask"))
    asked = whole.unionByName(opened).groupBy("id").agg(F.collect_list("ask").alias("asks"))
    looked = known.join(asked, "id").select("id", "text", "asks").mapInArrow(lambda it: lookup_batches(it, words), "key long, id long, pos int, d1 long, d2 long, single boolean")
    looked = stored(looked)

    heads = compact.join(looked.where("not single").select(F.col("key").alias("content"), "d1", "d2"), "content").select("content", "edges", "d1", "d2", F.col("first").alias("source"), F.col("pos").alias("source_pos"))
    seen = known.mapInArrow(lambda it: occurrence_batches(it, words, anchor), "content long, id long, pos int")
    met = seen.join(heads, "content").where("id > source").select("id", F.struct("pos", "edges", "d1", "d2", "source", "source_pos", F.lit(False).alias("single")).alias("hit"))

    edges = looked.where("single").select("d1", "d2", "id", "pos")
    least = edges.groupBy("d1", "d2").agg(F.min("id").alias("source"), F.min_by("pos", "id").alias("source_pos"), F.max("id").alias("most")).where("source < most").drop("most")
    alone = edges.join(least, ["d1", "d2"]).where("id > source").select("id", F.struct("pos", F.lit(1).alias("edges"), "d1", "d2", "source", "source_pos", F.lit(True).alias("single")).alias("hit"))

    hits = stored(met.unionByName(alone).groupBy("id").agg(F.collect_set("hit").alias("hits")))
    full = rows.join(hits, "id", "left").select("id", "text", "hits")
    return full.mapInArrow(lambda it: remove_batches(it, words), RESULT)


K.ship(sys.modules[__name__])
