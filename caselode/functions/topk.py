"""Scores of a workload of queries and each query's first documents, in Arrow batches of documents."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

#: (query, term) meetings and scores that are held at a time, and candidates before they are cut.
HELD, CANDIDATES = 2_000_000, 200_000


def met(zone: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term's number, log-tf weight) of the terms that the vocabulary holds; zone: list<struct<term, tf>>."""
    rows, flat = pc.list_parent_indices(zone), zone.flatten()
    number = pc.index_in(flat.field("term"), value_set=vocabulary)
    known = pc.is_valid(number)
    tf = flat.field("tf").filter(known).to_numpy(zero_copy_only=False)
    return rows.filter(known).to_numpy(zero_copy_only=False), number.filter(known).to_numpy(zero_copy_only=False), 1 + np.log10(tf.astype("float64"))


def sums(entries, lo: int, hi: int, starts: np.ndarray, query: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums, met at all) of rows lo to hi by query, both of shape (rows, n); equal rows get equal sums."""
    row, number, w = entries
    a, b = np.searchsorted(row, [lo, hi])
    row, number, w = row[a:b] - lo, number[a:b], w[a:b]
    lengths = starts[number + 1] - starts[number]
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[number] - (ends - lengths), lengths)
    cell = np.repeat(row.astype("int64") * n, lengths) + query[at]
    shape = (hi - lo, n)
    return np.bincount(cell, np.repeat(w, lengths) * weight[at], (hi - lo) * n).reshape(shape), (np.bincount(cell, minlength=(hi - lo) * n) > 0).reshape(shape)


def cut(found: pa.Table, k: int, margin: float, least: np.ndarray) -> pa.Table:
    """Rows that can be among a query's first k once scores are rounded by less than half of ``margin``; raises ``least``.

    Of rows with one score and one zone score only the k latest ids can; so can nothing that lies by ``margin`` below the k-th of those.
    """
    found = found.take(pc.sort_indices(found, [("q", "ascending"), ("score", "descending"), ("zscore", "descending"), ("zone_doc_id", "descending")]))

    def places(*columns):
        fresh = np.ones(len(columns[0]), bool)
        fresh[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        at = np.arange(len(fresh))
        return at - np.maximum.accumulate(np.where(fresh, at, 0))

    q, score, zscore = (found[c].to_numpy() for c in ("q", "score", "zscore"))
    few = places(q, score, zscore) < k
    found, q, score = found.filter(pa.array(few)), q[few], score[few]
    last = places(q) == k - 1
    least[q[last]] = score[last] - margin
    return found.filter(pa.array(score >= least[q]))


def best(batches: Iterator[pa.RecordBatch], vocabulary: list[str], starts: np.ndarray, query: np.ndarray, weight: np.ndarray, names: list[str], k: int, margin: float, content: float, title: float) -> Iterator[pa.RecordBatch]:
    """(query_id, document_id, score, zscore, zone_doc_id) of the batches' best, a few more than k for each query.

    A document is (document_id, multiplier, c, t), its zones as list<struct<term, tf>>.  Term i weighs
    ``weight[j]`` in ``query[j]`` for j in ``starts[i]:starts[i + 1]``.
    """
    words, n = pa.array(vocabulary, pa.string()), len(names)
    least, held, size = np.full(n, -np.inf), [], 0
    for batch in batches:
        zones = [met(batch.column(batch.schema.get_field_index(z)), words) for z in ("c", "t")]
        cost = np.full(batch.num_rows, n, "int64")
        for row, number, _ in zones:
            cost += np.bincount(row, starts[number + 1] - starts[number], batch.num_rows).astype("int64")
        total, lo = np.cumsum(cost), 0
        multiplier = batch.column(batch.schema.get_field_index("multiplier")).to_numpy(zero_copy_only=False)
        ids = batch.column(batch.schema.get_field_index("document_id"))
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] - cost[lo] + HELD, "right")))
            (c, in_c), (t, in_t) = (sums(z, lo, hi, starts, query, weight, n) for z in zones)
            c, t = c * multiplier[lo:hi, None], t * multiplier[lo:hi, None]
            score = content * c + title * t
            row, q = np.nonzero((in_c | in_t) & (score >= least))
            titled = ~in_c[row, q] | (in_t[row, q] & (t[row, q] >= c[row, q]))
            named = ids.take(pa.array(row + lo))
            zone = pc.binary_join_element_wise(named, pa.array(np.where(titled, "t", "c").tolist(), pa.string()), ".")
            held.append(pa.table({"q": q, "document_id": named, "score": score[row, q], "zscore": np.where(titled, t[row, q], c[row, q]), "zone_doc_id": zone}))
            size, lo = size + len(row), hi
            if size > CANDIDATES:
                held = [cut(pa.concat_tables(held).combine_chunks(), k, margin, least)]
                size = held[0].num_rows
    if size:
        found = cut(pa.concat_tables(held).combine_chunks(), k, margin, least)
        asked = pa.array(names, pa.string()).take(found["q"].combine_chunks())
        yield from pa.table({"query_id": asked, **{c: found[c] for c in ("document_id", "score", "zscore", "zone_doc_id")}}).to_batches()


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package
