"""Vectorised text kernels over Arrow string batches.

Texts stay in Arrow's UTF-8 buffer; words, windows and lines are index arrays into it.  A batch is
cut into slices of about ``SLICE_BYTES`` (one document at least, however long), so the temporaries
of a task are bounded by the longest single text, never by a batch, partition or group.

Words are compared by their bytes: within a batch of words Arrow's dictionary gives each different
word a number (``word_codes``), and ``word_ids`` extends that to several slices.  Where words have to
mean the same across tasks they are xxh3 hashes of the bytes (``word_hashes``), and a window of k
words combines those by a tree of bijective, non-linear steps, so no structure of the text makes
different windows meet more often than 64-bit chance.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

SLICE_BYTES = 1 << 20
STEP = np.uint64(0x9E3779B97F4A7C15)

#: The byte classes of the contracts.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
NOT_ITEM_WORD = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

def ship(module) -> None:
    """Send this module's functions by value, so executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(module)


def byte_table(true_bytes: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(true_bytes)] = True
    return table


def ascii_lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two; bijective in either, and not symmetric."""
    return mix(a * STEP + b)


def in_a_row(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k neighbouring elements: doubled up to the powers of two that k is made of."""
    n, out, at, power = len(h) - k + 1, None, 0, 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    level, parts = h, {}
    while power <= k:
        parts[power] = level
        if 2 * power <= k:
            level = combined(level[: len(level) - power], level[power:])
        power *= 2
    for power in sorted(parts, reverse=True):
        if k - at >= power:
            piece = parts[power][at : at + n]
            out = piece if out is None else combined(out, piece)
            at += power
    return out


class Slice:
    """Some consecutive rows of a batch: ``data`` is their UTF-8, ``offs`` their borders in it."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, offs: np.ndarray):
        self.lo, self.hi, self.data, self.offs = lo, hi, data, offs

    def text(self, i: int) -> bytes:
        return self.data[self.offs[i] : self.offs[i + 1]].tobytes()

    def __len__(self) -> int:
        return self.hi - self.lo


def slices(column: pa.Array, target: int = SLICE_BYTES):
    """Cut a string column into slices; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if n == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, dat = column.buffers()
    offs = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(dat, dtype=np.uint8) if dat is not None and dat.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + target, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield Slice(lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


def words(s: Slice, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte borders of each word and each text's first word index (and the end)."""
    m = word_byte[s.data]
    n = len(m)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(s.offs), np.int64)
    prev = np.empty(n, dtype=bool)
    prev[0] = False
    prev[1:] = m[:-1]
    nxt = np.empty(n, dtype=bool)
    nxt[-1] = False
    nxt[:-1] = m[1:]
    border = s.offs[(s.offs > 0) & (s.offs < n)]
    prev[border] = False
    nxt[border - 1] = False
    start = np.flatnonzero(m & ~prev)
    end = np.flatnonzero(m & ~nxt) + 1
    return start, end, np.searchsorted(start, s.offs)


def packed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The bytes of sorted ranges that don't overlap, as a binary array."""
    edge = np.zeros(len(data) + 1, dtype=np.int8)
    edge[start] = 1
    stop = np.zeros(len(data) + 1, dtype=np.int8)
    stop[end] = 1
    inside = np.cumsum(edge - stop, dtype=np.int8)[: len(data)] > 0
    offs = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(end - start, out=offs[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(data[inside]))])


def word_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(a number for each word, the different words): equal numbers are equal bytes."""
    coded = packed(data, start, end).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def word_ids(data: np.ndarray, start: np.ndarray, end: np.ndarray, known: dict[bytes, int]) -> np.ndarray:
    """Numbers of the words that hold across slices which share ``known``."""
    codes, different = word_codes(data, start, end)
    return np.array([known.setdefault(w, len(known)) for w in different.to_pylist()], dtype=np.int64)[codes] if len(codes) else codes


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """xxh3 of each word's bytes; each different word of the slice is hashed once."""
    import xxhash

    codes, different = word_codes(data, start, end)
    return np.array([xxhash.xxh3_64_intdigest(w) for w in different.to_pylist()], dtype=np.uint64)[codes] if len(codes) else codes.view(np.uint64)


def numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair (a, b) of small numbers; equal numbers are equal pairs."""
    import pandas as pd

    if not len(a):
        return a
    width = int(b.max()) + 1
    assert (int(a.max()) + 1) * width < 1 << 63
    return pd.factorize(a * width + b)[0].astype(np.int64)


def rows_of(codes: np.ndarray, k: int) -> np.ndarray:
    """Numbers of all k neighbouring elements, exact: as ``in_a_row``, by numbered pairs instead of hashes."""
    n, out, at, power = len(codes) - k + 1, None, 0, 1
    if n <= 0:
        return np.zeros(0, np.int64)
    level, parts = codes, {}
    while power <= k:
        parts[power] = level
        if 2 * power <= k:
            level = numbered(level[: len(level) - power], level[power:])
        power *= 2
    for power in sorted(parts, reverse=True):
        if k - at >= power:
            piece = parts[power][at : at + n]
            out = piece if out is None else numbered(out, piece)
            at += power
    return out


def owners(first: np.ndarray) -> np.ndarray:
    """The text of each word (or line, window), from the texts' first indices."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def within(n: int, first: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k-word windows that lie within one text, of n words."""
    if n < k:
        return np.zeros(0, np.int64)
    ok = np.ones(n - k + 1, dtype=bool)
    for j in range(1, k):  # a window that starts j words before a border crosses it
        cut = first[1:-1] - j
        cut = cut[(cut >= 0) & (cut < len(ok))]
        ok[cut] = False
    return np.flatnonzero(ok)


def windows(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of all k-word windows that lie within one text; h: hashes of the words."""
    at = within(len(h), first, k)
    return at, in_a_row(h, k)[at] if len(at) else np.zeros(0, np.uint64)


def repeated(keys: np.ndarray) -> np.ndarray:
    """True for each key that occurs twice or more."""
    out = np.zeros(len(keys), dtype=bool)
    if len(keys) > 1:
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        out[order[1:]] = same
        out[order[:-1]] |= same
    return out


def covered(n: int, at: np.ndarray, k: int) -> np.ndarray:
    """True for each of n words that lies in a k-word window starting at one of ``at``."""
    edge = np.bincount(at, minlength=n + 1).astype(np.int64)
    edge = edge[: n + 1]
    edge -= np.bincount(np.minimum(at + k, n), minlength=n + 1)[: n + 1]
    return np.cumsum(edge)[:n] > 0


def per_text(flags: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Number of true flags between the texts' borders."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[borders])


def runs(batches, n_keys: int):
    """The groups of rows that agree in the first n_keys columns, which the rows are sorted by.

    A group may span batches; one group at a time is held.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys)]
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for k in keys:
            change |= k[1:] != k[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(k[a] for k in keys)
            if held and key != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


ship(sys.modules[__name__])
