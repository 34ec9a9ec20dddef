"""Quality rules: zstandard compression bands over whole documents and fixed chunks.

A text that compresses far better than prose repeats itself; one that hardly compresses is noise
(base64, hex, random symbols).  Both bounds depend on the text's length, as a short text has little
context to be compressed by.  The ratio is raw bytes over zstandard bytes, frame header left out.

A document is kept when its own ratio lies in the band of its length, and at most
``max_bad_chunks`` of its fixed chunks of ``chunk_bytes`` lie outside the chunk band (so that a
long clean prefix doesn't hide a long noisy tail).  Texts of more than one chunk are cut; the last
chunk is the text's last ``chunk_bytes``, overlapping the one before, so every byte is judged.
The base counts compare words and lines by their bytes, not by hashes.

Defined cases: null and empty texts have no words, fail the base rules and are dropped; a repeated
row is judged again and gets the same result; extra columns, of any name, pass through ``judge``.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselode.llm import kernels as K

#: Upper border of length in bytes, least and greatest ratio that prose shows there.
BANDS = (
    (128, 0.70, 1.6),
    (256, 0.85, 1.85),
    (512, 1.10, 1.95),
    (1024, 1.25, 2.15),
    (2048, 1.40, 2.3),
    (4096, 1.55, 2.4),
    (16384, 1.60, 2.55),
    (65536, 1.65, 2.7),
    (1 << 62, 1.65, 3.0),
)
CHUNK_BYTES = 4096
MAX_BAD_CHUNKS = 0.5
LEVEL = 3
FRAME_BYTES = 9
SYMBOLS = b"#*$%&|<>"

FIELDS = (
    ("n_words", pa.int64()),
    ("word_chars", pa.int64()),
    ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()),
    ("base_failed", pa.bool_()),
    ("ratio", pa.float64()),
    ("n_chunks", pa.int64()),
    ("n_bad_chunks", pa.int64()),
    ("kept", pa.bool_()),
)


def band(length: int, bands=BANDS) -> tuple[float, float]:
    return next((lo, hi) for top, lo, hi in bands if length < top)


def measure(s: K.Slice, word_byte: np.ndarray, symbol: np.ndarray) -> dict[str, np.ndarray]:
    """The base columns of a slice's texts."""
    start, end, first = K.words(s, word_byte)
    data = s.data
    lead = (data & 0xC0) != 0x80
    doc = K.owners(first)
    out = {"n_words": np.diff(first), "word_chars": K.per_text(lead & word_byte[data], s.offs), "n_symbols": K.per_text(symbol[data], s.offs)}

    at = K.within(len(start), first, 5)
    hit = np.zeros(len(start), bool)
    if len(at):
        codes, _ = K.word_codes(data, start, end)
        hit = K.covered(len(start), at[K.repeated(K.numbered(K.rows_of(codes, 5)[at], doc[at]))], 5)
    out["n_repeat_words"] = K.per_text(hit, first)

    breaks = np.flatnonzero(data == 10)
    line_start = np.union1d(breaks + 1, s.offs[:-1])
    line_start = line_start[line_start < len(data)]
    line_end = np.append(line_start[1:], len(data))
    line_end = line_end - ((line_end > line_start) & (data[np.maximum(line_end - 1, 0)] == 10) if len(data) else 0)
    with_word = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end = line_start[with_word], line_end[with_word]
    line_doc = np.searchsorted(s.offs, line_start, side="right") - 1
    same, _ = K.word_codes(data, line_start, line_end)
    _, kept = np.unique(same * len(s) + line_doc, return_index=True)
    lines = np.bincount(line_doc, minlength=len(s))
    out["n_dup_lines"] = lines - np.bincount(line_doc[kept], minlength=len(s))
    return out


def judge_batches(batches, bands, chunk_bytes, max_bad_chunks, level, text_at):
    import zstandard

    packer = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)
    word_byte, symbol = ~K.byte_table(K.SPACES), K.byte_table(SYMBOLS)

    def ratio(raw: bytes) -> float:
        return len(raw) / max(1, len(packer.compress(raw)) - FRAME_BYTES) if raw else 0.0

    for batch in batches:
        cols: dict[str, list] = {name: [] for name, _ in FIELDS}
        for s in K.slices(batch.column(text_at)):
            got = measure(s, word_byte, symbol)
            failed = (got["n_words"] < 10) | (100 * got["n_repeat_words"] > 20 * got["n_words"])
            whole, n_chunks, n_bad, kept = np.zeros(len(s)), np.zeros(len(s), np.int64), np.zeros(len(s), np.int64), np.zeros(len(s), bool)
            for i in range(len(s)):
                raw = s.text(i)
                whole[i] = ratio(raw)
                lo, hi = band(len(raw), bands)
                fine = lo <= whole[i] <= hi
                if len(raw) > chunk_bytes:
                    lo, hi = band(chunk_bytes - 1, bands)
                    starts = [*range(0, len(raw) - chunk_bytes, chunk_bytes), len(raw) - chunk_bytes]
                    chunks = [raw[a : a + chunk_bytes] for a in starts]
                    n_chunks[i] = len(chunks)
                    n_bad[i] = sum(not lo <= ratio(c) <= hi for c in chunks)
                    fine &= n_bad[i] <= max_bad_chunks * n_chunks[i]
                kept[i] = fine and not failed[i]
            got |= {"base_failed": failed, "ratio": whole, "n_chunks": n_chunks, "n_bad_chunks": n_bad, "kept": kept}
            for name, _ in FIELDS:
                cols[name].append(got[name])
        if batch.num_rows:
            made = [pa.array(np.concatenate(cols[name]), kind) for name, kind in FIELDS]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[f"c{i}" for i in range(batch.num_columns + len(made))])


def judge(docs: DataFrame, text: str = "text", *, bands=BANDS, chunk_bytes: int = CHUNK_BYTES, max_bad_chunks: float = MAX_BAD_CHUNKS, level: int = LEVEL, prefix: str = "") -> DataFrame:
    """``docs`` with the columns of ``FIELDS`` (named with ``prefix``) behind its own; narrow, no shuffle."""
    fields = [*docs.schema.fields]
    text_at = [f.name for f in fields].index(text)
    kinds = {"int64": T.LongType(), "bool": T.BooleanType(), "double": T.DoubleType()}
    temp = T.StructType([T.StructField(f"c{i}", f.dataType, True) for i, f in enumerate(fields)] + [T.StructField(f"c{len(fields) + i}", kinds[str(kind)], True) for i, (_, kind) in enumerate(FIELDS)])

    def run(batches):
        return judge_batches(batches, bands, chunk_bytes, max_bad_chunks, level, text_at)

    return docs.toDF(*[f"c{i}" for i in range(len(fields))]).mapInArrow(run, temp).toDF(*[f.name for f in fields], *[prefix + name for name, _ in FIELDS])


def keep(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that pass, with its own columns only."""
    mark = "__quality_"
    judged = judge(docs, text, prefix=mark, **options)
    return judged.where(F.col(mark + "kept")).drop(*[mark + name for name, _ in FIELDS])


K.ship(sys.modules[__name__])
