"""Language ID by cross-parsing entropy over suffix automata.

Per language, the suffix automaton of a bounded training text recognises its substrings.  A text is
parsed greedily into the longest phrases that occur in that training text; the fewer phrases a text
needs, normalised by log2 of the training length (the bits that name a phrase), the closer it is to
the language.  The language with the least bits wins; ties go to the first in order.

Texts are parsed whole and in one piece.  Blocks of ``BLOCK`` letters first advance together, one
letter at a time, each as if a phrase began with it; then the phrase left open at each block's end is
followed into the next block until one of its phrases begins where one of the block's own does: from
there on both parses are the same.  Greedy parses meet after a few phrases, and where they don't the
walk goes on, so the phrases are always those of the unbroken parse.

All automata share one open-addressing table of transitions, keyed by (state, letter), so neither
the number of letters of a script nor that of languages is limited; where all states times all
letters are ``DENSE`` at most, the same steps are laid out in a plain table.  A letter that a
language's training text lacks is a phrase of its own there.

Fitting: up to ``rows`` different texts per language (the least hashes of their content among labelled
rows; copies count once), of each an excerpt of up to ``excerpt`` characters at a place drawn by the
hash, and ``chars`` letters of those together.  Every label is learned.  What is collected and broadcast
is bounded by ``chars`` letters a label; more than ``MOST_LETTERS`` together are refused with an error, so labels
must be a bounded set.  Rows whose label a model of the other half of the sample disputes are left out.

Defined cases: null texts and texts without letters are ``und`` with score 0; null labels and null
texts teach nothing; a label whose texts have no letters is not learned; without any training text
everything is ``und``; repeated rows get the same answer; extra columns are carried through.
"""

from __future__ import annotations

import math
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselode.llm import kernels as K

ROWS, CHARS, EXCERPT = 48, 32768, 4096
MOST_LETTERS = 1 << 25
BLOCK, DENSE = 512, 1 << 24
FIELDS = (("lang_pred", "string"), ("score", "double"), ("bits_per_letter", "double"))


def letters(text: str) -> str:
    """Lower case, each run of other characters one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a symbol sequence; state 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class Model:
    """The automata of all languages in one hash table: (state, letter) to the next state."""

    MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, training: dict[str, str]):
        self.names = sorted(training)
        code = {" ": 0} | {c: i + 1 for i, c in enumerate(sorted(set().union(*training.values()) - {" "}))}
        other = len(code)
        self.width = other + 1
        keys, values, roots, base = [], [], [], 0
        for name in self.names:
            states = suffix_automaton([code[c] for c in training[name]])
            for i, moves in enumerate(states):
                for c, j in moves.items():
                    keys.append((base + i) * self.width + c)
                    values.append(base + j)
            roots.append(base)
            base += len(states)
        self.roots = np.array(roots, dtype=np.int64)
        self.bits = np.array([math.log2(max(2, len(training[n]))) for n in self.names])
        self.fill(np.array(keys, dtype=np.int64), np.array(values, dtype=np.int32))
        # the first letters of phrases, without hashing
        letters = np.tile(np.arange(self.width), len(self.names))
        self.first = self.step(np.repeat(self.roots, self.width), letters)
        self.dense = None
        if base * self.width <= DENSE:
            lang = np.searchsorted(self.roots, np.arange(base), side="right") - 1
            made, each = np.empty(base * self.width, dtype=np.int32), 2048  # in stretches of states, for the sake of memory
            for a in range(0, base, each):
                b = min(base, a + each)
                begins, to = self.advance(np.repeat(lang[a:b], self.width), np.repeat(np.arange(a, b), self.width), np.tile(np.arange(self.width), b - a))
                made[a * self.width : b * self.width] = 2 * to + begins
            self.dense = made
        self.look = np.zeros(sys.maxunicode + 1, dtype=np.int32)
        for cp in range(sys.maxunicode + 1):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                self.look[cp] = code.get(low if len(low) == 1 else low[0], other)

    def fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Linear probing, all keys at once: of those that want a free slot the first gets it."""
        power = max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - power), (1 << power) - 1
        self.keys, self.values = np.full(1 << power, -1, dtype=np.int64), np.zeros(1 << power, dtype=np.int32)
        at = self.slot(keys)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == -1]
            _, one = np.unique(at[free], return_index=True)
            placed = free[one]
            self.keys[at[placed]], self.values[at[placed]] = keys[placed], values[placed]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * self.MULTIPLIER) >> self.shift).astype(np.int64)

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The next states, -1 where there is none."""
        key = state * self.width + letter
        at = self.slot(key)
        held = self.keys[at]
        out = np.where(held == key, self.values[at], -1)
        left = np.flatnonzero((held != key) & (held != -1))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            held = self.keys[at[left]]
            hit = held == key[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (held != -1)]
        return out.astype(np.int64)

    def advance(self, lang: np.ndarray, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether a phrase begins with this letter, the state after it)."""
        if self.dense is not None:
            v = self.dense[state * self.width + letter]
            return (v & 1).astype(bool), v >> 1
        root = self.roots[lang]
        begins = state == root
        to = np.empty(len(state), dtype=np.int64)
        inner = np.flatnonzero(~begins)
        to[inner] = self.step(state[inner], letter[inner])
        begins[inner] = to[inner] < 0
        fresh = np.flatnonzero(begins)
        to[fresh] = self.first[lang[fresh] * self.width + letter[fresh]]
        return begins, np.where(to < 0, root, to)

    def phrases(self, sym: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The number of phrases of the greedy parse, for each language and text; at: the texts' borders."""
        langs, size = len(self.names), np.diff(at)
        per = -(-size // BLOCK)
        owner = np.repeat(np.arange(len(size)), per)
        index = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        start = at[owner] + index * BLOCK
        length = np.minimum(BLOCK, at[owner + 1] - start)
        if not len(start) or not langs:
            return np.zeros((langs, len(size)), dtype=np.int64)
        order = np.argsort(-length, kind="stable")  # the longest blocks first: at step t the first ones are live
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        owner, follows = owner[order], (index + 1 < per[owner])[order]
        after = rank[np.minimum(np.arange(len(order)) + 1, len(order) - 1)][order]  # the text's next block
        start, length = start[order], length[order]
        live = np.searchsorted(-length, -np.arange(BLOCK), side="left")  # blocks longer than t
        steps = int(length[0])
        final = np.repeat(self.roots[:, None], len(start), axis=1)
        begins = np.zeros((steps, langs, len(start)), dtype=bool)
        each = np.arange(langs)
        for t in range(steps):
            n = live[t]
            new, to = self.advance(np.repeat(each, n), final[:, :n].ravel(), np.tile(sym[start[:n] + t], langs))
            begins[t, :, :n] = new.reshape(langs, n)
            final[:, :n] = to.reshape(langs, n)
        count = begins.sum(axis=0, dtype=np.int64)

        # phrases that go on across a block's border
        lang, block = np.nonzero((final != self.roots[:, None]) & follows[None, :])
        while len(block):
            state, block, changed, t = final[lang, block], after[block], [], 0
            while len(block):
                new, to = self.advance(lang, state, sym[start[block] + t])
                had = begins[t, lang, block]
                go = ~(new & had)
                lang, block, state, new, had = lang[go], block[go], to[go], new[go], had[go]
                begins[t, lang, block] = new
                count[lang, block] += new.astype(np.int64) - had
                t += 1
                over = length[block] == t
                if over.any():  # not met in this block: the next one is entered otherwise than it was
                    moved = over & (final[lang, block] != state)
                    final[lang[moved], block[moved]] = state[moved]
                    moved &= follows[block]
                    changed.append((lang[moved], block[moved]))
                    lang, block, state = lang[~over], block[~over], state[~over]
            if changed:
                lang, block = (np.concatenate(x) for x in zip(*changed))
        return np.stack([np.bincount(owner, weights=count[k], minlength=len(size)) for k in range(langs)])

    def parse(self, s: K.Slice) -> tuple[np.ndarray, np.ndarray]:
        """(bits per language and text, letters and gaps per text)."""
        points = np.frombuffer(s.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
        lead = np.concatenate([[0], np.cumsum((s.data & 0xC0) != 0x80)])
        border = lead[s.offs]
        sym = self.look[points]
        fresh = np.ones(len(sym), dtype=bool)
        fresh[1:] = (sym[1:] != 0) | (sym[:-1] != 0)
        first = border[:-1][border[:-1] < len(sym)]
        fresh[first] = sym[first] != 0  # no space at a text's start
        total = np.concatenate([[0], np.cumsum(fresh)])
        at = total[border]
        sym = sym[fresh]
        size = np.diff(at)
        letters = np.concatenate([[0], np.cumsum(sym != 0)])
        return self.phrases(sym, at) * self.bits[:, None], np.where(np.diff(letters[at]) > 0, size, 0)

    def predict(self, s: K.Slice) -> tuple[list[str], np.ndarray, np.ndarray]:
        bits, size = self.parse(s)
        if not len(self.names):
            return ["und"] * len(s), np.zeros(len(s)), np.zeros(len(s))
        best = np.argmin(bits, axis=0)
        low = bits[best, np.arange(len(s))]
        rest = bits.copy()
        rest[best, np.arange(len(s))] = np.inf
        second = rest.min(axis=0)
        score = np.where(np.isinf(second), 1.0, second / np.maximum(low + np.where(np.isinf(second), 0, second), 1e-9))
        known = size > 0
        return [self.names[b] if k else "und" for b, k in zip(best, known)], np.where(known, score, 0.0), np.where(known, low / np.maximum(size, 1), 0.0)


def joined(texts: list[str], chars: int) -> str:
    out, n = [], 0
    for t in texts:
        if n >= chars:
            break
        out.append(t)
        n += len(t) + 1
    return " ".join(out)[:chars]


def as_slice(texts: list[str]) -> K.Slice:
    raw = [t.encode() for t in texts]
    return K.Slice(0, len(raw), np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))


def clean_training(sample: dict[str, list[str]], chars: int) -> dict[str, str]:
    """The training text per language, without the rows that a model of the other half disputes."""
    kept = {name: [] for name in sample}
    for half in (0, 1):
        model = Model({n: joined(t[1 - half :: 2], chars) for n, t in sample.items() if t[1 - half :: 2]})
        for name, texts in sample.items():
            own = texts[half::2]
            if own:
                said, _, _ = model.predict(as_slice(own))
                kept[name] += [t for t, x in zip(own, said) if x == name or name not in model.names]
    return {n: joined(kept[n] or t, chars) for n, t in sample.items()}


def fit(docs: DataFrame, text: str, lang: str, may_learn: Column, *, rows: int = ROWS, chars: int = CHARS, excerpt: int = EXCERPT) -> dict[str, str]:
    """Training text per language.  What reaches the driver: rows excerpts of each label at most."""
    known = docs.where(may_learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).withColumn("draw", F.xxhash64("text"))
    counts = known.select("lang", "draw").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()
    if not counts:
        return {}
    if len(counts) * chars > MOST_LETTERS:
        raise ValueError(f"{len(counts)} labels of {chars} letters each are more than MOST_LETTERS: take fewer chars")
    # texts below this hash are about three times what is wanted; the window then takes the least ones
    share = {r["lang"]: min(1.0, 3.0 * rows / r["n"]) for r in counts}
    place = F.row_number().over(W.partitionBy("lang").orderBy("draw", "excerpt"))
    begin = F.pmod("draw", F.greatest(F.lit(1), F.length("text") - excerpt + 1))
    while True:
        below = F.create_map(*[x for name, part in share.items() for x in (F.lit(name), F.lit(part))])
        drawn = known.where((F.pmod("draw", F.lit(1 << 40)) / F.lit(float(1 << 40))) < F.try_element_at(below, F.col("lang")))
        once = drawn.groupBy("lang", "draw").agg(F.min(F.substring("text", (begin + 1).cast("int"), F.lit(excerpt))).alias("excerpt"))
        found = once.withColumn("place", place).where(F.col("place") <= rows).collect()
        have = Counter(r["lang"] for r in found)
        short = [r["lang"] for r in counts if have[r["lang"]] < min(rows, r["n"]) and share[r["lang"]] < 1]
        if not short:
            break
        share |= {name: min(1.0, 4 * share[name]) for name in short}
    sample: dict[str, list[str]] = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["place"])):
        if t := letters(r["excerpt"]):
            sample.setdefault(r["lang"], []).append(t)
    return clean_training(sample, chars) if sample else {}


_models: dict = {}


def model_of(shared) -> Model:
    """Built once a worker."""
    training = shared.value
    key = hash(tuple(sorted(training.items())))
    if key not in _models:
        _models.clear()
        _models[key] = Model(training)
    return _models[key]


def predict_batches(batches, shared, text_at):
    model = model_of(shared)
    for batch in batches:
        names, score, bits = [], [], []
        for s in K.slices(batch.column(text_at)):
            a, b, c = model.predict(s)
            names += a
            score.append(b)
            bits.append(c)
        if batch.num_rows:
            made = [pa.array(names, pa.string()), pa.array(np.concatenate(score)), pa.array(np.concatenate(bits))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[f"c{i}" for i in range(batch.num_columns + len(made))])


def predict(docs: DataFrame, training: dict[str, str], text: str = "text", *, prefix: str = "") -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1: the runner-up's share of both's bits) and bits_per_letter; narrow."""
    own = [f.name for f in docs.schema.fields]
    shared = docs.sparkSession.sparkContext.broadcast(training)
    text_at = own.index(text)
    made = T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in FIELDS))
    schema = T.StructType([T.StructField(f"c{i}", f.dataType, True) for i, f in enumerate([*docs.schema.fields, *made.fields])])
    out = docs.toDF(*[f"c{i}" for i in range(len(own))]).mapInArrow(lambda it: predict_batches(it, shared, text_at), schema)
    return out.toDF(*own, *[prefix + n for n, _ in FIELDS])


K.ship(sys.modules[__name__])
