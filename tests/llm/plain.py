"""Plain versions of the contract queries, straight from their definitions."""

import hashlib
import re
from collections import Counter, defaultdict

import zstandard

from caselode.llm import quality_bands

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def decontaminate(docs, items):
    """{row number: (n_words, hit word numbers, items)}"""
    windows = defaultdict(set)
    for item, text in items:
        w = ITEM_WORD.findall(low(text))
        n = min(8, len(w))
        for i in range(len(w) - n + 1 if w and item is not None else 0):
            windows[tuple(w[i : i + n])].add(str(item))
    out = []
    for _, text in docs:
        w, hit, found = ITEM_WORD.findall(low(text)), set(), set()
        for n in range(1, 9):
            for i in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= ids
        out.append((len(w), sorted(hit), sorted(found)))
    return out


def substring_dedup(docs, k=13):
    first = {}
    words = [SPACE_WORD.findall(t or "") for _, t in docs]
    for (d, _), w in zip(docs, words):
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            if d is not None:
                first[key] = min(d, first.get(key, d))
    out = []
    for (d, _), w in zip(docs, words):
        gone = {j for i in range(len(w) - k + 1) if d is not None and first.get(tuple(w[i : i + k]), d) < d for j in range(i, i + k)}
        out.append((d, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
)


def spans(text, rules):
    found = [(m.start(), k, m.end(), name) for k, (name, rx, ok) in enumerate(rules) for m in re.finditer(rx, text or "") if ok(m[0])]
    return sorted(found)


def spelled(found):
    return ",".join(f"{name}:{a}:{b}" for a, _, b, name in found)


def value_of(s):
    return re.fullmatch(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", s, re.I)[1]


SECRETS = (
    ("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda s: len(value_of(s)) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda s: len(s) >= 20),
    ("hex", r"[0-9a-f]+", lambda s: len(s) >= 24),
)


def quality(text):
    text = text or ""
    w = SPACE_WORD.findall(text)
    win = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    rep = {j for i in range(len(w) - 4) if win[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACE_WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * len(rep) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(rep), failed


def in_band(text):
    packer = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)

    def ratio(raw):
        return len(raw) / max(1, len(packer.compress(raw)) - 9)

    raw = text.encode()
    lo, hi = next((a, b) for top, a, b in quality_bands.BANDS if len(raw) < top)
    if not lo <= ratio(raw) <= hi:
        return False
    lo, hi = next((a, b) for top, a, b in quality_bands.BANDS if 4095 < top)
    chunks = [raw[i : i + 4096] for i in [*range(0, len(raw) - 4096, 4096), len(raw) - 4096]] if len(raw) > 4096 else []
    return sum(not lo <= ratio(c) <= hi for c in chunks) <= 0.5 * len(chunks)


def shingles(text, k=3):
    w = SPACE_WORD.findall(low(text))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near_groups(docs, k=3, percent=85):
    """{id: (set size, component)}"""
    sets = {d: shingles(t, k) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in ids}


def mix(docs, weights=(3, 1, 2), share=1.5, most=2):
    """[(id, size, source size, target, taken)] with the closed form of the schedule."""
    sized = [(d, s, len(SPACE_WORD.findall(t or ""))) for d, t, s in docs]
    names = sorted({s for _, s, _ in sized if s is not None}) + ([None] if any(s is None for _, s, _ in sized) else [])
    total, per = sum(n for *_, n in sized), Counter()
    for _, s, n in sized:
        per[s] += n
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, free = {}, total * share, set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= most * per[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: float(most * per[s]) for s in over}
        left -= sum(most * per[s] for s in over)
        free -= over
    out, at = [], Counter()
    for d, s, n in sorted(sized, key=lambda r: (hashlib.md5(str("" if r[0] is None else r[0]).encode()).hexdigest(), r[2])):
        take = int(target[s] + 0.5)
        full, rest = divmod(take, per[s]) if per[s] else (0, 0)
        out.append((d, n, per[s], target[s], full * n + min(n, max(0, rest - at[s])) if n else 0))
        at[s] += n
    return out


def levelled(text):
    """[(level, body)] of the lines of a message."""
    out = []
    for line in re.split("\r?\n", text):
        mark = re.match(r"[ \t]*((?:>[ \t]?)+)", line)
        out.append((mark[1].count(">"), line[mark.end() :]) if mark else (0, line))
    return out


def units(lines, level):
    flat = re.sub(r"\s+", " ", " ".join(body if at == level else "\x01" for at, body in lines).lower())
    return {u.strip(" ") for part in flat.split("\x01") for u in [part, *re.split(r"(?<=[.!?]) ", part)]} - {""}


def threads(messages, attribution):
    """{turn: (reply_to, root, depth, position, links)} of one conversation's (turn, text)."""
    told, own, quotes = {}, {}, {}
    for turn, text in messages:
        own[turn] = units(levelled(re.sub(attribution, "", text or "")), 0)
        lines = levelled(text or "")
        quotes[turn] = {level: units(lines, level) for level in {at for at, _ in lines} - {0}}
    parent, linked = {}, {}
    for turn in own:
        votes = Counter()
        for level, found in quotes[turn].items():
            for u in found:
                earlier = [t for t in own if t < turn and u in own[t]]
                if earlier:
                    votes[-level, max(earlier)] += 1
        linked[turn] = sum(votes.values())
        if votes:
            near = max(level for level, _ in votes)
            parent[turn] = max((n, t) for (level, t), n in votes.items() if level == near)[1]
    children = defaultdict(list)
    for turn in sorted(own):
        children[parent.get(turn)].append(turn)
    for root in children[None]:
        stack, place = [(root, 0)], 0
        while stack:
            turn, depth = stack.pop()
            told[turn] = (parent.get(turn), root, depth, place, linked[turn])
            place += 1
            stack += [(c, depth + 1) for c in reversed(children[turn])]
    return told


def candidates(text, generators, levels, cues, context, borders):
    """[(start, end, ord, cell, confirmed, tried)] of the wide generators: (ord, shape, pattern)."""
    base = spans(text, PII)
    tried = [(m.start(), m.end()) for name, rx, _ in PII[1:] for m in re.finditer(rx, text) if name != "card" or len(digits(m[0])) >= 14]
    out = []
    for ord_, shape, rx in generators:
        for m in re.finditer(rx, text):
            a, b = m.span()
            n, seps = len(digits(m[0])), re.sub(r"[^ ().\-\[\]]", "", m[0])
            only = {"": 0} | {c * len(seps): i for i, c in ((1, " "), (2, "-"), (3, ".")) if seps}
            style = only.get(seps, 4 if "(" in seps else 5)
            before = text[max(0, a - context) : a].lower()
            cue = max([0] + [i + 1 for i, (_, names) in enumerate(cues) if re.search(rf"\b(?:{names})", before, re.ASCII)])
            edge = before[-2:].replace("+", " ")[-1:]
            after = text[b : b + 1]

            def side(c, money):
                return 0 if not c or c in " \t\n\x0b\f\r" else 1 if c in money else 2 if c.isalnum() or c == "_" else 3

            values = (shape, sum(n >= x for x in borders), min(len(seps), 4), style, cue, side(edge, "$#€£%"), side(after, "%€$£"))
            cell = 0
            for v, k in zip(values, levels):
                cell = cell * k + v
            out.append((a, b, ord_, cell, any(x < b and a < y for x, _, y, _ in base), any(x < b and a < y for x, y in tried)))
    return out
