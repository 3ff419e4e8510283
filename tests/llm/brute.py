"""Plain, slow versions of the operators' contracts, over lists of rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WHITE = re.compile(r"[\x20\x09-\x0D]")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def exact(docs):
    """(id, text) -> {id: (keep, size, kept, sha)}"""
    groups = defaultdict(list)
    for i, t in docs:
        groups[sha(WHITE.sub("", t or ""))].append((-len(t or ""), i))
    out = {}
    for h, g in groups.items():
        keep = min(g)[1]
        for _, i in g:
            out[i] = (keep, len(g), i == keep, h)
    return out


def repeats(docs, n=200):
    """(id, text) -> {id: (bytes, removed, spans, sha)}"""
    data = {i: (t or "").encode() for i, t in docs}
    seen = Counter(d[p:p + n] for d in data.values() for p in range(len(d) - n + 1))
    out = {}
    for i, d in data.items():
        gone = bytearray(len(d))
        for p in range(len(d) - n + 1):
            if seen[d[p:p + n]] > 1:
                gone[p:p + n] = b"\1" * n
        kept = bytes(c for c, g in zip(d, gone) if not g)
        out[i] = (len(d), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def shingles(t, k):
    w = WORDS.findall((t or "").translate(AZ))
    if not w:
        return set()
    k = min(k, len(w))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def near(docs, k=2, percent=80):
    """(id, text) -> {id: (size of set, component, kept)}, all pairs compared."""
    sets = {i: shingles(t, k) for i, t in docs}
    head = {i: i for i in sets}

    def find(x):
        while head[x] != x:
            head[x] = head[head[x]]
            x = head[x]
        return x

    ids = sorted(i for i, s in sets.items() if s)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            n, m = len(sets[a]), len(sets[b])
            if 100 * min(n, m) < percent * max(n, m):
                continue
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (n + m - common):
                p, q = sorted((find(a), find(b)))
                head[q] = p
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def ids_crc(ids) -> int:
    return zlib.crc32(b"".join(int(x).to_bytes(4, "little") for x in ids))


def targets(sizes: dict, weights=(5, 2, 1), repeat=3):
    """source -> words, by resharing until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in full]
        rest = total - sum(full.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free} if free else {}
        over = [s for s in free if share[s] > repeat * sizes[s] + 1e-9]
        if not over:
            return {**full, **share}
        full.update({s: repeat * sizes[s] for s in over})


def contaminated(docs, items, n=13, share=20):
    """{id: (words, hit, items, sha, contaminated)}"""
    wins = defaultdict(set)
    for k, t in items:
        w = TERMS.findall((t or "").translate(AZ))
        m = min(n, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            wins[tuple(w[i:i + m])].add(str(k))
    sizes = sorted({len(w) for w in wins})
    out = {}
    for i, t in docs:
        w = TERMS.findall((t or "").translate(AZ))
        hit, found = set(), set()
        for m in sizes:
            for p in range(len(w) - m + 1):
                if (own := wins.get(tuple(w[p:p + m]))) is not None:
                    hit.update(range(p, p + m))
                    found |= own
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and share * len(hit) >= len(w))
    return out


def base_spans(text):
    """(kind, start, end) by kind as listed, then start."""
    def luhn(d):
        s = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d)))
        return s % 10 == 0

    def digits(s):
        return re.sub(r"[^0-9]", "", s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, text or "") if ok(m[0])]
