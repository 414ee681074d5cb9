"""Plain Python versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def raw_of(text) -> bytes:
    return (text or "").encode()


def op1(rows, length=200):
    texts = [raw_of(t) for _, t in rows]
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p:p + length]] > 1:
                gone[p:p + length] = b"\1" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), spans, sha(kept)))
    return out


def op4(rows, width=13):
    words = [WORD.findall(raw_of(t)) for _, t in rows]
    order = [(-1, 0) if i is None else (0, i) for i, _ in rows]
    low = {}
    for o, w in zip(order, words):
        for p in range(len(w) - width + 1):
            k = tuple(w[p:p + width])
            low[k] = min(low.get(k, o), o)
    out = []
    for (i, _), o, w in zip(rows, order, words):
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if low[tuple(w[p:p + width])] < o:
                gone[p:p + width] = [True] * width
        out.append((i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def op5(vectors, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % 50 == 0:
            got = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(got, 1)]
    return out


def water(sizes, epochs=3):
    """{source: target} by repeated clamping."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, free, out = sum(sizes.values()), set(names), {}
    while free:
        left = total - sum(out.values())
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > epochs * sizes[s]]
        if not over:
            for s in free:
                out[s] = left * weight[s] / sum(weight[x] for x in free)
            break
        for s in over:
            out[s] = epochs * sizes[s]
            free.discard(s)
    return out


def op9(rows, items, width=10):
    words = lambda t: ALNUM.findall(raw_of(t).lower())
    known = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(len(w), width)
        for p in range(len(w) - n + 1 if n else 0):
            known[tuple(w[p:p + n])].add(str(i))
    sizes = {len(k) for k in known}
    out = []
    for i, t in rows:
        w, hit, got = words(t), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                own = known.get(tuple(w[p:p + n]))
                if own:
                    hit |= set(range(p, p + n))
                    got |= own
        out.append((i, len(w), len(hit), len(got), sha(",".join(sorted(got)).encode()), bool(hit)))
    return out


def fingerprint(text, width=3):
    w = WORD.findall(raw_of(text).lower())
    if not w:
        return 0
    grams = [b" ".join(w[p:p + width]) for p in range(max(1, len(w) - width + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, prints, bits=3):
    root = list(range(len(prints)))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                root[find(a)] = find(b)
    low = {}
    for k, i in enumerate(ids):
        r = find(k)
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return [low.get(find(k)) for k in range(len(prints))]


def op10(rows):
    prints = [fingerprint(t) for _, t in rows]
    return [(i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, components([i for i, _ in rows], prints))]


def op8_base(rows, folds=7, held=2):
    words = [WORD.findall(raw_of(t).lower()) for _, t in rows]
    rest = [None if i is None else zlib.crc32(str(i).encode()) % folds for i, _ in rows]
    count = Counter()
    for r, w in zip(rest, words):
        if r is not None and r != held:
            count.update(w)
            count["end"] += 1
    n, v = sum(count.values()), len(count)
    out = []
    for (i, _), r, w in zip(rows, rest, words):
        t = [*w, "end"]
        out.append((i, r == held, len(t), sum(count[x] > 0 for x in t), n,
                    sum(math.log10((count[x] + 1) / (n + v + 1)) for x in t)))
    return out
