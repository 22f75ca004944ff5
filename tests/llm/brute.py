"""Plain versions of the training-data operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall(text or "")


def substrings(docs, size):
    """{id: (words, removed, digest)} for unique ids."""
    split = {i: words(t) for i, t in docs}
    first = {}
    for i in sorted(split):
        for s in range(len(split[i]) - size + 1):
            first.setdefault(tuple(split[i][s : s + size]), (i, s))
    out = {}
    for i, w in split.items():
        gone = set()
        for s in range(len(w) - size + 1):
            if first[tuple(w[s : s + size])] < (i, s):
                gone.update(range(s, s + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def shingles(text, size=5):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])


class Union:
    def __init__(self, names):
        self.up = {n: n for n in names}

    def root(self, n):
        while self.up[n] != n:
            n = self.up[n]
        return n

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def near(docs, percent=75):
    """{id: (set size, component)}."""
    found = {i: shingles(t) for i, t in docs}
    union, ids = Union(found), sorted(found)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = found[a], found[b]
            common = len(x & y)
            if x and y and 100 * common >= percent * (len(x) + len(y) - common):
                union.join(a, b)
    return {i: (len(found[i]), union.root(i)) for i in ids}


def line_chunks(text, reach=1):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:15], 16) % 1_000_003 for x in lines]
    gap = [(a * 31 + b) % 1_000_003 for a, b in zip(h, h[1:], strict=False)]
    chunks, start = [], 0
    for k in range(len(lines)):
        inner = reach <= k <= len(gap) - 1 - reach
        if inner and all(gap[k] < gap[k - d] and gap[k] <= gap[k + d] for d in range(1, reach + 1)) or k == len(lines) - 1:
            chunks.append((start, lines[start : k + 1]))
            start = k + 1
    return chunks


def line_dedup(docs):
    """[(id, kept text, lines, removed)] for rows (id, text)."""
    first = {}
    for i, t in sorted({(i, t) for i, t in docs if t is not None}):
        for at, chunk in line_chunks(t):
            if len(chunk) > 1:
                first.setdefault("\n".join(chunk), (i, t, at))
    out = []
    for i, t in docs:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        kept, removed = [], 0
        for at, chunk in line_chunks(t):
            if len(chunk) > 1 and first["\n".join(chunk)] != (i, t, at):
                removed += len(chunk)
            else:
                kept += chunk
        out.append((i, "\n".join(kept), t.count("\n") + 1, removed))
    return out


def poisson(rate, u):
    k, p = 0, math.exp(-rate)
    total = p
    while u >= total and k < rate + 12 * math.sqrt(rate) + 40:
        k += 1
        p *= rate / k
        total += p
    return k


def copies(rate, name, seed="mix"):
    """Drawn in equal parts with a mean of 16 at most."""
    parts = max(1, math.ceil(rate / 16))
    uniform = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2**52
    return sum(poisson(rate / parts, uniform(f"{seed}:{name}" + (f":{k}" if k else ""))) for k in range(parts))


def mix(docs, temperature=2.0, seed="mix"):
    """Counter of ids for rows (id, source, text)."""
    mass = defaultdict(int)
    for _, s, t in docs:
        mass[s] += len(t or "")
    share = {s: math.floor(m ** (1 / temperature) * 1_000_000) for s, m in mass.items()}
    out = Counter()
    for i, s, _ in docs:
        rate = share[s] / sum(share.values()) * sum(mass.values()) / mass[s] if mass[s] else 0
        n = copies(rate, "" if i is None else i, seed) if rate else 0
        if n:
            out[i] += n
    return out


def pieces(docs, tokenizer, capacity=1024, end=2):
    """Counter of (id, piece, start, length, crc) for rows (id, text)."""
    out = Counter()
    for i, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, end]
        n = len(ids)
        first = n % capacity or min(n, capacity)
        for k, (a, b) in enumerate(zip([0, *range(first, n, capacity)], [*range(first, n, capacity), n], strict=True)):
            out[(i, k, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b])))] += 1
    return out


def valid_packing(rows, capacity=1024):
    """Every sequence's pieces lie end to end from 0 and fit; rows of (length, sequence, offset)."""
    sequences = defaultdict(list)
    for length, sequence, offset in rows:
        sequences[sequence].append((offset, length))
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            if offset != at:
                return False
            at += length
        if at > capacity:
            return False
    return True
