"""Plain versions of the operators, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def roots(nodes, edges):
    """Least node of each component."""
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def fingerprint(text: str | None) -> int:
    words = WORDS.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints, radius=2):
    """Component of each fingerprint, as its least member."""
    distinct = sorted(set(prints))
    edges = [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if (a ^ b).bit_count() <= radius]
    return roots(distinct, edges)


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Target of each source from the words of each."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [None] * (None in sizes)
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    held: set = set()
    while True:
        rest = share * sum(sizes.values()) - sum(cap * sizes[n] for n in held)
        free = [n for n in names if n not in held]
        scale = rest / sum(weight[n] for n in free) if free else 0
        above = {n for n in free if weight[n] * scale > cap * sizes[n]}
        if not above:
            return {n: cap * sizes[n] if n in held else weight[n] * scale for n in names}
        held |= above


def lines_kept(docs, threshold):
    sites = defaultdict(set)
    for _, text, source in docs:
        for line in set((text or "").split("\n")):
            sites[line].add(source)
    return sites


def likeness(a: str | None, b: str | None) -> float:
    """Jaccard likeness of the five-word shingles of two texts with a word."""
    sets = []
    for text in (a, b):
        words = WORDS.findall((text or "").translate(LOWER))
        sets.append({" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])
