"""Plain Python versions of the contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall(text or "")


def near(docs, size=3, percent=85):
    """docs: [(doc_id, text)] -> Counter of (doc_id, n, component, kept)."""
    sets = []
    for _, t in docs:
        w = words((t or "").translate(ASCII_LOWER))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    shared = Counter()
    for s in where.values():
        if len(s) > 1:
            shared.update(combinations(s, 2))
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, j), n in shared.items():
        if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return Counter((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(docs))


def repeats(docs, size=35):
    """docs: [(doc_id, text)] -> Counter of (doc_id, n_words, n_removed, kept_sha256)."""
    texts = [(d, words(t)) for d, t in docs]
    seen = Counter(tuple(w[i : i + size]) for _, w in texts for i in range(len(w) - size + 1))
    out = Counter()
    for d, w in texts:
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out
