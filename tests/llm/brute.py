"""Plain Python versions of what the corpus operators return."""

from __future__ import annotations

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def components(nodes, links) -> dict:
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i: i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def jaccard_components(rows, n, percent):
    sets = {d: shingles(t, n) for d, t in rows}
    ids = sorted(sets)
    links = []
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            o = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
                links.append((a, b))
    return sets, components(ids, links)


def cut(rows, window):
    """doc_id -> (words, kept words)."""
    words = {d: WORD.findall(t or "") for d, t in rows}
    first: dict = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i: i + window]), d)
    out = {}
    for d, w in words.items():
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i: i + window])] < d:
                keep[i: i + window] = [False] * window
        out[d] = (w, [x for x, k in zip(w, keep) if k])
    return out


def char_counts(texts, order):
    return Counter(t[max(0, i - order): i + 1] for t in texts for i in range(len(t)))
