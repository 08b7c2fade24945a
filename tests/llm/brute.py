"""Plain Python versions of the contracts."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def similar(docs, percent, width):
    """{doc_id: (set size, smallest id of its group)} from (doc_id, text) rows of different ids."""
    sets = {i: shingle_set(t, width) for i, t in docs}
    groups, held = Union(sets), defaultdict(list)
    for i in sorted(sets):
        common = Counter(j for s in sets[i] for j in held[s])
        for j, n in common.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                groups.join(i, j)
        for s in sets[i]:
            held[s].append(i)
    return {i: (len(s), groups.root(i)) for i, s in sets.items()}


def without_repeats(docs, length):
    """[(doc_id, n_bytes, n_removed, n_spans, kept)] from (doc_id, text) rows."""
    first, out = {}, []
    texts = [(i, (t or "").encode()) for i, t in docs]
    for i, t in texts:
        for at in range(len(t) - length + 1):
            g = t[at:at + length]
            first[g] = min(first.get(g, i), i)
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for at in range(len(t) - length + 1):
            if first[t[at:at + length]] < i:
                gone[at:at + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((i, len(t), int(gone.sum()), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def near_vectors(rows, threshold):
    """{position: (links, component id)} of (vec_id, vector) rows of different ids."""
    good = {n: v for n, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    scaled = {n: np.array(v, float) / np.abs(v).max() for n, v in good.items()}  # squares of 1e300 overflow
    units = {n: v / np.linalg.norm(v) for n, v in scaled.items()}
    groups, links = Union(range(len(rows))), Counter()
    for a in units:
        for b in units:
            if a < b and len(units[a]) == len(units[b]) and units[a] @ units[b] >= threshold:
                links[a] += 1
                links[b] += 1
                groups.join(a, b)
    least = {}
    for n, (i, _) in enumerate(rows):
        root = groups.root(n)
        least[root] = min(least.get(root, i), i)
    return {n: (links[n], least[groups.root(n)]) for n in range(len(rows))}
