"""Plain versions of what the operators compute, for small tables."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text, k):
    w = words(text)
    return set(zip(*[w[j:] for j in range(k)], strict=False)) if len(w) >= k else {tuple(w)} if w else set()


def near_duplicates(rows, k, percent=80):
    """{id: (set size, component)} of rows with distinct ids."""
    sets, parent, inverted = {i: shingles(t, k) for i, t in rows}, {i: i for i, _ in rows}, defaultdict(list)

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in sets:
        counts = Counter()
        for g in sets[i]:
            counts.update(inverted[g])
            inverted[g].append(i)
        for j, c in counts.items():
            if 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())
