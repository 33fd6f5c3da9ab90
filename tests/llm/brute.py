"""Brute-force references."""

from __future__ import annotations

import re


def word_sets(texts: dict, k: int) -> dict:
    out = {}
    for i, t in texts.items():
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        out[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    return out


def linked(sets: dict, percent: int = 80) -> dict:
    """id -> least id reachable over links."""
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)):
                common = len(a & b)
                if 100 * common >= percent * (len(a) + len(b) - common):
                    x, y = sorted((find(i), find(j)))
                    parent[y] = x
    return {i: find(i) for i in ids}
