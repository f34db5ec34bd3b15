"""Plain Python versions of the operators, to hold their results against."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, words):
    found = WORD.findall(text or "")
    if not found:
        return frozenset()
    if len(found) < words:
        return frozenset([tuple(found)])
    return frozenset(tuple(found[i : i + words]) for i in range(len(found) - words + 1))


def near_components(texts, words, percent):
    """{id: smallest id of its component} by comparing all pairs that share a shingle."""
    sets = {k: shingles(t, words) for k, t in texts.items()}
    by: dict = {}
    for k, s in sets.items():
        by.setdefault(s, []).append(k)
    reps = {min(v): s for s, v in by.items() if s}
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    def join(a, b):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)

    for s, v in by.items():
        if s:
            for k in v:
                join(min(v), k)
    holders: dict = {}
    for k, s in reps.items():
        for x in s:
            holders.setdefault(x, []).append(k)
    shared: dict = {}
    for v in holders.values():
        for i, a in enumerate(v):
            for b in v[i + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(reps[a]) + len(reps[b]) - n):
            join(a, b)
    return {k: find(k) for k in texts}, {k: len(s) for k, s in sets.items()}
