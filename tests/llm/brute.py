"""Plain versions of the operators over small tables."""

import re
from collections import Counter


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, width=5):
    w = words(fold(text))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def components(rows):
    """(id, set size, smallest reachable id) under 100 * intersection >= 80 * union."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = {}
    for n, (_, s) in enumerate(sets):
        shared = Counter(o for g in s for o in index.get(g, ()))
        for o, k in shared.items():
            if 100 * k >= 80 * (len(s) + len(sets[o][1]) - k):
                a, b = find(n), find(o)
                parent[max(a, b)] = min(a, b)
        for g in s:
            index.setdefault(g, []).append(n)
    least = {}
    for n, (i, _) in enumerate(sets):
        least.setdefault(find(n), []).append(i)
    return [(i, len(s), min((x for x in least[find(n)] if x is not None), default=None)) for n, (i, s) in enumerate(sets)]


def contained(rows, items, threshold=0.8):
    asked = [(i, shingles(t)) for i, t in items]
    out = []
    for doc, text in rows:
        own = shingles(text)
        out += [(doc, i, len(s & own), len(s)) for i, s in asked if s and len(s & own) >= threshold * len(s) - 1e-9]
    return out


def base_counts(text):
    w = words(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)
