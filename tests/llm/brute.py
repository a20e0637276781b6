"""Plain versions of the operators on pairs, for small fixtures."""

from __future__ import annotations

import re

import regex


def words(text: str | None) -> list[str]:
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text: str | None, n: int = 4) -> set[tuple[str, ...]]:
    w = words(text)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(rows: list[tuple[int, str | None]], n: int = 4, percent: int = 85) -> dict[int, tuple[int, int]]:
    """doc_id: (shingles, smallest id reachable by links)."""
    sets = {k: shingles(t, n) for k, t in rows}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    keys = sorted(k for k in sets if sets[k])
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def tokens(text: str | None) -> list[str]:
    return [t for t in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if t]


def leaks(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = 13, tolerance: int = 2) -> dict[tuple[int, int], int]:
    """(doc, item): most equal tokens in a window, where it leaks."""
    import numpy as np

    ids: dict[str, int] = {}
    code = lambda ts: np.array([ids.setdefault(t, len(ids)) for t in ts], np.int64)
    coded = [(k, code(tokens(t))) for k, t in items]
    out = {}
    for d, text in docs:
        x = code(tokens(text))
        for i, y in coded:
            w = min(window, len(y))
            if not w or len(x) < w:
                continue
            need, most = w - tolerance * w // window, 0
            if len(np.intersect1d(x, y)) * 1 == 0:
                continue
            for shift in range(-(len(y) - w), len(x) - w + 1):
                a, b = max(0, -shift), min(len(y), len(x) - shift)
                if b - a >= w:
                    sums = np.convolve(x[a + shift : b + shift] == y[a:b], np.ones(w, np.int64), "valid")
                    most = max(most, int(sums.max()))
            if most >= need:
                out[d, i] = most
    return out
