"""Plain NumPy reference: dense contingency tables, MI in bits, greedy selection."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np


def mi(x, y) -> float:
    x, y = list(x), list(y)
    n = len(x)
    cxy = Counter(zip(x, y))
    cx, cy = Counter(x), Counter(y)
    return sum(c / n * math.log2(c * n / (cx[a] * cy[b])) for (a, b), c in cxy.items())


def select(X: np.ndarray, y, k: int, score="mrmr", per_iter: int = 1, candidates=None):
    """Greedy selection on columns of X; returns [(feature, score)]."""
    feats = list(range(X.shape[1])) if candidates is None else list(candidates)
    rel = {f: mi(X[:, f], y) for f in feats}
    red = {f: 0.0 for f in feats}
    chosen, out = [], []
    while len(chosen) < k:
        n_sel = len(chosen)
        coef = 1.0 if n_sel <= 1 else 1.0 / n_sel
        if score == "mrmr":
            sc = {f: rel[f] - coef * red[f] for f in feats if f not in chosen}
        elif score == "maxrel":
            sc = {f: rel[f] for f in feats if f not in chosen}
        else:
            sc = {f: score(rel[f], red[f], n_sel) for f in feats if f not in chosen}
        if not sc:
            break
        order = sorted(sc, key=lambda f: (-round(sc[f], 12), f))
        take = order[: min(per_iter, k - len(chosen))] if score != "maxrel" else order[:k]
        for f in take:
            chosen.append(f)
            out.append((f, sc[f]))
        if score == "maxrel":
            break
        for w in take:
            for f in feats:
                if f not in chosen:
                    red[f] += mi(X[:, f], X[:, w])
    return out
