"""Seeded sample files in the text formats: a binary 50 x 20 table and its class, both layouts."""

from __future__ import annotations

import numpy as np


def table(seed=7, n=50, d=20):
    """``X`` (instances x features) and a class that depends on some features."""
    rng = np.random.default_rng(seed)
    X = (rng.random((n, d)) < 0.5).astype(int)
    X[:, 12] = 0                                             # one feature without a non-zero cell
    y = ((X[:, 6] & X[:, 1]) | X[:, 14]) ^ (rng.random(n) < 0.15)
    return X, y.astype(int)


def csv_rows(path, first, M, sep=",", end="\n"):
    """``first, M...`` per line."""
    with open(path, "w", newline="") as f:
        for a, row in zip(first, M):
            f.write(sep.join(str(int(v)) for v in (a, *row)) + end)
    return str(path)


def libsvm_rows(path, first, M, comment=""):
    with open(path, "w") as f:
        f.write(comment)
        for a, row in zip(first, M):
            f.write(" ".join([str(int(a)), *(f"{j + 1}:{int(v)}" for j, v in enumerate(row) if v)]) + "\n")
    return str(path)


def class_line(path, y, end="\n"):
    with open(path, "w", newline="") as f:
        f.write(",".join(str(int(v)) for v in y) + end)
    return str(path)
