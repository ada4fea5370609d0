"""Alternating AND/OR tree label over 2^m bit columns.

Level 1 combines neighbours (1st with 2nd, 3rd with 4th, ...) with AND, level 2 with OR,
level 3 with AND again, and so on until one bit is left.  For eight bits this is
((x1 & x2) | (x3 & x4)) & ((x5 & x6) | (x7 & x8)).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tree_label(bits: list) -> Column:
    cols = [F.col(b) if isinstance(b, str) else b for b in bits]
    n = len(cols)
    if n == 0 or n & (n - 1):
        raise ValueError(f"tree_label needs a power-of-two number of bit columns, got {n}")
    level = 1
    while len(cols) > 1:
        op = (lambda x, y: x.bitwiseAND(y)) if level % 2 == 1 else (lambda x, y: x.bitwiseOR(y))
        cols = [op(cols[i], cols[i + 1]) for i in range(0, len(cols), 2)]
        level += 1
    return cols[0]
