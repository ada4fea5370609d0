"""Rank statistics of contingency tables (M5, U3): Spearman's rho and Kendall's tau-b, ties by mean ranks.

Both depend on the counts ``(keys..., a, b, n)`` of complete tables alone, so whole vectors are counted
once and never gathered.

* Ranks: levels are range-partitioned by table and level; sums inside each range plus the offsets of the
  ranges before it give the rank of every level.  No task holds a table's levels.
* Spearman: the covariance of the ranks about their mean (N + 1) / 2, a partial aggregate.
* Kendall: concordant less discordant pairs.  The a-levels, in order, are cut into blocks of about ``W``
  cells (``BLOCK_CELLS``, or a thousandth of a larger table), the b-levels too; a level of ``W`` cells or more
  is a block of its own, whose cells are ties of each other.  Pairs of cells in different blocks on both
  sides are counted from the block grid, the others inside their a-block or their b-block; each
  group holds at most 2 W cells or a grid of about 2,000 x 2,000.  Where no table has more than
  ``BLOCK_CELLS`` cells, each is one group.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_CELLS, BLOCKS = 1 << 16, 1000
#: Entries up to which a group's cells are counted as a matrix.
MATRIX = 1 << 22


def running(df: DataFrame, keys: list[str], by: str, values: list[str]) -> DataFrame:
    """``df`` with ``before_<value>``: the sum of each value over the smaller ``by`` of the same keys."""
    held = (df.repartitionByRange(*[F.col(k) for k in keys], F.col(by)).withColumn("range_id", F.spark_partition_id())
            .checkpoint(eager=True))
    sums = held.groupBy("range_id", *keys).agg(*[F.sum(v).alias(f"all_{v}") for v in values])
    earlier = Window.partitionBy(*keys).orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("range_id", *keys, *[F.coalesce(F.sum(f"all_{v}").over(earlier), F.lit(0)).alias(f"start_{v}") for v in values])
    inside = Window.partitionBy("range_id", *keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    at = held.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"in_{v}") for v in values])
    return at.join(starts, ["range_id", *keys]).select(
        *df.columns, *[(F.col(f"start_{v}") + F.col(f"in_{v}")).alias(f"before_{v}") for v in values])


def signed_pairs(u: np.ndarray, v: np.ndarray, n: np.ndarray) -> float:
    """Sum of n_i n_j sign(v_j - v_i) over the pairs of cells with u_i < u_j."""
    u, v = (np.unique(x, return_inverse=True)[1] for x in (u, v))
    n = n.astype(np.float64)
    rows, columns = int(u.max()) + 1, int(v.max()) + 1
    if rows == 1 or columns == 1:
        return 0.0
    if rows * columns <= max(MATRIX, 4 * len(n)):
        m = np.zeros((rows, columns))
        np.add.at(m, (u, v), n)
        above = np.cumsum(m, axis=0) - m                       # smaller u, same v
        less = np.cumsum(above, axis=1) - above
        return float((m * (2 * less + above - above.sum(axis=1, keepdims=True))).sum())
    order = np.lexsort((v, u))
    u, v, n = u[order], v[order], n[order]
    total, place, width = 0.0, np.arange(len(n)), 1
    while width < len(n):
        # runs of ``width`` cells meet their right neighbours, both sorted by v
        group, right = place // (2 * width), (place // width) % 2 == 1
        s = np.lexsort((v, group))
        g, x, weight = group[s], v[s], np.where(right[s], 0.0, n[s])
        cum = np.r_[0.0, np.cumsum(weight)]
        new = np.r_[True, (g[1:] != g[:-1]) | (x[1:] != x[:-1])]
        first = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        end = np.r_[first[1:], len(n)]
        g_first, g_end = np.searchsorted(g, g, "left"), np.searchsorted(g, g, "right")
        less, more = cum[first[run]] - cum[g_first], cum[g_end] - cum[end[run]]
        total += float((np.where(right[s], n[s], 0.0) * (less - more)).sum())
        width *= 2
    # pairs of equal u were counted as concordant unless v is equal too
    by_u = np.bincount(u, n)
    same = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])]
    by_cell = np.bincount(np.cumsum(same) - 1, n)
    return total - float(((by_u ** 2).sum() - (by_cell ** 2).sum()) / 2)


def _levels(table: DataFrame, keys: list[str], side: str, small: bool) -> DataFrame:
    """``keys, side, total, cells`` and their sums over smaller levels; ``small`` tables are sorted each in one task."""
    levels = table.groupBy(*keys, side).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("cells"))
    if small:
        lower = Window.partitionBy(*keys).orderBy(side).rowsBetween(Window.unboundedPreceding, -1)
        return levels.select("*", *[F.coalesce(F.sum(v).over(lower), F.lit(0)).alias(f"before_{v}") for v in ("total", "cells")])
    return running(levels, keys, side, ["total", "cells"])


def _signed(cells: DataFrame, keys: list[str], by: list[str], u: str, v: str) -> DataFrame:
    """``keys, s``: ``signed_pairs`` of every group."""
    kinds = T.StructType([cells.schema[k] for k in keys] + [T.StructField("s", T.DoubleType())])

    def work(key, pdf):
        import pandas as pd
        s = signed_pairs(pdf[u].to_numpy(), pdf[v].to_numpy(), pdf["n"].to_numpy())
        return pd.DataFrame([[*key[:len(keys)], s]], columns=[*keys, "s"])
    return cells.select(*dict.fromkeys([*by, u, v, "n"])).groupBy(*by).applyInPandas(work, kinds)


def rank_terms(table: DataFrame, keys: list[str], kinds: dict, prefix: str = "", block_cells: int = BLOCK_CELLS) -> DataFrame:
    """``keys...`` and one column per statistic of complete tables ``(keys..., a, b, n)``; ``kinds`` maps names to
    ``"spearman"`` or ``"kendall"``.  A side with one level alone gives null."""
    cells = table.select(*keys, "a", "b", F.col("n").cast("long").alias("n")).checkpoint(eager=True)
    biggest = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 0
    small = biggest <= block_cells        # every table is one block
    sides = {side: _levels(cells, keys, side, small) for side in ("a", "b")}
    whole = sides["a"].groupBy(*keys).agg(F.sum("total").cast("double").alias("count"), F.sum("cells").alias("all_cells"))
    for side, levels in sides.items():
        d, mean = F.col("total").cast("double"), (F.col("count") + 1) / 2
        rank = F.col("before_total") + (d + 1) / 2
        ties = levels.join(whole.select(*keys, "count"), keys).groupBy(*keys).agg(
            F.sum(d * (rank - mean) * (rank - mean)).alias(f"var_{side}"),
            F.sum(d * (d - 1) / 2).alias(f"ties_{side}"))
        whole = whole.join(ties, keys)
    if not small:
        whole = whole.checkpoint(eager=True)
    out = whole
    if "spearman" in kinds.values():
        met = cells
        for side, levels in sides.items():
            rank = F.col("before_total") + (F.col("total").cast("double") + 1) / 2
            met = met.join(levels.select(*keys, side, rank.alias(f"rank_{side}")), [*keys, side])
        mean = (F.col("count") + 1) / 2
        both = met.join(whole.select(*keys, "count"), keys).groupBy(*keys).agg(
            F.sum(F.col("n") * (F.col("rank_a") - mean) * (F.col("rank_b") - mean)).alias("cov"))
        out = out.join(both, keys)
    if "kendall" in kinds.values() and small:
        out = out.join(_signed(cells, keys, keys, "a", "b").withColumnRenamed("s", "signed"), keys)
    elif "kendall" in kinds.values():
        blocked = cells
        for side, levels in sides.items():
            size = F.greatest(F.lit(block_cells), F.ceil(F.col("all_cells") / BLOCKS))
            block = 2 * F.floor(F.col("before_cells") / size) + (F.col("cells") >= size).cast("int")
            at = levels.join(whole.select(*keys, "all_cells"), keys).select(*keys, side, block.cast("long").alias(f"block_{side}"))
            blocked = blocked.join(at, [*keys, side])
        blocked = blocked.checkpoint(eager=True)
        grid = blocked.groupBy(*keys, "block_a", "block_b").agg(F.sum("n").alias("n"))
        parted = whole.where(F.col("all_cells") > block_cells).select(*keys)  # a smaller table is one block
        parts = [_signed(grid, keys, keys, "block_a", "block_b"),
                 _signed(blocked.where("block_a % 2 = 0"), keys, [*keys, "block_a"], "a", "b"),
                 _signed(blocked.join(parted, keys, "left_semi").where("block_b % 2 = 0"), keys, [*keys, "block_b"], "block_a", "b")]
        signed = parts[0].union(parts[1]).union(parts[2]).groupBy(*keys).agg(F.sum("s").alias("signed"))
        out = out.join(signed, keys)
    pairs = F.col("count") * (F.col("count") - 1) / 2
    value = {"spearman": F.col("cov") / F.sqrt(F.col("var_a") * F.col("var_b")) if "spearman" in kinds.values() else None,
             "kendall": F.col("signed") / F.sqrt((pairs - F.col("ties_a")) * (pairs - F.col("ties_b")))
             if "kendall" in kinds.values() else None}
    some = (F.col("var_a") > 0) & (F.col("var_b") > 0)
    return out.select(*keys, *[F.when(some, value[kind]).alias(prefix + name) for name, kind in kinds.items()])


def rank_correlation_columns(df: DataFrame, x: str, y: str) -> DataFrame:
    """``(spearman, kendall)`` of two columns of one table, one row."""
    from .cells import col_of
    table = (df.groupBy(col_of(x).alias("a"), col_of(y).alias("b")).agg(F.count(F.lit(1)).alias("n"))
             .withColumn("one", F.lit(0)))
    return rank_terms(table, ["one"], {"spearman": "spearman", "kendall": "kendall"}).select("spearman", "kendall")
