"""Contingency tables (A3, A4), marginals (A6, A8) and zero-cell recovery.

All tables are sparse DataFrames ``(keys..., a, b, n)`` that count only the candidate's
**non-zero** levels ``a``.  Counting is a plain ``groupBy().count()``: Spark combines
map-side (partial HashAggregate) and shuffles only the combined counts, so a hot feature or
class costs one row per partition, not one per cell.

The zero row of a table (candidate = 0) is recovered from the other variable's histogram
``nb`` (zero level included): ``n_0b = nb - sum_a n_ab``; a negative remainder raises an
error.  A table meets the levels of its other variable by an equi-join, whatever their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORT = "Marginal sum greater than total"


def hinted(df: DataFrame, rows: int | None, bound: int, otherwise: str | None = None) -> DataFrame:
    """Broadcast ``df`` only when its row count is known and within ``bound``; else apply the
    ``otherwise`` join hint (e.g. ``shuffle_hash``: build a hash table of this, the smaller,
    side per partition instead of sorting the big side)."""
    if rows is not None and rows <= bound:
        return F.broadcast(df)
    return df.hint(otherwise) if otherwise else df


def count_pairs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows(keys..., a, b)`` -> ``(keys..., a, b, n)``."""
    return rows.groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("n"))


def recover_missing_cells(counted: DataFrame, marg: DataFrame, winners: list, exclude: list,
                          feature_type, fill: dict) -> DataFrame:
    """Complete candidate x winner tables that were counted on part of the rows only.

    ``counted(feature, other, a, b, n)`` misses, for each winner w, exactly one of its levels,
    ``fill[w]``: the rows where w takes that level were skipped.  The missing cell of each
    candidate level is its marginal minus what was counted:
    ``n_a,fill = n_a - sum_{b != fill} n_ab``, with ``n_a`` from ``marg(feature, a, n)``.
    Pairing a sparse winner on its support leaves out b = 0; pairing a dense binary winner
    on its zero rows leaves out its single non-zero level.  The winners (few) are attached
    to each marginal row by a literal array, not a join.
    """
    cand = marg if not exclude else marg.where(~F.col("feature").isin(list(exclude)))
    ws = F.array(*[F.lit(w).cast(feature_type) for w in winners])
    cand = cand.select("feature", "a", F.col("n").alias("na"), F.explode(ws).alias("other"))
    s = counted.groupBy("feature", "other", "a").agg(F.sum("n").alias("s"))
    btype = counted.schema["b"].dataType
    level = None
    for w in winners:
        cond = F.col("other") == F.lit(w).cast(feature_type)
        v = F.lit(fill[w]).cast(btype)
        level = F.when(cond, v) if level is None else level.when(cond, v)
    rest = F.col("na") - F.coalesce(F.col("s"), F.lit(0))
    missing = (cand.join(s, ["feature", "other", "a"], "left")
               .select("feature", "other", "a", level.alias("b"),
                       F.when(rest < 0, F.raise_error(F.lit(SHORT))).otherwise(rest).cast("long").alias("n"))
               .where(F.col("n") > 0))
    return counted.select("feature", "other", "a", "b", F.col("n").cast("long").alias("n")).unionByName(missing)


def recover_zero_other(nz_pairs: DataFrame, marg: DataFrame, winners: list, exclude: list,
                       feature_type, zero=0.0) -> DataFrame:
    """Tables counted only on the winners' support: the b = 0 cells are recovered."""
    return recover_missing_cells(nz_pairs, marg, winners, exclude, feature_type, {w: zero for w in winners})


def marginals(pairs: DataFrame, keys: list[str], side: str = "a") -> DataFrame:
    """Row or column sums of sparse tables: ``(keys..., side, n)``."""
    return pairs.groupBy(*keys, side).agg(F.sum("n").alias("n"))


#: Levels of one other variable that a candidate meets in one row of the grid's join.
GRID_LEVELS = 1000
#: Counted levels up to which a histogram is broadcast to the grid's join.
BROADCAST_LEVELS = 100_000


def level_grid(tables: DataFrame, hist: DataFrame, hist_keys: list[str]) -> DataFrame:
    """Every table row of ``tables`` with every level of its other variable.

    Histograms with ``hist_keys`` are joined on them.  The class histogram has no key: its
    levels are hashed to buckets of about ``GRID_LEVELS`` levels and the tables visit the
    buckets, so the grid, which the zero row is by definition, is dealt out by an equi-join
    whatever the number of levels.
    """
    if hist_keys:
        return tables.join(hist, hist_keys)
    levels = hist.count()
    buckets = -(-max(1, levels) // GRID_LEVELS)
    dealt = hist.withColumn("_bucket", F.pmod(F.xxhash64("b"), F.lit(buckets)).cast("int"))
    visits = tables.withColumn("_bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return visits.join(hinted(dealt, levels, BROADCAST_LEVELS), "_bucket").drop("_bucket")


def zero_row(pairs: DataFrame, hist: DataFrame, keys: list[str], zero=0.0, hist_keys: list[str] | None = None) -> DataFrame:
    """The explicit zero-candidate cells ``(keys..., a=0, b, n)`` with ``n > 0`` of every table."""
    met = pairs.groupBy(*keys, "b").agg(F.sum("n").alias("t"))
    cells = level_grid(met.select(*keys).distinct(), hist, list(hist_keys or [])).join(met, [*keys, "b"], "left")
    t = F.coalesce("t", F.lit(0))
    return (cells.select(*keys, F.lit(zero).cast(pairs.schema["a"].dataType).alias("a"), "b",
                         F.when(F.col("nb") < t, F.raise_error(F.lit(SHORT))).otherwise(F.col("nb") - t)
                         .cast("long").alias("n"))
            .where(F.col("n") > 0))


def full_table(pairs: DataFrame, hist: DataFrame, keys: list[str], zero=0.0, hist_keys: list[str] | None = None) -> DataFrame:
    """Counted cells plus the recovered zero row: the whole table ``(keys..., a, b, n)``, n > 0."""
    counted = pairs.select(*keys, "a", "b", F.col("n").cast("long").alias("n"))
    return counted.unionByName(zero_row(pairs, hist, keys, zero, hist_keys))
