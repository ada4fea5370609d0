"""Mutual information of sparse contingency counts (in bits).

Input ``pairs(keys..., a, b, n)`` holds, for every candidate feature, the number of
instances in which the candidate takes the **non-zero** level ``a`` and the other variable
(the class or a selected feature) takes level ``b`` (zero allowed).  Instances where the
candidate is zero are never counted; they are recovered from the other variable's full
histogram ``hist(b, nb)`` (zero level included) and the instance count ``N``: the zero
cell of level b is nb - t_b with t_b = sum_a n_ab, the zero marginal is N - n_f.  No
materialised zero cell is needed.

One plan serves every size: sums by candidate level and by other level are joined back to the
counts, so every term is a small logarithm (no large entropies cancel) and no task ever holds
a whole table, however many levels it has; skewed keys are split by Spark's skew handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.entropy import xlog2x
from .contingency import SHORT, hinted, level_grid

#: Counted cells of one table up to which a task may sort a whole table.
FEW_CELLS = 1 << 20

# grouping_id() values for grouping sets over (keys..., a, b): bit 1 = a rolled up, bit 0 = b
_GID_AB, _GID_A, _GID_B, _GID_F = 0, 1, 2, 3


def mi_from_pairs(pairs: DataFrame, hist: DataFrame, n_total: int, keys: list[str],
                  hist_keys: list[str] | None = None, hist_rows: int | None = None,
                  broadcast_rows: int = 1_000_000, cell_terms: dict | None = None,
                  table_cells: int | None = None) -> DataFrame:
    """Return ``(keys..., mi, nnz, n_levels, lo, <cell terms>...)``.

    ``hist`` has columns ``(hist_keys..., b, nb)``; ``hist_keys`` is a subset of ``keys`` that
    names which other variable a histogram row belongs to (empty for the class).
    ``nnz`` is the candidate's number of non-zero cells, ``n_levels`` its non-zero levels and
    ``lo`` its smallest non-zero level (the level itself when there is only one).

    Each cell contributes n log2(n N / (na nb)).  The zero row is added per seen level b as
    m log2(m N / (n0 nb)) with m = nb - t_b, n0 = N - nnz, and for all levels the candidate
    never meets at once as (N - sum of seen nb) log2(N / n0).  ``pairs`` should be materialised:
    the small counts are read once by candidate level and once by other level.

    ``cell_terms`` maps names to ``fn(n, na, nb, N) -> Column``; each is summed over all
    non-zero cells of every complete table (zero row included).

    ``table_cells`` is a bound of the counted cells of one table.  Up to ``FEW_CELLS`` the counts are
    partitioned by table once and every sum is a window inside that partitioning; larger or
    unknown tables are spread by (table, level) and joined with their sums.
    """
    hist_keys = list(hist_keys or [])
    h = hist.select(*hist_keys, "b", F.col("nb").cast("double").alias("nb"))
    with_nb = pairs.join(hinted(h, hist_rows, broadcast_rows), hist_keys + ["b"], "left")
    # SQL text: one round trip to the JVM per column keeps the planning time of an iteration small
    N = repr(float(n_total))
    if table_cells is not None and table_cells <= FEW_CELLS:
        return _small_tables(with_nb, h, n_total, keys, hist_keys, cell_terms or {})
    by_level = with_nb.selectExpr(*[f"`{c}`" for c in keys], "a", "CAST(n AS DOUBLE) AS n", "nb").repartition(*keys, "a")
    na = by_level.groupBy(*keys, "a").agg(F.sum("n").alias("na"))
    cells = (by_level.join(na, [*keys, "a"]).groupBy(*keys)
             .agg(F.expr(f"sum(n * log2(n * {N} / (na * nb)))").alias("s_cell"), F.expr("sum(n)").alias("nnz"),
                  F.expr("min(a)").alias("lo"), F.expr("sum(n / na)").alias("levels")))
    met = with_nb.groupBy(*keys, "b").agg(F.expr("CAST(sum(n) AS DOUBLE)").alias("tb"), F.max("nb").alias("nb"))
    zero = (met.join(cells, keys).groupBy(*keys, "s_cell", "nnz", "lo", "levels")
            .agg(F.expr(f"sum(CASE WHEN nb IS NULL OR nb < tb THEN CAST(raise_error('{SHORT}') AS DOUBLE) "
                        f"WHEN nb > tb THEN (nb - tb) * log2((nb - tb) * {N} / (({N} - nnz) * nb)) ELSE 0.0 END)").alias("s_zero"),
                 F.expr("sum(nb)").alias("seen")))
    rest = f"CASE WHEN {N} > seen AND {N} > nnz THEN ({N} - seen) * log2({N} / ({N} - nnz)) ELSE 0.0 END"
    out = zero.select(*keys, F.expr(f"(s_cell + s_zero + {rest}) / {N}").alias("mi"),
                      F.col("nnz").cast("long").alias("nnz"), F.expr("CAST(round(levels) AS BIGINT)").alias("n_levels"), "lo")
    if not cell_terms:
        return out
    return out.join(_cell_sums(with_nb, h, n_total, keys, hist_keys, cell_terms), keys)


def _small_tables(with_nb: DataFrame, hist: DataFrame, n_total: int, keys: list[str], hist_keys: list[str],
                  terms: dict) -> DataFrame:
    """The columns of ``mi_from_pairs`` from counts with their ``nb``; one exchange by table, and for cell terms
    the join of the zero row's levels."""
    N = repr(float(n_total))
    by = ", ".join(f"`{c}`" for c in keys)
    w = with_nb.select(*keys, "a", "b", F.col("n").cast("double").alias("n"), "nb").repartition(*keys).selectExpr(
        *[f"`{c}`" for c in keys], "a", "b", "n", "nb", f"sum(n) OVER (PARTITION BY {by}, a) AS na",
        f"sum(n) OVER (PARTITION BY {by}, b) AS tb", f"sum(n) OVER (PARTITION BY {by}) AS nnz")
    # the zero cell of level b is added once, shared out over the rows of that level
    zero = (f"CASE WHEN nb IS NULL OR nb < tb THEN CAST(raise_error('{SHORT}') AS DOUBLE) "
            f"WHEN nb > tb THEN n / tb * (nb - tb) * log2((nb - tb) * {N} / (({N} - nnz) * nb)) ELSE 0.0 END")
    sums = w.groupBy(*keys).agg(
        F.expr(f"sum(n * log2(n * {N} / (na * nb)))").alias("s_cell"), F.expr(f"sum({zero})").alias("s_zero"),
        F.expr("max(nnz)").alias("nnz"), F.expr("min(a)").alias("lo"), F.expr("sum(n / na)").alias("levels"),
        F.expr("round(sum(n / tb * nb))").alias("seen"),
        *[F.sum(fn(F.col("n"), F.col("na"), F.col("nb"), F.lit(float(n_total)))).alias(f"c_{k}") for k, fn in terms.items()])
    rest = f"CASE WHEN {N} > seen AND {N} > nnz THEN ({N} - seen) * log2({N} / ({N} - nnz)) ELSE 0.0 END"
    out = sums.select(*keys, F.expr(f"(s_cell + s_zero + {rest}) / {N}").alias("mi"), F.col("nnz").cast("long").alias("nnz"),
                      F.expr("CAST(round(levels) AS BIGINT)").alias("n_levels"), "lo", *[f"c_{k}" for k in terms])
    if not terms:
        return out
    met = w.groupBy(*keys, "b").agg(F.max("tb").alias("tb"))
    zeros = _zero_sums(sums.select(*keys, F.col("nnz").alias("nf")), met, hist, n_total, keys, hist_keys, terms)
    return out.join(zeros, keys).select(*keys, "mi", "nnz", "n_levels", "lo",
                                        *[(F.col(f"c_{k}") + F.col(f"z_{k}")).alias(k) for k in terms])


def _zero_sums(nnz: DataFrame, met: DataFrame, hist: DataFrame, n_total: int, keys: list[str], hist_keys: list[str],
               terms: dict) -> DataFrame:
    """``keys..., z_<name>``: each term summed over the zero row, whose cells follow from all levels of the other
    variable and the counts ``tb`` of those that were met."""
    N = F.lit(float(n_total))
    grid = level_grid(nnz, hist, hist_keys).join(met, [*keys, "b"], "left")
    n0, m = N - F.col("nf"), F.col("nb") - F.coalesce("tb", F.lit(0.0))
    return grid.groupBy(*keys).agg(*[
        F.sum(F.when((m > 0) & (n0 > 0), fn(m, n0, F.col("nb"), N)).otherwise(F.lit(0.0))).alias(f"z_{k}")
        for k, fn in terms.items()])


def _cell_sums(pairs: DataFrame, hist: DataFrame, n_total: int, keys: list[str], hist_keys: list[str],
               terms: dict) -> DataFrame:
    """``keys..., <name>``: each term summed over the counted cells and over the zero row."""
    N = F.lit(float(n_total))
    na = pairs.groupBy(*keys, "a").agg(F.sum("n").cast("double").alias("na"))
    n = F.col("n").cast("double")
    counted = (pairs.join(na, [*keys, "a"])
               .groupBy(*keys).agg(*[F.sum(fn(n, F.col("na"), F.col("nb"), N)).alias(f"c_{k}") for k, fn in terms.items()]))
    nnz = na.groupBy(*keys).agg(F.sum("na").alias("nf"))
    met = pairs.groupBy(*keys, "b").agg(F.sum("n").cast("double").alias("tb"))
    zero = _zero_sums(nnz, met, hist, n_total, keys, hist_keys, terms)
    return counted.join(zero, keys).select(*keys, *[(F.col(f"c_{k}") + F.col(f"z_{k}")).alias(k) for k in terms])


def mi_from_full_table(table: DataFrame, keys: list[str]) -> DataFrame:
    """MI straight from a complete table ``(keys..., a, b, n)`` whose zero cells are included
    (no recovery).  Used for small explicit tables, tests and the two-vector form."""
    cols = keys + ["a", "b"]
    gs = (table.groupingSets([cols, keys + ["a"], keys + ["b"], keys], *cols)
          .agg(F.sum("n").alias("s"), F.grouping_id().alias("gid")))
    gid, s = F.col("gid"), F.col("s")
    sign = F.when(gid == _GID_AB, 1.0).when(gid == _GID_F, 1.0).otherwise(-1.0)
    return (gs.groupBy(*keys)
            .agg(F.sum(sign * xlog2x(s)).alias("t"), F.max(F.when(gid == _GID_F, s)).alias("n"))
            .select(*keys, (F.col("t") / F.col("n").cast("double")).alias("mi")))


def mutual_information_columns(df: DataFrame, x: str, y: str) -> DataFrame:
    """MI of two discrete columns of one table (A10): ``(mi)``, one row."""
    from .cells import col_of
    t = (df.groupBy(col_of(x).alias("a"), col_of(y).alias("b")).agg(F.count(F.lit(1)).alias("n"))
         .withColumn("k", F.lit(0)))
    return mi_from_full_table(t, ["k"]).select("mi")
