"""Mixing sources to target weights (operator 1).

Word counts are summed per source, targets come from water-filling the budget over the
source weights under a repetition limit, and every document is then emitted
``floor(rate)`` times plus one hash-seeded Bernoulli copy with probability equal to the
fraction of its source's rate.

Defined results: a null text has size 0; the null source is a source of its own and comes
last; a source of size 0 gets target 0 and no copies; repeated rows draw alike (the draw
hashes ``doc_id`` and the seed only; a null ``doc_id`` hashes as the text ``null``); texts of any length are counted whole; an empty
table gives an empty result; extra columns are kept by :func:`emit` and ignored by
:func:`mix`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_CLASS, numbered, stored

#: Hex digits of the digest that make the uniform draw: 13 digits are 52 bits, exact in a double.
DRAW_DIGITS = 13


def source_targets(by_source: DataFrame, weights: Sequence[float] = (5, 2, 1), budget: float = 1.5,
                   limit: int = 2) -> DataFrame:
    """``source, source_size, weight, target`` of a table with one row per source.

    Each round caps the sources whose share lies above ``limit`` times their size and shares
    the rest of the budget among the others by weight; only one row of sums per round
    reaches the driver.
    """
    order = [F.col("source").asc_nulls_last()]
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    src = stored(numbered(by_source, order, "mix-rank", out="place").withColumn("weight", w), "mix-sources")
    total, wsum = src.agg(F.sum("source_size"), F.sum("weight")).first()
    total, wsum = total or 0, wsum or 0
    cap = F.col("source_size") * limit
    rest, level, capped = budget * total, (budget * total / wsum if wsum else 0.0), 0
    while True:
        above = F.col("weight") * F.lit(level) > cap
        n, cap_sum, w_left = src.agg(F.count(F.when(above, 1)), F.sum(F.when(above, cap)),
                                     F.sum(F.when(~above, F.col("weight")))).first()
        if n == capped:
            break
        capped, rest = n, budget * total - (cap_sum or 0)
        if not w_left:
            break
        level = rest / w_left
    above = F.col("weight") * F.lit(level) > cap
    target = F.when(above, cap.cast("double")).otherwise(F.col("weight") * F.lit(level))
    return src.select("source", "source_size", "weight", target.alias("target"))


def _size() -> Column:
    return F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD_CLASS)).cast("long")


def _rate() -> Column:
    return F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))


def _draw(seed: str) -> Column:
    """A uniform number in [0, 1) of the document's id and the seed."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, DRAW_DIGITS), 16, 10).cast("long") / F.lit(float(16 ** DRAW_DIGITS))


def _copies() -> Column:
    return F.floor("rate") + (F.col("draw") < F.col("rate") - F.floor("rate")).cast("long")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, limit: int = 2,
        seed: str = "mix") -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken``: one row per document.

    The documents are read once; what is kept of them is id, source and size.
    """
    sized = stored(docs.select("doc_id", "source", _size().alias("size"), _draw(seed).alias("draw")), "mix-sizes")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    src = source_targets(by_source, weights, budget, limit).withColumnRenamed("source", "_source")
    return (sized.join(src, sized["source"].eqNullSafe(src["_source"])).withColumn("rate", _rate())
            .withColumn("copies", _copies())
            .select("doc_id", "source", "size", "source_size", "target", "copies",
                    (F.col("size") * F.col("copies")).alias("taken")))


def emit(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, limit: int = 2,
         seed: str = "mix") -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as :func:`mix` takes it.

    Copies depend on the source's rate and the document's id alone, so the rows are not
    joined on their id: the rates (one row per source) meet the documents directly.
    """
    by_source = docs.groupBy("source").agg(F.sum(_size()).alias("source_size"))
    src = source_targets(by_source, weights, budget, limit)
    rates = src.select(F.col("source").alias("s"), _rate().alias("rate"))
    rows = docs.select(F.struct("*").alias("doc"), "source", _draw(seed).alias("draw"))
    taken = rows.join(rates, rows["source"].eqNullSafe(rates["s"])).withColumn("copies", _copies()).where("copies > 0")
    return (taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select("doc.*"))


ORACLE = r"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
b AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM b),
t AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS budget, 2.0::DOUBLE * source_size / weight AS ratio FROM w),
k AS (SELECT *, (budget - coalesce(sum(2 * source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / (sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS lam FROM t),
l AS (SELECT coalesce(arg_min(lam, ratio) FILTER (WHERE lam <= ratio), 0) AS lam FROM k),
g AS (SELECT t.source, t.source_size, CASE WHEN t.weight * l.lam > 2 * t.source_size THEN 2.0::DOUBLE * t.source_size ELSE t.weight * l.lam END AS target FROM t, l),
r AS (SELECT s.doc_id, s.source, s.size, g.source_size, g.target,
        CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0 END AS rate,
        ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
      FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source),
c AS (SELECT *, (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM r)
SELECT doc_id, source, size, source_size, target, copies, size * copies AS taken FROM c
"""
