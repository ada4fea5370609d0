"""Dataset statistics: class histogram (A1), feature levels (A2), histograms (A8),
row / width / stored-point counts (A12, S9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cells import col_of


def class_histogram(df: DataFrame, label: str) -> DataFrame:
    """``(label, n)``: one grouped count, map-side combined."""
    return df.groupBy(col_of(label).alias(label)).agg(F.count(F.lit(1)).alias("n"))


def feature_levels(cells: DataFrame, n_rows: int | Column | None = None) -> DataFrame:
    """``(feature, n_levels, nnz)`` from non-zero cells ``(row, feature, value)``; the zero level
    is implicit (``n_rows - nnz`` instances)."""
    return cells.groupBy("feature").agg(F.count_distinct("value").alias("n_levels"),
                                        F.count(F.lit(1)).alias("nnz"))


def histograms(cells: DataFrame, n_rows, features: DataFrame | None = None) -> DataFrame:
    """``(feature, level, n)`` of every feature, zero level included (``n > 0`` only)."""
    nz = cells.groupBy("feature", F.col("value").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    tot = nz.groupBy("feature").agg(F.sum("n").alias("nnz"))
    if features is not None:
        tot = features.join(tot, "feature", "left")
    zeros = tot.select("feature", F.lit(0.0).alias("level"),
                       (F.lit(n_rows) - F.coalesce("nnz", F.lit(0))).cast("long").alias("n"))
    return nz.unionByName(zeros).where(F.col("n") > 0)


def nonzeros(arr: Column) -> Column:
    """Number of non-zero entries of an ARRAY column."""
    return F.size(F.filter(arr, lambda x: x != 0.0))


def profile(df: DataFrame, features: str, width: int | None = None) -> DataFrame:
    """``(n_rows, n_cols, n_points)``; points = non-zeros + 1 (the label) per row,
    summed as BIGINT; width must be the same on every row.  Maps have the declared ``width``, else that of
    their largest key."""
    c, declared = col_of(features), width
    width = F.size(c) if not df.schema[features].dataType.simpleString().startswith("map") else None
    agg = [F.count(F.lit(1)).alias("n_rows")]
    if width is not None:
        agg += [F.max(width).alias("n_cols"), F.min(width).alias("_min_cols"),
                F.sum((nonzeros(c) + 1).cast("long")).alias("n_points")]
    else:
        widest = F.max(F.array_max(F.map_keys(c))) + 1 if declared is None else F.lit(declared)
        agg += [widest.cast("int").alias("n_cols"),
                F.sum((F.size(F.map_filter(c, lambda k, v: v != 0.0)) + 1).cast("long")).alias("n_points")]
    out = df.agg(*agg)
    if width is not None:
        out = out.select(F.col("n_rows"), F.when(F.col("n_cols") != F.col("_min_cols"),
                                                 F.raise_error(F.lit("ragged rows"))).otherwise(F.col("n_cols"))
                         .cast("int").alias("n_cols"), "n_points")
    return out


def profile_cells(cells: DataFrame, ids: DataFrame, n_instances: int) -> DataFrame:
    """The profile of feature-wise cells: features (from ``ids``), instances, non-zero points plus
    one (the id) per feature."""
    points = cells.where(F.col("value") != 0).agg(F.count(F.lit(1)).alias("cells"))
    rows = ids.agg(F.count(F.lit(1)).alias("n_rows"))
    one = F.lit(1).alias("one")
    return (rows.select("*", one).join(points.select("*", one), "one")
            .select("n_rows", F.lit(int(n_instances)).alias("n_cols"), (F.col("cells") + F.col("n_rows")).alias("n_points")))
