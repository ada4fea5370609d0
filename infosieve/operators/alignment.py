"""Stored cells: fetching one feature (F3) and aligning long vectors (J3, J4) without moving them.

Cells ``(feature, pos, a)`` are written once as a table that is bucketed by position and, inside each
file, sorted by a 64-bit key of the feature.  Both sides of an alignment lie in the same number of
buckets, so vectors, classes and cells meet by a join on position without an exchange, however
long they are.  Files carry the least and largest key of every row group, so the cells of one feature
are found by reading only the row groups that can hold its key.

Tables live below the shared checkpoint folder, which all executors reach; a lost executor costs the
tasks that read them again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

#: Name of the column that holds the feature's key, and rows of one row group at most (by its size).
KEY, ROW_GROUP_BYTES = "feature_key", 1 << 20


def feature_key(column: str | Column) -> Column:
    return F.xxhash64(column)


def _saved(df: DataFrame, buckets: int, order: list[str], what: str, options: dict | None = None) -> DataFrame:
    spark = df.sparkSession
    name = f"{what}_{uuid.uuid4().hex[:12]}"
    writer = (df.repartition(buckets, "pos").write.format("parquet").option("path", scratch_path(spark, what))
              .bucketBy(buckets, "pos").sortBy(*order))
    for k, v in (options or {}).items():
        writer = writer.option(k, v)
    writer.saveAsTable(name)
    out = spark.table(name)
    out.stored_name = name
    return out


def store_by_position(df: DataFrame, buckets: int) -> DataFrame:
    """``df(pos, ...)`` as a table bucketed and sorted by position."""
    return _saved(df, buckets, ["pos"], "vector")


def store_cells(cells: DataFrame, buckets: int) -> DataFrame:
    """``cells(feature, pos, ...)`` as a table bucketed by position and sorted by feature key."""
    keyed = cells.withColumn(KEY, feature_key("feature"))
    return _saved(keyed, buckets, [KEY, "pos"], "cells", {"parquet.block.size": str(ROW_GROUP_BYTES)})


def drop_stored(*tables: DataFrame) -> None:
    """Forget stored tables; their files go with the other scratch files (``drop_scratch``)."""
    for t in tables:
        t.sparkSession.sql(f"DROP TABLE IF EXISTS `{t.stored_name}`")


def aligned(x: DataFrame, y: DataFrame) -> DataFrame:
    """``(pos, a, b)`` of two vectors ``(pos, value)``; a position that one of them lacks or repeats raises.

    Vectors stored with ``store_by_position`` in equally many buckets are merged where they lie."""
    def once(vector: DataFrame, name: str) -> DataFrame:
        repeated = F.raise_error(F.lit("a vector holds a position twice")).cast(vector.schema["value"].dataType)
        value = F.when(F.count(F.lit(1)) > 1, repeated).otherwise(F.first("value"))
        return vector.groupBy("pos").agg(F.struct(value.alias("v")).alias(name))

    one, two = once(x, "l"), once(y, "r")
    lone = F.raise_error(F.lit("vectors of different positions"))
    both = one.join(two, "pos", "full")
    whole = F.when(F.col("l").isNull() | F.col("r").isNull(), lone.cast("boolean")).otherwise(F.lit(True))
    return both.where(whole).select("pos", F.col("l.v").alias("a"), F.col("r.v").alias("b"))


def mutual_information_aligned(x: DataFrame, y: DataFrame) -> DataFrame:
    """MI of two discrete vectors ``(pos, value)`` that are aligned by position (A10): ``(mi)``, one row."""
    from .information import mi_from_full_table
    table = aligned(x, y).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.lit(0))
    return mi_from_full_table(table, ["k"]).select("mi")
