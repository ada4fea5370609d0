"""Helpers shared by the operators: stored tables, ordered numbering, connected components."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import scratch_path

WORD_CLASS = r"[^\x20\x09-\x0D]+"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below the shared checkpoint folder and read it back.

    Cuts lineage (a lost executor rereads files) and fixes values that depend on the layout
    of one execution, such as partition numbers.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


#: Rows of a batch that goes to Python: documents are long, and a batch lies in memory several
#: times (off the heap in both directions, as columns and as texts).
BATCH_ROWS = 2000


def in_arrow(df: DataFrame, run, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with batches of at most ``BATCH_ROWS`` rows (lowered for the session)."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    # mapInArrow reads column names as paths: names with dots and the like are others on the way
    safe = {c: c if re.fullmatch(r"\w+", c) else f"column_{i}_" for i, c in enumerate(df.columns)}
    if all(k == v for k, v in safe.items()):
        return df.mapInArrow(run, schema)
    if isinstance(schema, str):
        return df.toDF(*safe.values()).mapInArrow(run, schema)
    inside = StructType([StructField(safe.get(f.name, f.name), f.dataType, f.nullable) for f in schema.fields])
    return df.toDF(*safe.values()).mapInArrow(run, inside).toDF(*schema.fieldNames())


def crc_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (null ids count as empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def numbered(df: DataFrame, order: list[Column], name: str, value: Column | None = None,
             out: str = "before") -> DataFrame:
    """Add the running sum of ``value`` (default 1) over all earlier rows in ``order``.

    Rows are range-partitioned by the order and stored with their partition number; sums of
    whole partitions (one row each) give each partition's offset, a window inside the
    partition gives the rest.  No task sees more than one range.
    """
    value = F.lit(1).cast("long") if value is None else value.cast("long")
    ranged = stored(df.withColumn("_v", value).repartitionByRange(*order)
                    .withColumn("_pid", F.spark_partition_id()), name)
    per = ranged.groupBy("_pid").agg(F.sum("_v").alias("_sum"))
    offsets = per.select("_pid", (F.sum("_sum").over(Window.orderBy("_pid")) - F.col("_sum")).alias("_off"))
    inside = F.sum("_v").over(Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return (ranged.withColumn("_in", inside - F.col("_v")).join(offsets, "_pid")
            .withColumn(out, F.col("_off") + F.col("_in")).drop("_pid", "_v", "_off", "_in"))


def connected_components(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node: alternating large-star and small-star rounds.

    ``edges`` has long columns ``u`` and ``v``.  Each round is a grouped minimum (combined
    map-side) joined back on the node, where a hot node is split by AQE; edges never grow
    beyond their first count.  Returns ``node, root`` for nodes that have an edge.
    """
    def larger_first(e: DataFrame) -> DataFrame:
        return (e.where(F.col("u") != F.col("v"))
                .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def signature(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    cur = stored(larger_first(edges), name)
    nodes = stored(cur.select(F.col("u").alias("node")).union(cur.select(F.col("v").alias("node"))).distinct(),
                   f"{name}-nodes")
    sig = signature(cur)
    for i in range(max_rounds):
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = stored(larger_first(large), f"{name}-large{i}")
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        small = (star.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))))
        cur = stored(larger_first(small), f"{name}-small{i}")
        new = signature(cur)
        if new == sig:
            break
        sig = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(cur, nodes["node"] == cur["u"], "left").select(
        "node", F.coalesce(cur["v"], nodes["node"]).alias("root"))


#: Spans of more bytes than this are hashed one by one.
LONG_SPAN = 256
_MULTIPLIERS = tuple(np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of the spans of a byte array.

    Eight bytes at a time go into a state that is scrambled after each step (shifts and products, so no
    algebraic identity of the bytes makes two spans equal); spans of more than ``LONG_SPAN`` bytes are left to
    xxhash.  Two of n different spans meet with a chance of about n**2 / 2**65."""
    import xxhash
    size = end - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    first, second, third = _MULTIPLIERS
    with np.errstate(over="ignore"):
        h = (size.astype(np.uint64) + np.uint64(seed) * second) * first
        active, at = np.flatnonzero((size > 0) & (size <= LONG_SPAN)), 0
        while len(active):
            left = size[active] - at
            word = words[start[active] + at]
            part = left < 8
            word[part] &= (np.uint64(1) << (np.uint64(8) * left[part].astype(np.uint64))) - np.uint64(1)
            x = (h[active] ^ word) * second
            x = (x ^ (x >> np.uint64(32))) * third
            h[active] = x ^ (x >> np.uint64(29))
            active, at = active[left > 8], at + 8
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        h[i] = xxhash.xxh64_intdigest(data[start[i]:end[i]].tobytes(), seed)
    return h
