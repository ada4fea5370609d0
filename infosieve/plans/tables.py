"""Selection inputs derived from the driver tables (TESTDATA.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINEITEM_FEATURES = ["linenumber", "quantity", "discount", "tax", "status", "ship_year", "ship_month"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lineitem_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven discrete features of every line item, class ``l_returnflag`` (3 levels)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("label"),
        F.col("l_linenumber").cast("int").alias("linenumber"),
        F.floor("l_quantity").cast("int").alias("quantity"),
        F.round(F.col("l_discount") * 100).cast("int").alias("discount"),
        F.round(F.col("l_tax") * 100).cast("int").alias("tax"),
        F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("status"),
        F.year("l_shipdate").alias("ship_year"),
        F.month("l_shipdate").alias("ship_month"),
    )


def embedding_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vec_id, label, bits ARRAY<DOUBLE>)``: the sign bit of each of the 64 dimensions."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label",
                    F.transform("embedding", lambda x: F.when(x > 0, 1.0).otherwise(0.0)).alias("bits"))


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as sparse token-presence rows ``(doc_id, quality, toxic, tokens MAP)``;
    tokens are the distinct space-separated words of the lower-cased whole text."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    toks = F.array_distinct(F.split(F.lower("text"), " "))
    return (d.join(lab, "doc_id")
            .select("doc_id", "quality", "toxic",
                    F.map_from_arrays(toks, F.array_repeat(F.lit(1.0), F.size(toks))).alias("tokens")))
