"""The selection report and the dataset profile as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.format import score_text


def selection_report(result: DataFrame, decimals: int = 3) -> DataFrame:
    """``(order, name, score)`` with the score printed to ``decimals`` places."""
    return result.select(F.col("rank").alias("order"), F.col("feature").cast("string").alias("name"),
                         score_text(F.col("score"), decimals).alias("score"))


def format_report(rows) -> str:
    lines = ["Features by rank", "rank\tfeature\tscore"]
    lines += [f"{r['order']}\t{r['name']}\t{r['score']}" for r in rows]
    return "\n".join(lines)
