"""Reduce a table to the selected features, in selection order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import col_of


def reduce_to(df: DataFrame, selected: list, keep: list[str] | None = None, array_col: str | None = None,
              map_col: str | None = None, names: list[str] | None = None) -> DataFrame:
    """Project ``keep`` columns plus one column per selected feature (selection order).

    Wide input selects the columns themselves; ARRAY input picks positions; MAP input looks
    the ids up (absent = 0).  Output names default to the feature ids."""
    keep = list(keep or [])
    names = names or [str(s) for s in selected]
    if array_col:
        cols = [col_of(array_col)[int(s)].alias(n) for s, n in zip(selected, names)]
    elif map_col:
        cols = [F.coalesce(col_of(map_col)[F.lit(s)], F.lit(0.0)).alias(n) for s, n in zip(selected, names)]
    else:
        cols = [col_of(str(s)).alias(n) for s, n in zip(selected, names)]
    return df.select(*[col_of(c).alias(c) for c in keep], *cols)


def reduce_to_array(df: DataFrame, selected: list, keep: list[str], array_col: str, out: str = "features") -> DataFrame:
    """The selected positions of an ARRAY column as a new ARRAY, in selection order."""
    return df.select(*[col_of(c).alias(c) for c in keep], F.array(*[col_of(array_col)[int(s)] for s in selected]).alias(out))
