"""Between instance rows and feature rows.

Both directions go through the long form ``(feature, pos, value)``: no row ever holds more
than one value and no group gathers a vector, so the number of instances has no bound.  The
text forms are position-tagged lines; they are range-partitioned by feature and position
and sorted inside each file, so reading the files in order gives the vectors in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cells import col_of


def transpose_long(df: DataFrame, pos: str, array_col: str, keep_zeros: bool = True) -> DataFrame:
    """Instance rows with an ARRAY column -> ``(feature, pos, value)``."""
    out = df.select(col_of(pos).alias("pos"), F.posexplode(col_of(array_col).cast("array<double>")).alias("feature", "value"))
    out = out.select("feature", "pos", "value")
    return out if keep_zeros else out.where(F.col("value") != 0.0)


def number_text(c: Column) -> Column:
    """Doubles holding whole numbers print without a fraction."""
    return F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))


def value_text(df: DataFrame, column: str) -> Column:
    """A value as text; numbers by ``number_text``."""
    numeric = isinstance(df.schema[column].dataType, T.NumericType)
    return number_text(col_of(column).cast("double")) if numeric else col_of(column).cast("string")


def cell_lines(long: DataFrame, sep: str = ",") -> DataFrame:
    """``(feature, pos, line)``: one tagged line ``feature, pos, value`` per cell, in order."""
    line = F.concat_ws(sep, F.col("feature").cast("string"), F.col("pos").cast("string"), value_text(long, "value"))
    return (long.select("feature", "pos", line.alias("line")).repartitionByRange("feature", "pos")
            .sortWithinPartitions("feature", "pos"))


def class_lines(classes: DataFrame, pos: str = "pos", label: str = "label", sep: str = ",") -> DataFrame:
    """The class vector as text, ``(pos, line)`` with one tagged line ``pos, label`` per
    position, in position order."""
    line = F.concat_ws(sep, col_of(pos).cast("string"), value_text(classes, label))
    return (classes.select(col_of(pos).alias("pos"), line.alias("line")).repartitionByRange("pos")
            .sortWithinPartitions("pos"))
