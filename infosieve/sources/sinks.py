"""Text sinks: delimited rows, LibSVM rows, feature-wise rows, position-tagged cells and classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cells import col_of
from ..operators.transpose import cell_lines, class_lines, number_text


def write_instances_text(df: DataFrame, path: str, label: str, features: str, sep: str = ",",
                         mode: str = "overwrite") -> None:
    """``label, f0, f1, ...`` per row from a label column and a feature ARRAY column."""
    line = F.concat_ws(sep, number_text(col_of(label).cast("double")),
                       F.array_join(F.transform(col_of(features).cast("array<double>"), number_text), sep))
    df.select(line.alias("value")).write.mode(mode).text(path)


def write_features_text(df: DataFrame, path: str, feature: str, values: str, sep: str = ",",
                        mode: str = "overwrite") -> None:
    """Feature-wise rows: ``id, v0, v1, ...``."""
    line = F.concat_ws(sep, col_of(feature).cast("string"),
                       F.array_join(F.transform(col_of(values).cast("array<double>"), number_text), sep))
    df.select(line.alias("value")).write.mode(mode).text(path)


def write_libsvm(df: DataFrame, path: str, label: str, features: str, mode: str = "overwrite") -> None:
    """LibSVM rows from a label and an ARRAY (dense, 0-based) or MAP<int, double> column;
    only non-zero cells are written, indices 1-based and ascending."""
    dt = df.schema[features].dataType.simpleString()
    if dt.startswith("map"):
        entries = F.map_entries(col_of(features))
        ent = F.transform(entries, lambda e: F.named_struct(F.lit("k"), e["key"].cast("int"),
                                                            F.lit("v"), e["value"].cast("double")))
    else:
        ent = F.transform(col_of(features).cast("array<double>"),
                          lambda x, i: F.named_struct(F.lit("k"), i, F.lit("v"), x))
    ent = F.array_sort(F.filter(ent, lambda e: e["v"] != 0.0))
    toks = F.transform(ent, lambda e: F.concat((e["k"] + 1).cast("string"), F.lit(":"), number_text(e["v"])))
    line = F.concat_ws(" ", number_text(col_of(label).cast("double")), F.array_join(toks, " "))
    df.select(F.rtrim(line).alias("value")).write.mode(mode).text(path)


#: Positions of one line of feature-wise LibSVM.
LINE_POSITIONS = 1000


def write_features_libsvm(long: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Feature-wise LibSVM (label = feature id) from cells ``(feature, pos, value)``: a line per feature and
    ``LINE_POSITIONS`` positions, in order, so that no line grows with the data; features without a
    non-zero cell get a line of their id alone."""
    runs = (long.groupBy("feature", F.floor(F.col("pos") / LINE_POSITIONS).alias("run"))
            .agg(F.array_sort(F.collect_list(F.when(F.col("value") != 0, F.struct(
                F.col("pos"), F.col("value").cast("double").alias("value"))))).alias("cells")))
    toks = F.transform("cells", lambda c: F.concat((c["pos"] + 1).cast("string"), F.lit(":"), number_text(c["value"])))
    line = F.rtrim(F.concat_ws(" ", F.col("feature").cast("string"), F.array_join(toks, " ")))
    (runs.where((F.size("cells") > 0) | (F.col("run") == 0)).select("feature", "run", line.alias("value"))
     .repartitionByRange("feature", "run").sortWithinPartitions("feature", "run").select("value").write.mode(mode).text(path))


def write_cells_text(long: DataFrame, path: str, sep: str = ",", mode: str = "overwrite") -> None:
    """Feature-wise cells ``(feature, pos, value)`` as tagged lines ``feature, pos, value``."""
    cell_lines(long, sep).select(F.col("line").alias("value")).write.mode(mode).text(path)


def write_class_vector(classes: DataFrame, path: str, pos: str = "pos", label: str = "label",
                       sep: str = ",", mode: str = "overwrite") -> None:
    """The class vector as tagged lines ``pos, label`` (A14), whatever its length."""
    class_lines(classes, pos, label, sep).select(F.col("line").alias("value")).write.mode(mode).text(path)
