"""Text input formats.

* delimited instance-wise rows (CSV, TSV, unquoted numbers): the label sits at
  ``label_index``, every other field is a feature, named by its 0-based position after the
  label is removed;
* delimited feature-wise rows: the field at ``id_index`` is the feature id, the others are
  the feature's values in instance order;
* LibSVM (``label idx:value ...``, 1-based indices, zeros absent, ``#`` starts a comment),
  either layout;
* the class vector of the feature-wise layout: one line of labels, or position-tagged
  lines ``pos, label``; feature-wise cells as tagged lines ``feature, pos, value``.

Parsing is ``split``/``transform`` expressions on the text lines, so it runs in the scan
tasks and does not depend on the width; sparse LibSVM rows stay sparse (a MAP of the
stored cells).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SEPS = {"csv": ",", "tsv": "\t"}


def _sep(fmt_or_sep: str) -> str:
    return _SEPS.get(fmt_or_sep, fmt_or_sep)


def _tokens(spark: SparkSession, path: str, sep: str):
    """Non-empty lines split on ``sep`` (CR/LF tolerant): one ARRAY<STRING> per line.  Any
    width parses with one expression, so very wide files need no per-column schema."""
    line = F.regexp_replace("value", "\r$", "")
    return (spark.read.text(path).where(F.length(F.trim(line)) > 0)
            .select(F.split(line, _re(sep)).alias("t")))


def _all_but(t, index: int):
    """The tokens of ``t`` except position ``index`` (0-based), in order."""
    return F.concat(F.slice(t, 1, index), F.slice(t, index + 2, F.greatest(F.size(t) - index - 1, F.lit(0))))


def read_instances_text(spark: SparkSession, path: str, sep: str = ",", label_index: int = 0) -> DataFrame:
    """``(label DOUBLE, features ARRAY<DOUBLE>)``.  Ragged rows are rejected by the layouts'
    width check; a non-numeric field fails the cast (ANSI mode)."""
    sep = _sep(sep)
    if label_index < 0:
        raise ValueError("label index must be >= 0")
    t = _tokens(spark, path, sep)
    return t.select(F.trim(t["t"][label_index]).cast("double").alias("label"),
                    F.transform(_all_but(F.col("t"), label_index), lambda x: F.trim(x).cast("double"))
                    .alias("features"))


def read_features_text(spark: SparkSession, path: str, sep: str = ",", id_index: int = 0,
                       id_type: str = "string") -> DataFrame:
    """``(feature, values ARRAY<DOUBLE>)`` from feature-wise delimited rows."""
    sep = _sep(sep)
    t = _tokens(spark, path, sep)
    return t.select(F.trim(t["t"][id_index]).cast(id_type).alias("feature"),
                    F.transform(_all_but(F.col("t"), id_index), lambda x: F.trim(x).cast("double"))
                    .alias("values"))


def read_class_vector(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """``(pos LONG, label DOUBLE)`` from a file of one line of labels (CR/LF tolerant).

    A second line with text raises an error: labels must not get lost.
    """
    t = _tokens(spark, path, _sep(sep))
    lines = t.limit(2).count()
    if lines != 1:
        raise ValueError(f"a class vector is one line of labels; {path} has {'more lines' if lines else 'none'} "
                         "(tagged lines are read by read_class_positions)")
    return (t.select(F.posexplode("t").alias("pos", "v"))
            .select(F.col("pos").cast("long").alias("pos"), F.trim("v").cast("double").alias("label")))


def read_class_positions(spark: SparkSession, path: str, sep: str = ",", label_type: str = "double") -> DataFrame:
    """``(pos LONG, label)`` from position-tagged lines, in any number of files."""
    t = F.col("t")
    return _tokens(spark, path, _sep(sep)).select(F.trim(t[0]).cast("long").alias("pos"),
                                                  F.trim(t[1]).cast(label_type).alias("label"))


def read_classes(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """``(pos, label)`` of either class format: one line of labels, else tagged lines of two fields."""
    lines = _tokens(spark, path, _sep(sep)).select(F.size("t").alias("n"))
    r = lines.agg(F.count(F.lit(1)).alias("lines"), F.min("n").alias("lo"), F.max("n").alias("hi")).first()
    if r["lines"] == 1:
        return read_class_vector(spark, path, sep)
    if (r["lo"], r["hi"]) != (2, 2):
        raise ValueError(f"{path} holds neither one line of labels nor tagged lines of two fields")
    return read_class_positions(spark, path, sep)


def read_cells_text(spark: SparkSession, path: str, sep: str = ",", id_type: str = "string",
                    value_type: str = "double") -> DataFrame:
    """``(feature, pos, value)`` from tagged lines, in any number of files."""
    t = F.col("t")
    return _tokens(spark, path, _sep(sep)).select(F.trim(t[0]).cast(id_type).alias("feature"),
                                                  F.trim(t[1]).cast("long").alias("pos"),
                                                  F.trim(t[2]).cast(value_type).alias("value"))


def _re(sep: str) -> str:
    return "\\t" if sep == "\t" else "\\" + sep if sep in ".|^$*+?()[]{}\\" else sep


def _libsvm_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with data; comments (from ``#`` on) are cut."""
    line = F.trim(F.regexp_replace("value", "#.*", ""))
    return spark.read.text(path).select(line.alias("value")).where(F.length("value") > 0)


def _libsvm_cells(width: int | None = None):
    """Label and ``idx:value`` entries; indices must be one-based (a 0 or negative index
    fails the scan), repeated indices in a row fail the map construction."""
    toks = F.split(F.trim(F.col("value")), "\\s+")

    def entry(t):
        idx = F.split(t, ":")[0].cast("int")
        key = F.when(idx < 1, F.raise_error(F.lit("LibSVM indices are one-based")))
        if width is not None:
            key = key.when(idx > width, F.raise_error(F.lit(f"LibSVM index beyond the declared {width} features")))
        key = key.otherwise(idx - 1)
        return F.named_struct(F.lit("key"), key.cast("int"), F.lit("value"), F.split(t, ":")[1].cast("double"))
    entries = F.transform(F.slice(toks, 2, F.greatest(F.size(toks) - 1, F.lit(0))), entry)
    return toks[0].cast("double"), entries


def read_libsvm(spark: SparkSession, path: str, num_features: int | None = None) -> DataFrame:
    """Instance-wise LibSVM: ``(label DOUBLE, features MAP<INT, DOUBLE>)``, keys 0-based.

    With ``num_features``, the declared width, an index beyond it fails the scan; ``MapInstances(...,
    width=num_features)`` and ``profile(..., width=num_features)`` then know the trailing features that
    are zero everywhere, too."""
    label, entries = _libsvm_cells(num_features)
    return (_libsvm_lines(spark, path)
            .select(label.alias("label"), F.map_from_entries(entries).alias("features")))


def read_features_libsvm(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """Feature-wise LibSVM (label = feature id): long cells ``(feature, pos, value)``."""
    label, entries = _libsvm_cells()
    return (_libsvm_lines(spark, path)
            .select(label.cast(id_type).alias("feature"), F.inline(entries))
            .select("feature", F.col("key").cast("long").alias("pos"), "value"))


def read_libsvm_ids(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """The feature ids of feature-wise LibSVM, those of all-zero features included; a feature may
    be continued on further lines."""
    label, _ = _libsvm_cells()
    return _libsvm_lines(spark, path).select(label.cast(id_type).alias("feature")).distinct()
