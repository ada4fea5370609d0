"""M8: the selection job.

    spark-submit run_job.py INPUT LAYOUT K FORMAT LABEL_INDEX SCORE [CLASS_FILE] [--out DIR]

LAYOUT is ``column-wise`` / ``instance-wise`` (one row per instance) or ``row-wise`` /
``feature-wise`` (one row per feature; CLASS_FILE holds the class vector on one line or as
``pos, label`` lines).  FORMAT is ``csv``, ``tsv`` or ``libsvm`` (LibSVM has a fixed label position, so
LABEL_INDEX is read but not used for it).  SCORE is a registered score name.  The job prints
the dataset profile and the ranked features; ``--out`` also writes the report as CSV.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..operators.cells import ArrayInstances, FeatureWise, MapInstances
from ..operators.selection import select_features
from ..operators.stats import profile, profile_cells
from ..session import ensure_checkpoint_dir
from .report import format_report, selection_report

INSTANCE = {"column-wise", "instance-wise"}
FEATURE = {"row-wise", "feature-wise"}
FORMATS = {"csv", "tsv", "libsvm"}


def build_layout(spark: SparkSession, path: str, layout: str, fmt: str, label_index: int,
                 class_path: str | None, num_features: int | None = None):
    """Returns ``(layout object, profile DataFrame)``."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; use one of {sorted(FORMATS)}")
    if layout in INSTANCE:
        if fmt == "libsvm":
            df = sources.read_libsvm(spark, path, num_features)
            return MapInstances(df, "label", "features", width=num_features), profile(df, "features", num_features)
        df = sources.read_instances_text(spark, path, sep=fmt, label_index=label_index)
        return ArrayInstances(df, "label", "features"), profile(df, "features")
    if layout in FEATURE:
        if not class_path:
            raise ValueError("the feature-wise layout needs the class vector file")
        classes = sources.read_classes(spark, class_path, sep="," if fmt == "libsvm" else fmt)
        classes = classes.select("pos", F.col("label").alias("b"))
        if fmt == "libsvm":
            cells = sources.read_features_libsvm(spark, path)
            ids = sources.read_libsvm_ids(spark, path)
            return FeatureWise.from_cells(cells, classes, ids=ids), profile_cells(cells, ids, classes.count())
        df = sources.read_features_text(spark, path, sep=fmt, id_index=label_index, id_type="double")
        df = df.select(F.col("feature").cast("long").alias("feature"), "values")
        return FeatureWise.from_arrays(df, "feature", "values", classes), profile(df, "values")
    raise ValueError(f"unknown layout {layout!r}; use column-wise or row-wise")


def report_for(spark: SparkSession, path: str, layout: str, k: int, fmt: str, label_index: int, score: str,
               class_path: str | None = None, num_features: int | None = None):
    """The job's work without printing: ``(report DataFrame (order, name, score), profile)``."""
    ensure_checkpoint_dir(spark)
    lay, prof = build_layout(spark, path, layout, fmt, label_index, class_path, num_features)
    result = select_features(lay, k, score, all_zero="keep" if layout in FEATURE else "drop")
    return selection_report(result), prof


def run(argv: list[str], spark: SparkSession | None = None) -> list:
    ap = argparse.ArgumentParser(prog="infosieve-job")
    ap.add_argument("input")
    ap.add_argument("layout")
    ap.add_argument("k", type=int)
    ap.add_argument("format")
    ap.add_argument("label_index", type=int)
    ap.add_argument("score")
    ap.add_argument("class_file", nargs="?")
    ap.add_argument("--out")
    ap.add_argument("--num-features", type=int, help="declared width of instance-wise LibSVM")
    a = ap.parse_args(argv)
    spark = spark or SparkSession.builder.appName("infosieve-job").getOrCreate()
    report, prof = report_for(spark, a.input, a.layout, a.k, a.format, a.label_index, a.score, a.class_file,
                              a.num_features)
    p = prof.first().asDict()
    print("Data read")
    for k_, v in p.items():
        print(f"{k_} = {v}")
    report = report.orderBy("order")
    rows = report.collect()
    print(format_report(rows))
    if a.out:
        report.coalesce(1).write.mode("overwrite").option("header", "true").csv(a.out)
    return rows


if __name__ == "__main__":
    run(sys.argv[1:])
