"""Whole runs over sample files in every format and layout; answers from the brute force."""

import pytest
from pyspark.sql import functions as F

from infosieve import ArrayInstances, FeatureWise, MapInstances, select_features
from infosieve.sources import (read_class_vector, read_features_libsvm, read_features_text, read_instances_text,
                               read_libsvm, read_libsvm_ids)

import samples
from bruteforce import select

X, Y = samples.table()
SCORED = [j for j in range(X.shape[1]) if X[:, j].any()]
G1 = select(X, Y, 10, candidates=SCORED)
G2 = select(X, Y, 10, score="maxrel", candidates=SCORED)
G3 = select(X, Y, 10)            # feature-wise: the all-zero feature stays a candidate


def _approx(df, want):
    got = [(int(r["feature"]), r["score"]) for r in df.orderBy("rank").collect()]
    assert [f for f, _ in got] == [f for f, _ in want]
    for (_, a), (_, b) in zip(got, want):
        assert a == pytest.approx(b, abs=1e-9)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("samples")
    return {"cw": samples.csv_rows(d / "cw.csv", Y, X), "cw_svm": samples.libsvm_rows(d / "cw.libsvm", Y, X, "# made for a test\n"),
            "rw": samples.csv_rows(d / "rw.csv", range(20), X.T, end="\r\n"),
            "rw_svm": samples.libsvm_rows(d / "rw.libsvm", range(20), X.T), "cl": samples.class_line(d / "class.csv", Y)}


@pytest.fixture(scope="module")
def cw_csv(spark, files):
    return read_instances_text(spark, files["cw"])


def test_g1_mrmr_csv(spark, cw_csv):
    _approx(select_features(ArrayInstances(cw_csv, "label", "features"), 10, "mrmr"), G1)


def test_g1_mrmr_libsvm(spark, files):
    df = read_libsvm(spark, files["cw_svm"])
    _approx(select_features(MapInstances(df, "label", "features"), 10, "mrmr"), G1)


def test_g2_max_relevance(spark, cw_csv):
    _approx(select_features(ArrayInstances(cw_csv, "label", "features"), 10, "maxrel"), G2)


def test_ties_go_to_the_smaller_feature(spark):
    twin = X.copy()
    twin[:, 3] = twin[:, 9] = twin[:, 5]
    rows = [(float(Y[i]), [float(v) for v in twin[i]]) for i in range(len(Y))]
    df = spark.createDataFrame(rows, "y double, x array<double>")
    _approx(select_features(ArrayInstances(df, "y", "x"), 10, "maxrel"),
            select(twin, Y, 10, score="maxrel", candidates=SCORED))


def test_g1_through_feature_wise_layout(spark, cw_csv):
    """The transposed instance table must give the same picks and scores (M2 == M1)."""
    rows = cw_csv.coalesce(1).withColumn("pos", F.monotonically_increasing_id())
    cells = rows.select("pos", F.posexplode("features").alias("feature", "value"))
    classes = rows.select("pos", F.col("label").alias("b"))
    _approx(select_features(FeatureWise.from_cells(cells, classes), 10, "mrmr"), G1)


def test_g3_feature_wise_csv(spark, files):
    fw = read_features_text(spark, files["rw"], id_type="long")
    cl = read_class_vector(spark, files["cl"]).withColumnRenamed("label", "b")
    _approx(select_features(FeatureWise.from_arrays(fw, "feature", "values", cl), 10, "mrmr", all_zero="keep"), G3)


def test_g3_feature_wise_libsvm(spark, files):
    cells, ids = read_features_libsvm(spark, files["rw_svm"]), read_libsvm_ids(spark, files["rw_svm"])
    cl = read_class_vector(spark, files["cl"]).withColumnRenamed("label", "b")
    _approx(select_features(FeatureWise.from_cells(cells, cl, ids=ids), 10, "mrmr", all_zero="keep"), G3)


def test_class_vector_with_crlf_and_nine_levels(spark, tmp_path):
    want = [1 + i * i % 9 for i in range(60)]
    cl = read_class_vector(spark, samples.class_line(tmp_path / "nine.csv", want, end="\r\n"))
    assert [(r["pos"], r["label"]) for r in cl.orderBy("pos").collect()] == [(i, float(v)) for i, v in enumerate(want)]


def test_class_vector_of_two_lines_raises(spark, tmp_path):
    path = tmp_path / "two.csv"
    path.write_text("1,0,1\n0,0,1\n")
    with pytest.raises(ValueError, match="one line"):
        read_class_vector(spark, str(path))
