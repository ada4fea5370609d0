"""Seeded random tables: Spark selection == brute force, whatever the layout or partitioning."""

import numpy as np
from hypothesis import given, settings, strategies as st
import pytest
from pyspark.sql import functions as F

from infosieve import ArrayInstances, FeatureWise, MapInstances, WideInstances, select_features

from bruteforce import select


def _table(seed, n=60, d=6, levels=(0, 0, 1, 2)):
    rng = np.random.default_rng(seed)
    X = rng.choice(levels, size=(n, d))
    y = (X[:, 0] + rng.integers(0, 2, n)) % 3
    return X, y


def _check(got, want):
    assert [int(r["feature"]) if not isinstance(r["feature"], str) else r["feature"] for r in got] == [f for f, _ in want]
    for r, (_, s) in zip(got, want):
        assert r["score"] == pytest.approx(s, abs=1e-9)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_array_layout_matches_bruteforce(spark, seed):
    X, y = _table(seed)
    rows = [(float(y[i]), [float(v) for v in X[i]]) for i in range(len(y))]
    df = spark.createDataFrame(rows, "label double, x array<double>")
    got = select_features(ArrayInstances(df, "label", "x"), 4, "mrmr").orderBy("rank").collect()
    _check(got, select(X, y, 4))


def test_map_layout_and_partitioning_do_not_change_results(spark):
    X, y = _table(7, n=80, d=8)
    want = select(X, y, 5)
    rows = [(float(y[i]), {j: float(v) for j, v in enumerate(X[i]) if v != 0}) for i in range(len(y))]
    for parts in (1, 3, 7):
        df = spark.createDataFrame(rows, "label double, m map<int, double>").repartition(parts)
        got = select_features(MapInstances(df, "label", "m"), 5, "mrmr").orderBy("rank").collect()
        _check(got, want)


def test_row_order_does_not_change_results(spark):
    X, y = _table(11)
    rows = [(float(y[i]),) + tuple(float(v) for v in X[i]) for i in range(len(y))]
    cols = "y double, " + ", ".join(f"f{j} double" for j in range(X.shape[1]))
    a = select_features(WideInstances(spark.createDataFrame(rows, cols), "y"), 3, "mrmr").collect()
    b = select_features(WideInstances(spark.createDataFrame(rows[::-1], cols), "y"), 3, "mrmr").collect()
    assert [(r["feature"], round(r["score"], 12)) for r in a] == [(r["feature"], round(r["score"], 12)) for r in b]


def test_feature_wise_equals_instance_wise(spark):
    X, y = _table(5, n=40, d=7)
    cells = spark.createDataFrame([(j, i, float(X[i, j])) for i in range(X.shape[0]) for j in range(X.shape[1])],
                                  "feature int, pos long, value double")
    classes = spark.createDataFrame([(i, float(y[i])) for i in range(len(y))], "pos long, b double")
    got = select_features(FeatureWise.from_cells(cells, classes), 4, "mrmr").orderBy("rank").collect()
    _check(got, select(X, y, 4))


def test_max_relevance_matches_bruteforce(spark):
    X, y = _table(9, d=9)
    rows = [(float(y[i]), [float(v) for v in X[i]]) for i in range(len(y))]
    df = spark.createDataFrame(rows, "label double, x array<double>")
    got = select_features(ArrayInstances(df, "label", "x"), 5, "maxrel").orderBy("rank").collect()
    _check(got, select(X, y, 5, score="maxrel"))


@pytest.mark.parametrize("seed", [13, 14])
def test_support_only_pairing_equals_full_pass(spark, seed):
    rng = np.random.default_rng(seed)
    n, d = 90, 8
    X = rng.choice([0, 0, 0, 0, 1, 3], size=(n, d))
    y = (X[:, 2] > 0).astype(int) + rng.integers(0, 2, n)
    rows = [(float(y[i]), {j: float(v) for j, v in enumerate(X[i]) if v != 0}) for i in range(n)]
    df = spark.createDataFrame(rows, "label double, m map<int, double>")
    a = select_features(MapInstances(df, "label", "m"), 5, "mrmr", sparse_winners=True).orderBy("rank").collect()
    b = select_features(MapInstances(df, "label", "m"), 5, "mrmr", sparse_winners=False).orderBy("rank").collect()
    _check(a, select(X, y, 5))
    _check(b, select(X, y, 5))
    cells = spark.createDataFrame([(j, i, float(X[i, j])) for i in range(n) for j in range(d)],
                                  "feature int, pos long, value double")
    classes = spark.createDataFrame([(i, float(y[i])) for i in range(n)], "pos long, b double")
    c = select_features(FeatureWise.from_cells(cells, classes), 5, "mrmr", sparse_winners=True).orderBy("rank").collect()
    _check(c, select(X, y, 5))


def test_hashed_string_keys_give_the_same_selection(spark):
    rng = np.random.default_rng(17)
    n, d = 70, 9
    X = rng.choice([0, 0, 1, 2], size=(n, d))
    y = (X[:, 3] + rng.integers(0, 2, n)) % 3
    rows = [(float(y[i]), {f"tok{j}": float(v) for j, v in enumerate(X[i]) if v != 0}) for i in range(n)]
    df = spark.createDataFrame(rows, "label double, m map<string, double>")
    a = select_features(MapInstances(df, "label", "m", hash_keys=True), 4, "mrmr").orderBy("rank").collect()
    b = select_features(MapInstances(df, "label", "m"), 4, "mrmr").orderBy("rank").collect()
    assert [(r["feature"], round(r["score"], 12)) for r in a] == [(r["feature"], round(r["score"], 12)) for r in b]
    assert [r["feature"] for r in b] == [f"tok{f}" for f, _ in select(X, y, 4)]


def test_id_like_feature_with_many_levels(spark):
    rng = np.random.default_rng(23)
    n, d = 80, 7
    X = rng.choice([0, 0, 1, 2, 3], size=(n, d))
    X[:, 0] = np.arange(n) % 37
    y = (X[:, 2] + rng.integers(0, 2, n)) % 3
    rows = [(float(y[i]), [float(v) for v in X[i]]) for i in range(n)]
    df = spark.createDataFrame(rows, "label double, x array<double>")
    _check(select_features(ArrayInstances(df, "label", "x"), 4, "mrmr").orderBy("rank").collect(), select(X, y, 4))


@settings(max_examples=6, deadline=None)
@given(st.integers(min_value=0, max_value=10_000), st.sampled_from([1, 2]))
def test_random_tables_any_plan(spark, seed, per_iter):
    """Random shapes through the automatic plan choices must equal brute force."""
    rng = np.random.default_rng(seed)
    n, d = int(rng.integers(20, 60)), int(rng.integers(3, 7))
    X = rng.choice([0, 0, 1, 2, 4], size=(n, d))
    y = rng.integers(0, int(rng.integers(2, 5)), size=n)
    rows = [(str(y[i]), {j: float(v) for j, v in enumerate(X[i]) if v != 0}) for i in range(n)]
    df = spark.createDataFrame(rows, "label string, m map<int, double>")

    def fn(rel, red, n_sel, i, nfs):
        return rel["mi"] - F.lit(1.0 if n_sel <= 1 else 1.0 / n_sel) * red["mi"]
    from infosieve import ExprScore
    got = select_features(MapInstances(df, "label", "m"), 3, ExprScore(fn, select_top=per_iter)).orderBy("rank").collect()
    cols = [j for j in range(d) if X[:, j].any()]
    want = select(X, [str(v) for v in y], 3, per_iter=per_iter, candidates=cols)
    _check(got, want)


def test_zero_row_pairing_equals_full_pass(spark):
    """Dense binary winners paired on their zero rows only (the non-zero level recovered)."""
    rng = np.random.default_rng(31)
    n, d = 90, 8
    X = (rng.random((n, d)) < 0.7).astype(int)          # dense binary features
    y = (X[:, 1] + rng.integers(0, 2, n)) % 2
    rows = [(float(y[i]), {j: float(v) for j, v in enumerate(X[i]) if v != 0}) for i in range(n)]
    df = spark.createDataFrame(rows, "label double, m map<int, double>")
    got = select_features(MapInstances(df, "label", "m"), 5, "mrmr", sparse_winners="zero_rows")
    _check(got.orderBy("rank").collect(), select(X, y, 5))
    cells = spark.createDataFrame([(j, i, float(X[i, j])) for i in range(n) for j in range(d)],
                                  "feature int, pos long, value double")
    classes = spark.createDataFrame([(i, float(y[i])) for i in range(n)], "pos long, b double")
    got = select_features(FeatureWise.from_cells(cells, classes), 5, "mrmr", sparse_winners="zero_rows")
    _check(got.orderBy("rank").collect(), select(X, y, 5))


def test_feature_wise_without_broadcast_equals_bruteforce(spark):
    """Position vectors above the broadcast bound: cells co-partitioned by position, shuffled
    hash joins for the class and winner vectors."""
    X, y = _table(19, n=50, d=6)
    cells = spark.createDataFrame([(j, i, float(X[i, j])) for i in range(X.shape[0]) for j in range(X.shape[1])],
                                  "feature int, pos long, value double")
    classes = spark.createDataFrame([(i, float(y[i])) for i in range(len(y))], "pos long, b double")
    got = select_features(FeatureWise.from_cells(cells, classes), 4, "mrmr", broadcast_rows=5).orderBy("rank").collect()
    _check(got, select(X, y, 4))


def test_max_relevance_feature_wise_equals_instance_wise(spark):
    X, y = _table(29, n=60, d=8)
    cells = spark.createDataFrame([(j, i, float(X[i, j])) for i in range(X.shape[0]) for j in range(X.shape[1])],
                                  "feature int, pos long, value double")
    classes = spark.createDataFrame([(i, float(y[i])) for i in range(len(y))], "pos long, b double")
    got = select_features(FeatureWise.from_cells(cells, classes), 5, "maxrel").orderBy("rank").collect()
    _check(got, select(X, y, 5, score="maxrel"))
