import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from infosieve import ArrayInstances, ExprScore, FeatureWise, MIQ, VectorAgg, select_features
from infosieve.operators.scores import CellTerm, chi2_term, symmetric_uncertainty_mrmr

from bruteforce import mi, select


def _data(spark, seed=4, n=70, d=6):
    rng = np.random.default_rng(seed)
    X = rng.choice([0, 0, 1, 2], size=(n, d))
    y = (X[:, 1] * 2 + rng.integers(0, 2, n)) % 4
    rows = [(float(y[i]), [float(v) for v in X[i]]) for i in range(n)]
    return X, y, spark.createDataFrame(rows, "label double, x array<double>")


def test_miq_quotient(spark):
    X, y, df = _data(spark)

    def q(rel, red, n):
        if n == 0:
            return rel
        return rel / (red / n) if red / n > 0 else float("inf")
    got = select_features(ArrayInstances(df, "label", "x"), 3, MIQ()).orderBy("rank").collect()
    want = select(X, y, 3, score=q)
    assert [r["feature"] for r in got] == [f for f, _ in want]


def test_batch_policy_two_per_iteration(spark):
    X, y, df = _data(spark, seed=8)

    def fn(rel, red, n_sel, i, nfs):
        return rel["mi"] - F.lit(1.0 if n_sel <= 1 else 1.0 / n_sel) * red["mi"]
    got = select_features(ArrayInstances(df, "label", "x"), 4, ExprScore(fn, select_top=2)).orderBy("rank").collect()
    want = select(X, y, 4, per_iter=2)
    assert [r["feature"] for r in got] == [f for f, _ in want]
    for r, (_, s) in zip(got, want):
        assert r["score"] == pytest.approx(s, abs=1e-9)


def _entropy(v):
    n = len(v)
    _, c = np.unique(v, return_counts=True)
    return -sum(x / n * math.log2(x / n) for x in c)


def test_symmetric_uncertainty_table_score(spark):
    X, y, df = _data(spark, seed=12)

    def su(a, b):
        h = _entropy(a) + _entropy(b)
        return 2 * mi(a, b) / h if h > 0 else 0.0
    got = select_features(ArrayInstances(df, "label", "x"), 3, symmetric_uncertainty_mrmr()).orderBy("rank").collect()
    chosen, red = [], {f: 0.0 for f in range(X.shape[1])}
    for it in range(3):
        n = len(chosen)
        coef = 1.0 if n <= 1 else 1.0 / n
        sc = {f: su(X[:, f], y) - coef * red[f] for f in range(X.shape[1]) if f not in chosen}
        w = sorted(sc, key=lambda f: (-round(sc[f], 12), f))[0]
        assert got[it]["feature"] == w and got[it]["score"] == pytest.approx(sc[w], abs=1e-9)
        chosen.append(w)
        for f in red:
            red[f] += su(X[:, f], X[:, w])


def test_chi2_cell_term_relevance(spark):
    X, y, df = _data(spark, seed=21)

    def chi2(a, b):
        n = len(a)
        tot = 0.0
        for va in np.unique(a):
            for vb in np.unique(b):
                o = np.sum((a == va) & (b == vb))
                e = np.sum(a == va) * np.sum(b == vb) / n
                tot += (o - e) ** 2 / e
        return tot
    score = ExprScore(lambda rel, red, n, i, k: rel["chi2"], terms={"chi2": chi2_term()}, select_top=3,
                      max_iterations=1)
    got = select_features(ArrayInstances(df, "label", "x"), 3, score).orderBy("rank").collect()
    want = sorted(range(X.shape[1]), key=lambda f: (-round(chi2(X[:, f], y), 12), f))[:3]
    assert [r["feature"] for r in got] == want
    for r in got:
        assert r["score"] == pytest.approx(chi2(X[:, r["feature"]], y), rel=1e-9)


def test_vector_score_abs_correlation(spark):
    X, y, _ = _data(spark, seed=33, d=5)
    n, d = X.shape
    cells = spark.createDataFrame([(j, i, float(X[i, j])) for i in range(n) for j in range(d)],
                                  "feature int, pos long, value double")
    classes = spark.createDataFrame([(i, float(y[i])) for i in range(n)], "pos long, b double")
    lay = FeatureWise.from_cells(cells, classes, dense=True)

    def fn(rel, red, n_sel, i, nfs):
        return rel["corr"] - F.lit(1.0 if n_sel <= 1 else 1.0 / n_sel) * red["corr"]
    score = ExprScore(fn, terms={"corr": VectorAgg(lambda x, yy: F.abs(F.corr(x, yy)))})
    got = select_features(lay, 3, score).orderBy("rank").collect()
    c = lambda a, b: abs(np.corrcoef(a, b)[0, 1])
    chosen, red = [], {f: 0.0 for f in range(d)}
    for it in range(3):
        k = len(chosen)
        coef = 1.0 if k <= 1 else 1.0 / k
        sc = {f: c(X[:, f], y) - coef * red[f] for f in range(d) if f not in chosen}
        w = sorted(sc, key=lambda f: (-round(sc[f], 12), f))[0]
        assert got[it]["feature"] == w and got[it]["score"] == pytest.approx(sc[w], abs=1e-9)
        chosen.append(w)
        for f in red:
            red[f] += c(X[:, f], X[:, w])


def test_vector_score_from_feature_arrays(spark):
    X, y, _ = _data(spark, seed=41, d=5)
    n, d = X.shape
    rows = spark.createDataFrame([(j, [float(v) for v in X[:, j]]) for j in range(d)], "fid int, values array<double>")
    classes = spark.createDataFrame([(i, float(y[i])) for i in range(n)], "pos long, b double")
    score = ExprScore(lambda rel, red, n_sel, i, k: rel["corr"], terms={"corr": VectorAgg(lambda a, b: F.abs(F.corr(a, b)))},
                      select_top=3, max_iterations=1)
    got = select_features(FeatureWise.from_arrays(rows, "fid", "values", classes), 3, score).orderBy("rank").collect()
    c = {j: abs(np.corrcoef(X[:, j], y)[0, 1]) for j in range(d)}
    want = sorted(c, key=lambda j: (-round(c[j], 12), j))[:3]
    assert [r["feature"] for r in got] == want
