"""Rank statistics against counting all pairs."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from infosieve import ExprScore, FeatureWise, RankTerm, WideInstances, select_features
from infosieve.operators import ranks
from infosieve.operators.sample import exact_sample
from infosieve.sources import read_features_libsvm, read_libsvm, read_libsvm_ids, write_features_libsvm, write_libsvm


def plain(x, y):
    """(spearman, kendall) of two vectors."""
    x, y = np.asarray(x), np.asarray(y)
    if len(set(x.tolist())) < 2 or len(set(y.tolist())) < 2:
        return None, None
    rx, ry = pd.Series(x).rank(), pd.Series(y).rank()
    dx, dy = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    return rx.corr(ry), float((dx * dy).sum()) / math.sqrt(float((dx != 0).sum()) * float((dy != 0).sum()))


def counted(spark, vectors, y):
    rows = [(f, float(a), float(b)) for f, x in vectors.items() for a, b in zip(x, y)]
    return (spark.createDataFrame(rows, "feature string, a double, b double")
            .groupBy("feature", "a", "b").agg(F.count(F.lit(1)).alias("n")))


@pytest.mark.parametrize("block_cells", [1, 7, 40, 1 << 16])
def test_equal_to_all_pairs(spark, block_cells):
    rng = np.random.default_rng(block_cells)
    n = 160
    y = rng.integers(0, 25, n)
    y[: n // 3] = 4                                        # a level holding a third of all rows
    vectors = {"distinct": rng.random(n), "sorted": np.arange(n), "few": rng.integers(0, 3, n), "like": y + rng.integers(0, 3, n),
               "against": -y * (rng.random(n) < 0.8), "constant": np.ones(n), "sparse": (rng.random(n) < 0.1) * rng.random(n)}
    got = ranks.rank_terms(counted(spark, vectors, y), ["feature"], {"s": "spearman", "k": "kendall"}, block_cells=block_cells)
    got = {r["feature"]: (r["s"], r["k"]) for r in got.collect()}
    assert set(got) == set(vectors)
    for f, x in vectors.items():
        for have, want in zip(got[f], plain(x, y)):
            assert (have is None) == (want is None) and (want is None or have == pytest.approx(want, abs=1e-12)), f


def test_signed_pairs_by_matrix_and_by_merging(monkeypatch):
    rng = np.random.default_rng(8)
    cases = []
    for _ in range(60):
        m = int(rng.integers(1, 50))
        u, v, n = rng.integers(0, rng.integers(1, 12), m), rng.integers(0, rng.integers(1, 12), m), rng.integers(1, 6, m)
        want = sum(int(n[i]) * int(n[j]) * np.sign(v[j] - v[i]) for i in range(m) for j in range(m) if u[i] < u[j])
        cases.append((u, v, n, want))
    for u, v, n, want in cases:
        assert ranks.signed_pairs(u, v, n) == want
    u, v, n = rng.integers(0, 4000, 9000), rng.integers(0, 4000, 9000), rng.integers(1, 5, 9000)
    by_matrix = None
    for limit in (1 << 25, 0):
        monkeypatch.setattr(ranks, "MATRIX", limit)
        got = ranks.signed_pairs(u, v, n)
        assert by_matrix is None or got == pytest.approx(by_matrix, rel=1e-12)
        by_matrix = got


def test_running_sums_over_many_ranges(spark):
    rows = [(k, i, (i * 7 + k) % 5) for k in range(3) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, x int, v long").repartition(7)
    got = {(r["k"], r["x"]): r["before_v"] for r in ranks.running(df, ["k"], "x", ["v"]).collect()}
    assert got == {(k, i): sum((j * 7 + k) % 5 for j in range(i)) for k in range(3) for i in range(300)}


@pytest.mark.parametrize("kind,at", [("spearman", 0), ("kendall", 1)])
def test_selection_by_rank_correlation(spark, kind, at):
    rng = np.random.default_rng(12)
    n, d = 120, 8
    y = rng.integers(0, 9, n)
    X = rng.integers(0, 6, (n, d))
    X[:, 2], X[:, 6] = y // 2, 8 - y + rng.integers(0, 3, n)
    X[:, 7] = X[:, 2]

    def corr(a, b):
        return abs(plain(a, b)[at])
    chosen, want = [], []
    while len(chosen) < 3:
        c = 1.0 if len(chosen) <= 1 else 1 / len(chosen)
        best = min((f for f in range(d) if f not in chosen), key=lambda f: (
            -round(corr(X[:, f], y) - c * sum(corr(X[:, f], X[:, s]) for s in chosen), 12), f))
        want.append(best)
        chosen.append(best)
    score = ExprScore(lambda rel, red, m, i, k: rel["r"] - F.lit(1.0 if m <= 1 else 1.0 / m) * red["r"],
                      terms={"r": RankTerm(kind)}, pair_values=lambda t: {"r": F.abs(t["r"])}, bounded=True)
    df = spark.createDataFrame([(int(y[i]), *map(int, X[i])) for i in range(n)], ["y", *[f"f{j}" for j in range(d)]])
    cells = spark.createDataFrame([(j, i, int(X[i, j])) for i in range(n) for j in range(d)], "feature int, pos long, value int")
    classes = spark.createDataFrame([(i, int(y[i])) for i in range(n)], "pos long, b int")
    for layout, lazy in ((WideInstances(df, "y"), False), (FeatureWise.from_cells(cells, classes), True)):
        got = select_features(layout, 3, score, lazy=lazy, lazy_batch=2).orderBy("rank").collect()
        assert [int(str(r["feature"]).lstrip("f")) for r in got] == want
    with pytest.raises(ValueError, match="rank statistic"):
        RankTerm("pearson")


@pytest.mark.parametrize("k", [0, 1, 137, 299, 500])
def test_exactly_k_rows_whatever_the_partitioning(spark, k, monkeypatch):
    from infosieve.operators import sample
    monkeypatch.setattr(sample, "STEP_DIGITS", 1)
    monkeypatch.setattr(sample, "FETCHED", 3)
    df = spark.range(300).select("id", (F.col("id") % 3).alias("x.y"))
    picks = [sorted(r["id"] for r in exact_sample(df.repartition(p), k, "id", seed=3).collect()) for p in (1, 6)]
    assert picks[0] == picks[1] and len(picks[0]) == min(k, 300)
    assert exact_sample(df, k, "x.y").count() == min(k, 300)           # keys that repeat
    same = spark.range(20).select(F.lit(1).alias("id"), F.lit(None).cast("string").alias("t"))
    assert exact_sample(same, min(k, 13), "id").count() == min(k, 13)  # rows equal in every column


def test_declared_width(spark, tmp_path):
    rows = spark.createDataFrame([(1.0, [1.0, 0.0, 2.0, 0.0, 0.0]), (0.0, [0.0, 0.0, 1.0, 0.0, 0.0])], "y double, x array<double>")
    write_libsvm(rows, str(tmp_path / "a"), "y", "x")
    from infosieve import MapInstances
    from infosieve.operators.stats import profile
    df = read_libsvm(spark, str(tmp_path / "a"), num_features=5)
    assert profile(df, "features", 5).first()["n_cols"] == 5 and profile(df, "features").first()["n_cols"] == 3
    got = select_features(MapInstances(df, "label", "features", width=5), 5, all_zero="keep").orderBy("rank").collect()
    assert sorted(r["feature"] for r in got) == [0, 1, 2, 3, 4]
    with pytest.raises(Exception, match="declared 2 features"):
        read_libsvm(spark, str(tmp_path / "a"), num_features=2).collect()


def test_feature_wise_libsvm_writer(spark, tmp_path, monkeypatch):
    from infosieve.sources import sinks
    monkeypatch.setattr(sinks, "LINE_POSITIONS", 4)
    cells = [(f, p, float((f * p) % 3)) for f in range(4) for p in range(11)]
    write_features_libsvm(spark.createDataFrame(cells, "feature long, pos long, value double"), str(tmp_path / "f"))
    back = read_features_libsvm(spark, str(tmp_path / "f"))
    assert sorted(tuple(r) for r in back.collect()) == [c for c in cells if c[2]]
    assert sorted(r["feature"] for r in read_libsvm_ids(spark, str(tmp_path / "f")).collect()) == [0, 1, 2, 3]
