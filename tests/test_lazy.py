"""Lazy redundancy: the same picks, and fewer tables counted."""

import numpy as np
import pytest

from infosieve import ArrayInstances, BitmapCells, ExprScore, FeatureWise, MapInstances, Selector, WideInstances
from infosieve.operators import selection
from infosieve.operators.scores import max_redundancy_mrmr

from bruteforce import select


def table(seed, n=90, d=60, levels=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    X = rng.integers(0, levels, (n, d))
    for j in range(0, d, 7):                       # informative and redundant columns
        X[:, j] = np.where(rng.random(n) < 0.7, y, X[:, j])
    X[:, min(5, d - 1)] = X[:, 0]
    return X, y


def frame(spark, X, y):
    return spark.createDataFrame([(int(y[i]), [int(v) for v in X[i]]) for i in range(len(y))], "y int, x array<int>")


def layouts(spark, X, y):
    df = frame(spark, X, y)
    from pyspark.sql import functions as F
    yield ArrayInstances(df, "y", "x")
    yield WideInstances(df.select("y", *[F.col("x")[j].alias(f"{j:03d}") for j in range(X.shape[1])]), "y")
    yield MapInstances(df.select("y", F.map_from_arrays(F.sequence(F.lit(0), F.size("x") - 1), "x").alias("m")), "y", "m")
    cells = df.select(F.monotonically_increasing_id().alias("i"), "x", "y").checkpoint()
    pos = {r["i"]: p for p, r in enumerate(sorted(cells.select("i").collect()))}
    cells = cells.select(F.udf(lambda i: pos[i], "long")("i").alias("pos"), "x", "y").checkpoint()
    yield FeatureWise.from_cells(cells.select("pos", F.posexplode("x").alias("feature", "value")),
                                 cells.select("pos", F.col("y").alias("b")))
    yield BitmapCells(ArrayInstances(df, "y", "x"))


def run(layout, k, score="mrmr", **kw):
    s = Selector(layout, k, score, **kw)
    return [(int(r["feature"]), r["score"]) for r in s.run().orderBy("rank").collect()], s


@pytest.mark.parametrize("seed", [1])
def test_same_picks_as_brute_force_in_every_layout(spark, seed):
    X, y = table(seed)
    want = select(X, y, 6)
    for layout in layouts(spark, X, y):
        got, s = run(layout, 6, lazy=True, lazy_batch=4)
        assert [f for f, _ in got] == [f for f, _ in want]
        assert [v for _, v in got] == pytest.approx([v for _, v in want], abs=1e-9)
        assert s.trace


def test_fewer_tables_and_cells_than_all_candidates(spark):
    rng = np.random.default_rng(4)
    n, d = 200, 400
    y = rng.integers(0, 2, n)
    X = (rng.random((n, d)) < 0.05).astype(int)
    for j, p in enumerate((0.95, 0.9, 0.85, 0.8, 0.75)):
        X[:, 10 * j] = np.where(rng.random(n) < p, y, 1 - y)
    got, s = run(ArrayInstances(frame(spark, X, y), "y", "x"), 4, lazy=True, lazy_batch=8)
    assert [f for f, _ in got] == [f for f, _ in select(X, y, 4)]
    counted = s.traced().groupBy("iteration").sum("candidates", "cells").collect()
    assert counted and all(r["sum(candidates)"] < d / 4 and r["sum(cells)"] < (X != 0).sum() / 2 for r in counted)


def test_limits_fall_back_to_one_pass_over_all(spark, monkeypatch):
    X, y = table(3)
    for rounds, kw in ((5, {"lazy_limit": 3}), (0, {"lazy_batch": 1})):
        monkeypatch.setattr(selection, "LAZY_ROUNDS", rounds)
        got, s = run(ArrayInstances(frame(spark, X, y), "y", "x"), 5, lazy=True, **kw)
        assert [f for f, _ in got] == [f for f, _ in select(X, y, 5)]
        assert any(t[1] == 0 for t in s.trace)


def test_largest_redundancy_and_two_per_iteration(spark):
    X, y = table(5)
    eager, _ = run(ArrayInstances(frame(spark, X, y), "y", "x"), 5, max_redundancy_mrmr(), lazy=False)
    lazy, _ = run(ArrayInstances(frame(spark, X, y), "y", "x"), 5, max_redundancy_mrmr(), lazy=True, lazy_batch=3)
    assert lazy == [(f, pytest.approx(v, abs=1e-12)) for f, v in eager]
    two = ExprScore(lambda rel, red, n, i, k: rel["mi"] - red["mi"] / max(n, 1), select_top=2, bounded=True)
    eager, _ = run(ArrayInstances(frame(spark, X, y), "y", "x"), 6, two, lazy=False)
    lazy, _ = run(ArrayInstances(frame(spark, X, y), "y", "x"), 6, two, lazy=True, lazy_batch=3)
    assert lazy == [(f, pytest.approx(v, abs=1e-12)) for f, v in eager]


def test_unbounded_scores_are_refused(spark):
    X, y = table(6, d=4)
    with pytest.raises(ValueError, match="bounds"):
        Selector(ArrayInstances(frame(spark, X, y), "y", "x"), 2, "miq", lazy=True)
    with pytest.raises(ValueError, match="lazy"):
        Selector(ArrayInstances(frame(spark, X, y), "y", "x"), 2, lazy="always")
