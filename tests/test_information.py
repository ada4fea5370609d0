import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from infosieve.operators import contingency as ctg
from infosieve.operators.cells import ArrayInstances
from infosieve.operators.information import mi_from_pairs, mutual_information_columns

from bruteforce import mi


def test_worked_value_both_ways(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (2.0, 1.0), (1.0, 1.0), (1.0, 2.0)], "a double, b double")
    assert mutual_information_columns(df, "a", "b").first()["mi"] == pytest.approx(0.17095059445466854, abs=1e-15)
    assert mutual_information_columns(df, "b", "a").first()["mi"] == pytest.approx(0.17095059445466854, abs=1e-15)


def test_identical_columns_give_entropy(spark):
    vals = [0, 1, 1, 2, 2, 2, 3, 3, 3, 3]
    df = spark.createDataFrame([(float(v), float(v)) for v in vals], "a double, b double")
    p = np.bincount(vals) / len(vals)
    h = -sum(x * math.log2(x) for x in p if x > 0)
    assert mutual_information_columns(df, "a", "b").first()["mi"] == pytest.approx(h, abs=1e-12)


def test_independent_columns_give_zero(spark):
    rows = [(float(a), float(b)) for a in range(3) for b in range(4)]
    df = spark.createDataFrame(rows, "a double, b double")
    assert mutual_information_columns(df, "a", "b").first()["mi"] == pytest.approx(0.0, abs=1e-12)


def _sparse_mi(spark, X, y):
    rows = [(float(y[i]), [float(v) for v in X[i]]) for i in range(len(y))]
    lay = ArrayInstances(spark.createDataFrame(rows, "label double, x array<double>"), "label", "x", cache=False)
    prep = lay.prepare(1000)
    pairs = ctg.count_pairs(lay.class_rows([]), ["feature"])
    out = mi_from_pairs(pairs, prep.hist, prep.n, ["feature"], hist_rows=prep.n_classes)
    return {r["feature"]: r["mi"] for r in out.collect()}, out


@settings(max_examples=8, deadline=None)
@given(st.integers(min_value=0, max_value=10_000))
def test_sparse_form_equals_dense_counting(spark, seed):
    rng = np.random.default_rng(seed)
    n, d = int(rng.integers(5, 40)), int(rng.integers(1, 5))
    X = rng.choice([0, 0, 0, 1, 2, 5], size=(n, d))
    y = rng.integers(0, 3, size=n)
    got, _ = _sparse_mi(spark, X, y)
    for f in range(d):
        if not X[:, f].any():
            assert f not in got          # no non-zero cell: never a candidate
            continue
        assert got[f] == pytest.approx(mi(X[:, f], y), abs=1e-12)
        assert got[f] >= -1e-12


def test_marginal_check_raises(spark):
    pairs = spark.createDataFrame([("f", 1.0, "x", 5)], "feature string, a double, b string, n long")
    hist = spark.createDataFrame([("x", 3)], "b string, nb long")
    with pytest.raises(Exception, match="Marginal sum greater than total"):
        mi_from_pairs(pairs, hist, 10, ["feature"], hist_rows=1).collect()


def test_tables_are_never_gathered(spark):
    """Above materialised counts: partial sums by level, joined back; no window, no cartesian product."""
    X = np.array([[0, 1], [1, 1], [2, 0], [1, 0]])
    rows = [(float(y), [float(v) for v in X[i]]) for i, y in enumerate([0, 1, 0, 1])]
    lay = ArrayInstances(spark.createDataFrame(rows, "label double, x array<double>"), "label", "x", cache=False)
    prep = lay.prepare(1000)
    pairs = ctg.count_pairs(lay.class_rows([]), ["feature"]).checkpoint()
    out = mi_from_pairs(pairs, prep.hist, prep.n, ["feature"], hist_rows=prep.n_classes)
    plan = out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple").split("== Initial Plan ==")[-1]
    assert "partial_sum" in plan
    assert "Window" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_tiny_information_keeps_its_relative_accuracy(spark):
    """Near-independent columns: quotient scores divide by such values."""
    n = [[250_001, 249_999], [249_999, 250_001]]
    pairs = spark.createDataFrame([("f", 1.0, j, n[1][j]) for j in range(2)], "feature string, a double, b int, n long")
    hist = spark.createDataFrame([(j, n[0][j] + n[1][j]) for j in range(2)], "b int, nb long")
    got = mi_from_pairs(pairs, hist, 1_000_000, ["feature"], hist_rows=2).first()["mi"]
    e = 1 / 250_000
    assert got == pytest.approx(e * e / (2 * math.log(2)), rel=1e-6)


def test_cell_terms_meet_every_level(spark):
    """Classes beyond one bucket of the grid: the zero row still has a cell for each."""
    from infosieve.operators.contingency import GRID_LEVELS, full_table
    n = GRID_LEVELS + 300
    rows = [(i, [float(i % 3 == 0), 1.0]) for i in range(n)]
    lay = ArrayInstances(spark.createDataFrame(rows, "label int, x array<double>"), "label", "x", cache=False)
    prep = lay.prepare(1000)
    pairs = ctg.count_pairs(lay.class_rows([]), ["feature"]).checkpoint()
    got = {(r["feature"], r["a"], r["b"]): r["n"] for r in full_table(pairs, prep.hist, ["feature"]).collect()}
    assert got == {(j, x[j], i): 1 for i, x in rows for j in range(2)}
    from infosieve.operators.scores import chi2_term
    out = mi_from_pairs(pairs, prep.hist, prep.n, ["feature"], cell_terms={"chi2": chi2_term().fn}).collect()
    assert {r["feature"]: round(r["chi2"], 6) for r in out} == {0: float(n), 1: 0.0}


def test_small_and_spread_tables_give_the_same_terms(spark, monkeypatch):
    """MI and cell terms of one exchange by table equal those spread by (table, level)."""
    from infosieve.operators import information
    from infosieve.operators.scores import chi2_term, entropy_terms
    rows = [(f, (i * (f + 2)) % 4, (i // 3) % 3) for f in range(4) for i in range(60)]
    df = spark.createDataFrame(rows, "feature int, a int, b int")
    pairs = df.where("a <> 0").groupBy("feature", "a", "b").agg(F.count("*").alias("n")).checkpoint()
    hist = spark.createDataFrame([(0, 20), (1, 20), (2, 20)], "b int, nb long")
    terms = {k: t.fn for k, t in {**entropy_terms(), "chi2": chi2_term()}.items() if t != "mi"}
    got = []
    for cells in (100, None):
        out = information.mi_from_pairs(pairs, hist, 60, ["feature"], hist_rows=3, cell_terms=terms, table_cells=cells)
        got.append(sorted(tuple(r[c] for c in ("feature", "mi", "nnz", "n_levels", "lo", *terms)) for r in out.collect()))
    assert len(got[0]) == 3      # feature 2 is zero everywhere
    for small, spread in zip(*got):
        assert small == pytest.approx(spread, abs=1e-12)
