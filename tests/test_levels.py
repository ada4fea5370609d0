"""Exact levels of any type, strict feature-wise validation, width, joint and maximum scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from infosieve import (ArrayInstances, ExprScore, FeatureWise, JointAgg, MapInstances, VectorAgg, WideInstances, select_features)
from infosieve.operators.scores import max_redundancy_mrmr

from bruteforce import mi, select


def picks(layout, k, score="mrmr", **kw):
    return [(r["feature"], r["score"]) for r in select_features(layout, k, score, **kw).orderBy("rank").collect()]


def test_big_integers_stay_apart(spark):
    a, b = 2 ** 53, 2 ** 53 + 1
    df = spark.createDataFrame([(a, a, 1), (b, b, 1), (a, a, 2), (b, b, 2)], "y bigint, same bigint, other int")
    assert picks(WideInstances(df, "y"), 1, "maxrel") == [("same", pytest.approx(1.0))]
    arr = spark.createDataFrame([(a, [a]), (b, [b]), (a, [a])], "y bigint, x array<bigint>")
    assert picks(ArrayInstances(arr, "y", "x"), 1, "maxrel")[0][1] > 0.9


def test_decimals_stay_apart(spark):
    df = spark.sql("SELECT * FROM VALUES ('p', 0.1234567890123456789012BD), ('q', 0.1234567890123456789013BD) AS t(y, d)")
    assert picks(WideInstances(df, "y"), 1, "maxrel") == [("d", pytest.approx(1.0))]


def test_zero_rule_holds_per_feature(spark):
    """A string column beside them does not turn an all-zero number into a candidate."""
    rows = [("a", "x", 0, 0.0, 1), ("b", "0", 0, -0.0, 0), ("a", "x", 0, 0.0, 2), ("b", "0", 0, 0.0, 1)]
    df = spark.createDataFrame(rows, "y string, s string, zero int, zeros double, i int")
    got = picks(WideInstances(df, "y"), 5)
    assert [f for f, _ in got] == ["s", "i"]


def test_mixed_types_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    n = 80
    s, i, d, b = rng.choice(["0", "u", "v"], n), rng.integers(0, 3, n), rng.choice([0.0, 0.5, -1.5], n), rng.random(n) < 0.4
    y = [f"{p}{int(q > 0)}" if r < 0.8 else "z" for p, q, r in zip(s, i, rng.random(n))]
    rows = [(y[k], str(s[k]), int(i[k]) << 40, float(d[k]), bool(b[k])) for k in range(n)]
    df = spark.createDataFrame(rows, "y string, c0 string, c1 bigint, c2 double, c3 boolean")
    X = np.array([[r[1], str(r[2]), str(r[3]), str(r[4])] for r in rows], dtype=object)
    want = select(X, y, 4)
    for mode in ("auto", True, False, "zero_rows"):
        got = picks(WideInstances(df, "y"), 4, sparse_winners=mode)
        assert [f for f, _ in got] == [f"c{f}" for f, _ in want]
        assert [v for _, v in got] == pytest.approx([v for _, v in want], abs=1e-9)


def test_string_arrays_and_maps(spark):
    rows = [("p", ["x", "u"]), ("q", ["y", "u"]), ("p", ["x", "v"]), ("q", ["y", "v"])]
    df = spark.createDataFrame(rows, "y string, a array<string>")
    got = picks(ArrayInstances(df, "y", "a"), 2)
    assert got[0] == (0, pytest.approx(1.0)) and got[1][0] == 1
    maps = spark.createDataFrame([("p", {"k": "x"}), ("q", {}), ("p", {"k": "x", "l": "0"}), ("q", {"l": "w"})],
                                 "y string, m map<string, string>")
    got = picks(MapInstances(maps, "y", "m"), 2, "maxrel")
    assert got[0] == ("k", pytest.approx(1.0)) and got[1][0] == "l"


def test_keep_needs_a_layout_that_knows_its_features(spark):
    df = spark.createDataFrame([(1.0, {1: 1.0}), (0.0, {2: 1.0})], "y double, m map<int, double>")
    with pytest.raises(ValueError, match="knows its features"):
        select_features(MapInstances(df, "y", "m"), 1, "mrmr", all_zero="keep")


def test_five_thousand_columns(spark):
    rng = np.random.default_rng(6)
    n, d = 30, 5000
    X = (rng.random((n, d)) < 0.3).astype(int)
    y = X[:, 4321] ^ (rng.random(n) < 0.1)
    flat = spark.createDataFrame([(int(y[i]), [int(v) for v in X[i]]) for i in range(n)], "y int, x array<int>")
    df = flat.select("y", *[F.col("x")[j].alias(f"c{j}") for j in range(d)])
    assert picks(WideInstances(df, "y"), 1, "maxrel")[0][0] == f"c{select(X, y, 1, score='maxrel')[0][0]}"


def classes(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"pos long, b {kind}")


def test_class_positions_run_from_zero(spark):
    cells = spark.createDataFrame([(1, 1, 1.0), (1, 2, 1.0)], "feature int, pos long, value double")
    shifted = classes(spark, [(1, 1.0), (2, 1.0), (3, 0.0)])
    with pytest.raises(ValueError, match="from 0 to 2"):
        select_features(FeatureWise.from_cells(cells, shifted), 1, "mrmr")
    rows = spark.createDataFrame([(1, [1.0, 1.0, 0.0])], "f int, v array<double>")
    with pytest.raises(ValueError, match="from 0 to 2"):
        select_features(FeatureWise.from_arrays(rows, "f", "v", shifted), 1, "mrmr")


def test_null_vectors_raise(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "f int, v array<double>")
    with pytest.raises(ValueError, match="null or NaN"):
        select_features(FeatureWise.from_arrays(rows, "f", "v", classes(spark, [(0, 1.0), (1, 0.0)])), 1, "mrmr")


def test_feature_wise_string_class_and_values(spark):
    cells = spark.createDataFrame([(f, p, v) for f, vs in ((1, "abab"), (2, "aabb")) for p, v in enumerate(vs)],
                                  "feature int, pos long, value string")
    cl = classes(spark, [(0, "u"), (1, "u"), (2, "w"), (3, "w")], "string")
    assert picks(FeatureWise.from_cells(cells, cl), 2)[0] == (2, pytest.approx(1.0))


def data(seed=9, n=70, d=6):
    rng = np.random.default_rng(seed)
    X = rng.choice([0.0, 0.0, 1.0, 2.0], size=(n, d))
    return X, (X[:, 1] * 2 + X[:, 3] + rng.integers(0, 2, n)) % 4


def test_max_redundancy(spark):
    X, y = data()
    df = spark.createDataFrame([(float(y[i]), X[i].tolist()) for i in range(len(y))], "y double, x array<double>")
    got = picks(ArrayInstances(df, "y", "x"), 4, max_redundancy_mrmr())
    chosen = []
    for f, v in got:
        sc = {j: mi(X[:, j], y) - max((mi(X[:, j], X[:, s]) for s in chosen), default=0.0) for j in range(6) if j not in chosen}
        want = min(sc, key=lambda j: (-round(sc[j], 12), j))
        assert f == want and v == pytest.approx(sc[want], abs=1e-9)
        chosen.append(f)


def test_min_redundancy_over_two_winners(spark):
    X, y = data(11)
    df = spark.createDataFrame([(float(y[i]), X[i].tolist()) for i in range(len(y))], "y double, x array<double>")
    score = ExprScore(lambda rel, red, n, i, k: rel["mi"] - red["mi_min"], select_top=2)
    got = picks(ArrayInstances(df, "y", "x"), 4, score)
    first = [f for f, _ in got[:2]]
    sc = {j: mi(X[:, j], y) - min(mi(X[:, j], X[:, s]) for s in first) for j in range(6) if j not in first}
    assert [f for f, _ in got[2:]] == sorted(sc, key=lambda j: (-round(sc[j], 12), j))[:2]


@pytest.mark.parametrize("bound", [1_000_000, 5])
def test_joint_score_sees_all_vectors(spark, bound):
    X, y = data(13)
    cells = spark.createDataFrame([(j, i, float(X[i, j])) for i in range(len(y)) for j in range(6)],
                                  "feature int, pos long, value double")
    cl = classes(spark, [(i, float(v)) for i, v in enumerate(y)])

    def fn(x, yy, s):
        product = x
        for v in s:
            product = product * (v + 1)
        return F.abs(F.corr(product, yy))
    score = ExprScore(lambda rel, red, n, i, k: rel["joint"] + 0 * rel["corr"],
                      terms={"joint": JointAgg(fn), "corr": VectorAgg(lambda a, b: F.abs(F.corr(a, b)))})
    got = picks(FeatureWise.from_cells(cells, cl, dense=True), 3, score, broadcast_rows=bound)
    chosen = []
    for f, v in got:
        p = np.prod([X[:, s] + 1 for s in chosen], axis=0) if chosen else 1.0
        sc = {j: abs(np.corrcoef(X[:, j] * p, y)[0, 1]) for j in range(6) if j not in chosen}
        want = min(sc, key=lambda j: (-round(sc[j], 12), j))
        assert f == want and v == pytest.approx(sc[want], abs=1e-9)
        chosen.append(f)


def test_several_winners_meet_in_one_join(spark):
    X, y = data(15)
    cells = spark.createDataFrame([(j, i, float(X[i, j])) for i in range(len(y)) for j in range(6)],
                                  "feature int, pos long, value double")
    lay = FeatureWise.from_cells(cells, classes(spark, [(i, float(v)) for i, v in enumerate(y)]))
    lay.prepare(1000)
    df = lay.winner_rows([1, 3], [1, 3], nnz={1: 50, 3: 50})
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple").split("== Initial Plan ==")[-1]
    assert plan.count("Join") == 1
    got = {(r["feature"], r["other"]): 0 for r in df.collect()}
    assert set(got) == {(f, o) for f in (0, 2, 4, 5) for o in (1, 3)}
