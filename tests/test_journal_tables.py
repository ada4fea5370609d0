"""Resumed selections, whole-table scores, and the selector as a stage that is saved and loaded."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from bruteforce import mi, select
from infosieve import ArrayInstances, ExprScore, Selector, TablesTerm, WideInstances, register_score, select_features
from infosieve.plans.estimator import InfoSelector, InfoSelectorModel


def data(spark, seed=1, n=120, d=10):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    X = rng.integers(0, 4, (n, d))
    for j in (1, 4, 8):
        X[:, j] = np.where(rng.random(n) < 0.3 + j / 20, y, X[:, j])
    return X, y, spark.createDataFrame([(int(y[i]), [int(v) for v in X[i]]) for i in range(n)], "y int, x array<int>")


class Stopped(Exception):
    pass


@pytest.mark.parametrize("lazy", [False, True])
def test_a_new_driver_goes_on_after_the_last_finished_iteration(spark, tmp_path, monkeypatch, lazy):
    X, y, df = data(spark)
    path = str(tmp_path / "journal")
    once = Selector._best

    def stops(self, i, m):
        if i == 3:
            raise Stopped
        return once(self, i, m)
    monkeypatch.setattr(Selector, "_best", stops)
    with pytest.raises(Stopped):
        select_features(ArrayInstances(df, "y", "x"), 5, journal=path, lazy=lazy)
    picked = []
    monkeypatch.setattr(Selector, "_best", lambda self, i, m: picked.append(i) or once(self, i, m))
    counted = ArrayInstances.class_rows
    monkeypatch.setattr(ArrayInstances, "class_rows", lambda *a: pytest.fail("the class pass runs again"))
    got = select_features(ArrayInstances(df, "y", "x"), 5, journal=path, lazy=lazy).orderBy("rank").collect()
    want = select(X, y, 5)
    assert picked == [3, 4, 5]
    assert [r["feature"] for r in got] == [f for f, _ in want]
    assert [r["score"] for r in got] == pytest.approx([s for _, s in want], abs=1e-9)
    monkeypatch.setattr(ArrayInstances, "class_rows", counted)
    with pytest.raises(ValueError, match="another selection"):
        select_features(ArrayInstances(df, "y", "x"), 4, journal=path)


def test_half_written_iterations_do_not_count(spark, tmp_path):
    X, y, df = data(spark, seed=2)
    path = str(tmp_path / "journal")
    select_features(ArrayInstances(df, "y", "x"), 3, journal=path)
    last = max(d for d in os.listdir(path) if d.startswith("iteration-"))
    os.remove(f"{path}/{last}/_SUCCESS")
    got = select_features(ArrayInstances(df, "y", "x"), 3, journal=path).orderBy("rank").collect()
    assert [r["feature"] for r in got] == [f for f, _ in select(X, y, 3)]


def worst_levels(cells):
    info = F.expr("n / total * log2(n * total / (na * nb))")
    worst = (cells.where("place > 0").groupBy("feature", "a", "place").agg(F.sum(info).alias("i"))
             .groupBy("feature", "a").agg(F.max("i").alias("i")).groupBy("feature").agg(F.sum("i").alias("w")))
    rel = cells.where("place = 0").groupBy("feature").agg(F.sum(info).alias("r"))
    return rel.join(worst, "feature", "left").select("feature", (F.col("r") - F.coalesce("w", F.lit(0.0))).alias("value"))


def level_info(x, z):
    n = len(x)
    return {a: sum(((x == a) & (z == b)).sum() / n * np.log2(((x == a) & (z == b)).sum() * n / ((x == a).sum() * (z == b).sum()))
                   for b in set(z.tolist()) if ((x == a) & (z == b)).any()) for a in set(x.tolist())}


def test_a_function_of_all_tables_together(spark):
    X, y, df = data(spark, seed=3)
    chosen = []
    while len(chosen) < 4:
        def value(f):
            worst = sum(max(level_info(X[:, f], X[:, s])[a] for s in chosen) for a in set(X[:, f].tolist())) if chosen else 0
            return mi(X[:, f], y) - worst
        chosen.append(min((f for f in range(X.shape[1]) if f not in chosen), key=lambda f: (-round(value(f), 12), f)))
    score = ExprScore(lambda rel, red, n, i, k: rel["v"], terms={"v": TablesTerm(worst_levels)})
    wide = df.select("y", *[F.col("x")[j].alias(f"c{j}") for j in range(X.shape[1])])
    text = df.select(F.col("y").cast("string").alias("y"), F.transform("x", lambda v: F.concat(F.lit("v"), v.cast("string"))).alias("x"))
    for layout in (ArrayInstances(df, "y", "x"), WideInstances(wide, "y"), ArrayInstances(text, "y", "x")):
        got = select_features(layout, 4, score).orderBy("rank").collect()
        assert [int(str(r["feature"]).lstrip("c")) for r in got] == chosen


def test_tiles_hold_whole_levels_and_are_merged(spark):
    """A function that needs whole groups in Python, tile by tile: here the number of cells."""
    def cells_of(cells):
        per_tile = cells.select("feature", "tile", "place", "a", "b").groupBy("feature", "tile").applyInPandas(
            lambda p: p.groupby("feature").size().rename("n").reset_index(), "feature int, n long")
        return per_tile.groupBy("feature").agg(F.sum("n").alias("value"))
    X, y, df = data(spark, seed=4)
    score = ExprScore(lambda rel, red, n, i, k: rel["v"], terms={"v": TablesTerm(cells_of, tiles=3)})
    got = select_features(ArrayInstances(df, "y", "x"), 1, score).first()
    sizes = [len(set(zip(X[:, f].tolist(), y.tolist()))) for f in range(X.shape[1])]
    assert got["score"] == max(sizes) and got["feature"] == sizes.index(max(sizes))


def vectors(spark, df):
    from pyspark.ml.functions import array_to_vector
    return df.select("y", array_to_vector(F.col("x").cast("array<double>")).alias("features"))


def test_stage_is_saved_and_loaded_in_a_pipeline(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel
    X, y, df = data(spark, seed=5)
    v = vectors(spark, df)
    est = Pipeline(stages=[InfoSelector(k=3, label_col="y", output_col="best", lazy=False)])
    est.write().save(str(tmp_path / "est"))
    model = Pipeline.load(str(tmp_path / "est")).fit(v)
    model.write().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    stage = again.stages[0]
    assert isinstance(stage, InfoSelectorModel) and stage.uid == model.stages[0].uid
    assert stage.selected == [f for f, _ in select(X, y, 3)] and stage.scores == model.stages[0].scores
    rows = again.transform(v).select("best").collect()
    assert [r["best"].toArray().tolist() for r in rows] == X[:, stage.selected].astype(float).tolist()


def test_param_maps_and_string_ids(spark, tmp_path):
    X, y, df = data(spark, seed=6)
    maps = df.select("y", F.map_from_arrays(F.transform(F.sequence(F.lit(0), F.size("x") - 1), lambda i: F.format_string("f%02d", i)), "x").alias("m"))
    est = InfoSelector(2, label_col="y", features_col="m")
    model = est.fit(maps, {est.k: 4, est.score: "maxrel"})
    assert est.getOrDefault(est.k) == 2
    assert model.selected == [f"f{f:02d}" for f, _ in select(X, y, 4, score="maxrel")]
    model.save(str(tmp_path / "m"))
    back = InfoSelectorModel.load(str(tmp_path / "m"))
    assert back.selected == model.selected and back.getFeaturesCol() == "m"
    assert back.transform(maps).first()["selected"] == [float(X[0, int(f[1:])]) for f in model.selected]


def test_schemas_and_scores_are_checked(spark, tmp_path):
    _, _, df = data(spark, seed=7)
    est = InfoSelector(2, label_col="y", features_col="x")
    assert est.transformSchema(df.schema)["selected"].dataType.simpleString() == "array<double>"
    for bad in (InfoSelector(2, label_col="none", features_col="x"), InfoSelector(2, label_col="y", features_col="y"),
                InfoSelector(2, label_col="y", features_col="x", output_col="y"), InfoSelector(2, "none", "y", "x")):
        with pytest.raises(ValueError):
            bad.fit(df)
    own = ExprScore(lambda rel, red, n, i, k: rel["mi"], name="own")
    with pytest.raises(ValueError, match="register"):
        InfoSelector(2, own, "y", "x").save(str(tmp_path / "e"))
    register_score("own", lambda: own)
    InfoSelector(2, "own", "y", "x").save(str(tmp_path / "f"))
    assert len(InfoSelector.load(str(tmp_path / "f")).fit(df).selected) == 2
