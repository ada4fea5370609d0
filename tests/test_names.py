"""Any column name selects, counts, reduces and unpivots."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bruteforce import mi, select
from infosieve import (ArrayInstances, BitmapCells, FeatureWise, MapInstances, VectorInstances, WideInstances, layout_for, select_features,
                       to_cells)
from infosieve.operators import reduce, sample, stats, transpose
from infosieve.operators.information import mutual_information_columns
from infosieve.operators.ranks import rank_correlation_columns
from infosieve.sources import write_features_text, write_instances_text, write_libsvm

NAMES = ["a.b", "__b", "__other", "feature", "a", "b", "other", "x y", "`q`", "__levels", "__bad", "nb", "pos", "n", "label.1", "value"]


def wide(spark, label, seed=3, n=60):
    rng = np.random.default_rng(seed)
    names = [c for c in NAMES if c != label]
    y = rng.integers(0, 2, n)
    X = rng.integers(0, 3, (n, len(names)))
    X[:, 4] = np.where(rng.random(n) < 0.8, y, X[:, 4])
    X[:, 1] = np.where(rng.random(n) < 0.7, y, X[:, 1])
    df = spark.createDataFrame([(int(y[i]), *map(int, X[i])) for i in range(n)], [label, *names])
    return df, X, y, names


@pytest.mark.parametrize("label,columns", [("a.b", 200), ("__b", 200), ("feature", 3), ("`q`", 200), ("__bad", 3)])
def test_wide_tables(spark, label, columns, monkeypatch):
    monkeypatch.setattr(WideInstances, "EXPAND_COLUMNS", columns)
    df, X, y, names = wide(spark, label)
    order = sorted(range(len(names)), key=lambda j: names[j])       # ties go to the smaller name
    want = [names[order[j]] for j, _ in select(X[:, order], y, 3)]
    for layout, lazy in ((WideInstances(df, label), True), (BitmapCells(WideInstances(df, label)), False)):
        assert [r["feature"] for r in select_features(layout, 3, lazy=lazy).orderBy("rank").collect()] == want
    got = reduce.reduce_to(df, want, keep=[label])
    assert got.columns == [label, *want] and got.count() == df.count()


@pytest.mark.parametrize("name,label", [("a.b", "__b"), ("__key", "feature"), ("cells", "width")])
def test_array_map_and_vector_columns(spark, name, label):
    from pyspark.ml.functions import array_to_vector
    df, X, y, names = wide(spark, "the label")
    values = F.array(*[F.col("`" + c.replace("`", "``") + "`").cast("double") for c in names])
    base = df.select(F.col("the label").alias(label), values.alias("v"))
    want = [j for j, _ in select(X, y, 3)]

    def col(c):
        return F.col("`" + c + "`")
    arrays = base.select(col(label).alias(label), F.col("v").alias(name))
    maps = base.select(col(label).alias(label), F.map_from_arrays(F.sequence(F.lit(0), F.size("v") - 1), "v").alias(name))
    vectors = base.select(col(label).alias(label), array_to_vector("v").alias(name))
    for layout in (ArrayInstances(arrays, label, name), MapInstances(maps, label, name), VectorInstances(vectors, label, name),
                   layout_for(arrays, label, name)):
        assert [r["feature"] for r in select_features(layout, 3).orderBy("rank").collect()] == want
    assert reduce.reduce_to(arrays, want, [label], array_col=name).columns == [label, *map(str, want)]
    assert reduce.reduce_to_array(arrays, want, [label], name, "out").count() == len(y)
    assert stats.profile(arrays, name).first()["n_cols"] == len(names)
    ids = arrays.withColumn("id", F.monotonically_increasing_id())
    assert to_cells(ids, "id", array_col=name).count() == (X != 0).sum()
    assert to_cells(maps.withColumn("id", F.lit(1)), "id", map_col=name).count() == (X != 0).sum()
    assert transpose.transpose_long(ids, "id", name).count() == X.size
    for write in (write_instances_text, write_libsvm, write_features_text):
        import tempfile
        write(arrays, tempfile.mkdtemp(prefix="infosieve-test-") + "/out", label, name)


def test_columns_and_rows(spark):
    df, X, y, names = wide(spark, "label")
    i, j = names.index("a.b"), names.index("`q`")
    assert mutual_information_columns(df, "a.b", "`q`").first()["mi"] == pytest.approx(mi(X[:, i], X[:, j]))
    assert rank_correlation_columns(df, "a.b", "`q`").count() == 1
    assert stats.class_histogram(df, "a.b").columns == ["a.b", "n"]
    assert sample.exact_sample(df, 7, "a.b").columns == df.columns and sample.exact_sample(df, 7, "a.b").count() == 7
    assert sample.bernoulli_sample(df, 0.5, "a.b").count() <= len(y)
    got = to_cells(df, "label")
    assert {r["feature"] for r in got.select("feature").distinct().collect()} == set(names)
    with pytest.raises(ValueError, match="row id"):
        to_cells(df, "feature")


def test_feature_wise_id_and_value_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 1.0]), (2, [0.0, 1.0, 1.0])], "`a.b` int, `pos` array<double>")
    classes = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "pos long, b int")
    got = select_features(FeatureWise.from_arrays(df, "a.b", "pos", classes), 1).first()
    assert got["feature"] == 1


def test_unpivoted_levels_are_exact(spark):
    big = 2 ** 53
    df = spark.createDataFrame([(1, big, "u"), (2, big + 1, "v"), (3, 0, "0")], "id int, n long, s string")
    cells = to_cells(df, "id", ["n"])
    assert sorted(r["value"] for r in cells.collect()) == [big, big + 1]
    mixed = sorted(tuple(r) for r in to_cells(df, "id").collect())
    assert mixed == [(1, "n", str(big)), (1, "s", "u"), (2, "n", str(big + 1)), (2, "s", "v"), (3, "s", "0")]
    with pytest.raises(Exception, match="null or NaN"):
        to_cells(spark.createDataFrame([(1, None)], "id int, x double"), "id").collect()
