"""Position bitmaps, stored cells and aligned vectors: results and plans."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from infosieve import ArrayInstances, BitmapCells, FeatureWise, MapInstances, select_features
from infosieve.operators import alignment as al
from infosieve.operators import bitmaps
from infosieve.operators import contingency as ctg
from infosieve.session import drop_scratch

from bruteforce import mi, select


def plan_of(df, mode="formatted"):
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)
    return text.split("== Initial Plan ==")[-1]


def data(spark, seed=1, n=700, d=12):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    X = rng.integers(0, 4, (n, d)) * (rng.random((n, d)) < 0.4)
    X[:, 3] = np.where(rng.random(n) < 0.6, y, X[:, 3])
    rows = spark.createDataFrame([(i, int(y[i]), [int(v) for v in X[i]]) for i in range(n)], "pos long, y int, x array<int>")
    cells = rows.select(F.posexplode("x").alias("feature", "value"), "pos")
    return X, y, rows, cells, rows.select("pos", F.col("y").alias("b"))


def counts(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_bitmap_tables_equal_counted_cells(spark):
    _, _, rows, cells, classes = data(spark)
    plain = ArrayInstances(rows, "y", "x", cache=False)
    for layout in (ArrayInstances(rows, "y", "x"), FeatureWise.from_cells(cells, classes)):
        bits = BitmapCells(layout)
        bits.prepare(1000)
        cols = ("feature", "a", "b", "n")
        assert counts(bits.class_counts(), *cols) == counts(ctg.count_pairs(plain.class_rows([]), ["feature"]), *cols)
        want = ctg.count_pairs(plain.winner_rows([3, 5], [3, 5]), ["feature", "other"]).where("b <> 0")
        cols = ("feature", "other", "a", "b", "n")
        assert counts(bits.winner_counts([3, 5], [3, 5]), *cols) == counts(want, *cols)
        assert counts(bits.winner_counts([3], [3], only=[1, 2]), *cols) == counts(want.where("other = 3 AND feature IN (1, 2)"), *cols)
        bits.unpersist()


def test_no_cell_is_unpacked_again(spark):
    _, _, rows, _, _ = data(spark)
    bits = BitmapCells(ArrayInstances(rows, "y", "x"))
    bits.prepare(1000)
    bits.bitmaps = bits.bitmaps.checkpoint()
    plan = plan_of(bits.winner_counts([3], [3], rows=10))
    assert "Generate" not in plan and "Expand" not in plan and "bit_count" in plan
    assert bits.bitmaps.count() <= sum(len(set(c[c != 0])) for c in np.array(data(spark)[0]).T) * (700 // bitmaps.BLOCK + 8)
    bits.unpersist()


def test_bitmap_selection_equals_brute_force(spark):
    X, y, rows, cells, classes = data(spark, seed=2)
    want = select(X, y, 5)
    maps = rows.select("y", F.map_from_arrays(F.transform(F.sequence(F.lit(0), F.size("x") - 1), lambda i: F.format_string("f%02d", i)), "x").alias("m"))
    for layout in (ArrayInstances(rows, "y", "x"), FeatureWise.from_cells(cells, classes),
                   MapInstances(maps, "y", "m", hash_keys=True)):
        for bound in (1_000_000, 0):
            got = select_features(BitmapCells(layout), 5, broadcast_rows=bound, release_input=False).orderBy("rank").collect()
            assert [int(str(r["feature"]).lstrip("f")) for r in got] == [f for f, _ in want]
            assert [r["score"] for r in got] == pytest.approx([s for _, s in want], abs=1e-9)


def test_levels_without_a_zero(spark):
    rows = spark.createDataFrame([("a", ["x", "u"]), ("b", ["y", "u"]), ("a", ["x", "v"]), ("b", ["y", "v"])], "y string, v array<string>")
    got = select_features(BitmapCells(ArrayInstances(rows, "y", "v")), 2).orderBy("rank").collect()
    assert [(r["feature"], r["score"]) for r in got] == [(0, pytest.approx(1.0)), (1, pytest.approx(0.0))]


def test_stored_cells_select_like_brute_force_and_raise_for_duplicates(spark):
    X, y, _, cells, classes = data(spark, seed=3)
    for lazy in (True, False):
        got = select_features(FeatureWise.from_cells(cells, classes, store=3), 4, lazy=lazy, broadcast_rows=0).orderBy("rank").collect()
        assert [r["feature"] for r in got] == [f for f, _ in select(X, y, 4)]
    with pytest.raises(ValueError, match="same ID"):
        select_features(FeatureWise.from_cells(cells.union(cells.where("feature = 2")), classes, store=3), 2)
    arrays = cells.groupBy("feature").agg(F.sort_array(F.collect_list(F.struct("pos", "value")))["value"].alias("v"))
    with pytest.raises(ValueError, match="same ID"):
        select_features(FeatureWise.from_arrays(arrays.union(arrays.where("feature = 2")), "feature", "v", classes, store=3), 2)
    drop_scratch(spark)


def test_a_feature_is_fetched_by_a_pruned_read(spark):
    _, _, _, cells, classes = data(spark)
    lay = FeatureWise.from_cells(cells, classes, store=3)
    lay.prepare(1000)
    plan = plan_of(lay._fetch(lay.cells_df, [3, 5]))
    pushed = re.search(r"PushedFilters: \[([^\n]*)\]", plan).group(1)
    assert f"In({al.KEY}, [" in pushed and "feature" in pushed
    # keys are clustered: the files' row groups have narrow, ordered key ranges
    import glob
    import pyarrow.parquet as pq
    table = lay._held.stored_name
    place = spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Location'").first()["data_type"].replace("file:", "")
    for f in glob.glob(place + "/*.parquet"):
        keys = pq.read_table(f, columns=[al.KEY])[al.KEY].to_pylist()
        assert keys == sorted(keys)
    lay.unpersist()


def test_stored_sides_meet_without_an_exchange(spark):
    _, _, _, cells, classes = data(spark)
    lay = FeatureWise.from_cells(cells, classes, store=3)
    lay.broadcast_rows = 0
    lay.prepare(0)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (lay.class_rows([]), lay.winner_rows([3, 5], [3, 5], nnz={3: 10 ** 7, 5: 10 ** 7})):
            assert "SortMergeJoin" in plan_of(df, "simple") and "Exchange" not in plan_of(df, "simple")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    lay.unpersist()


def test_aligned_vectors(spark):
    X, _, rows, _, _ = data(spark)
    pick = [rows.select("pos", F.col("x")[j].alias("value")) for j in (3, 4)]
    x, y = (al.store_by_position(p, 4) for p in pick)
    assert "SortMergeJoin" in plan_of(al.aligned(x, y), "simple") and "Exchange" not in plan_of(al.aligned(x, y), "simple")
    assert al.mutual_information_aligned(x, y).first()["mi"] == pytest.approx(mi(X[:, 3], X[:, 4]))
    with pytest.raises(Exception, match="different positions"):
        al.mutual_information_aligned(x, al.store_by_position(pick[1].where("pos <> 5"), 4)).collect()
    with pytest.raises(Exception, match="twice"):
        al.mutual_information_aligned(x, al.store_by_position(pick[1].union(pick[1].where("pos = 5")), 4)).collect()
    al.drop_stored(x, y)
