import pytest
from pyspark.sql import functions as F

from infosieve import select_features
from infosieve.functions.tree import tree_label
from infosieve.operators.reduce import reduce_to
from infosieve.operators.stats import profile
from infosieve.operators.transpose import cell_lines, class_lines, transpose_long
from infosieve.plans import job
from infosieve.plans.estimator import InfoSelector
from infosieve.sources import (read_cells_text, read_class_positions, read_classes, read_instances_text, read_libsvm,
                               write_cells_text, write_class_vector, write_instances_text, write_libsvm)

import samples
from bruteforce import select

X, Y = samples.table()
PICKS = [f for f, _ in select(X, Y, 5, candidates=[j for j in range(20) if X[:, j].any()])]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("samples")
    return {"cw": samples.csv_rows(d / "cw.csv", Y, X), "cw_svm": samples.libsvm_rows(d / "cw.libsvm", Y, X, "# a comment\n\n"),
            "rw": samples.csv_rows(d / "rw.csv", range(20), X.T), "rw_svm": samples.libsvm_rows(d / "rw.libsvm", range(20), X.T),
            "cl": samples.class_line(d / "class.csv", Y)}


def test_csv_and_libsvm_hold_the_same_values(spark, files):
    a = read_instances_text(spark, files["cw"])
    b = read_libsvm(spark, files["cw_svm"])
    dense = sorted((r["label"], tuple(r["features"])) for r in a.collect())
    sparse = sorted((r["label"], tuple(r["features"].get(i, 0.0) for i in range(20))) for r in b.collect())
    assert dense == sparse


def test_write_read_roundtrips(spark, tmp_out, files):
    a = read_instances_text(spark, files["cw"])
    write_instances_text(a, f"{tmp_out}/t.tsv", "label", "features", sep="\t")
    write_libsvm(a, f"{tmp_out}/t.libsvm", "label", "features")
    back_tsv = read_instances_text(spark, f"{tmp_out}/t.tsv", sep="tsv")
    back_svm = read_libsvm(spark, f"{tmp_out}/t.libsvm")
    want = sorted((r["label"], tuple(r["features"])) for r in a.collect())
    assert sorted((r["label"], tuple(r["features"])) for r in back_tsv.collect()) == want
    assert sorted((r["label"], tuple(r["features"].get(i, 0.0) for i in range(20)))
                  for r in back_svm.collect()) == want


def test_profile_counts_points(spark, files):
    p = profile(read_instances_text(spark, files["cw"]), "features").first()
    assert (p["n_rows"], p["n_cols"], p["n_points"]) == (50, 20, int((X != 0).sum()) + 50)


def test_profile_of_feature_wise_libsvm_counts_all_zero_features(spark, files):
    _, prof = job.build_layout(spark, files["rw_svm"], "row-wise", "libsvm", 0, files["cl"])
    p = prof.first()
    assert (p["n_rows"], p["n_cols"], p["n_points"]) == (20, 50, int((X != 0).sum()) + 20)


def test_transpose_and_class_round_trip(spark, tmp_out, files):
    a = read_instances_text(spark, files["cw"]).coalesce(1).withColumn("pos", F.monotonically_increasing_id())
    long = transpose_long(a, "pos", "features")
    write_cells_text(long, f"{tmp_out}/cells")
    write_class_vector(a, f"{tmp_out}/classes")
    back = {(r["feature"], r["pos"]): r["value"] for r in read_cells_text(spark, f"{tmp_out}/cells", id_type="int").collect()}
    assert back == {(j, i): float(X[i, j]) for i in range(50) for j in range(20)}
    assert {r["pos"]: r["label"] for r in read_class_positions(spark, f"{tmp_out}/classes").collect()} == dict(enumerate(map(float, Y)))


def test_positions_beyond_ten_million_keep_every_class(spark, tmp_out):
    """Tagged lines have no bound where a vector would be cut."""
    rows = [(9_999_998 + i, float(i + 1)) for i in range(4)] + [(3, 9.0)]
    classes = spark.createDataFrame(rows, "pos long, label double")
    write_class_vector(classes, f"{tmp_out}/classes")
    got = read_class_positions(spark, f"{tmp_out}/classes")
    assert sorted((r["pos"], r["label"]) for r in got.collect()) == sorted(rows)
    long = classes.select(F.lit(7).alias("feature"), "pos", F.col("label").alias("value"))
    write_cells_text(long, f"{tmp_out}/cells")
    got = read_cells_text(spark, f"{tmp_out}/cells")
    assert sorted((r["pos"], r["value"]) for r in got.collect()) == sorted(rows)


def test_tagged_lines_are_in_order(spark):
    df = spark.createDataFrame([(f, p, float(f * p)) for p in range(30) for f in (2, 0, 1)], "feature int, pos long, value double")
    lines = [tuple(r)[:2] for r in cell_lines(df).collect()]
    assert lines == sorted(lines) and len(lines) == 90
    got = class_lines(df.where("feature = 1").select("pos", F.col("value").alias("label"))).collect()
    assert [r["line"] for r in got] == [f"{p},{p}" for p in range(30)]


def test_either_class_format_is_read(spark, tmp_path, files):
    one = {r["pos"]: r["label"] for r in read_classes(spark, files["cl"]).collect()}
    tagged = tmp_path / "tagged.csv"
    tagged.write_text("".join(f"{i},{v}\n" for i, v in enumerate(Y)))
    assert {r["pos"]: r["label"] for r in read_classes(spark, str(tagged)).collect()} == one
    bad = tmp_path / "bad.csv"
    bad.write_text("1,0,1\n0,1\n")
    with pytest.raises(ValueError, match="neither"):
        read_classes(spark, str(bad))


def test_tree_label_formula(spark):
    rows = [tuple(int(b) for b in format(i, "08b")) for i in range(256)]
    df = spark.createDataFrame(rows, ", ".join(f"x{i} int" for i in range(1, 9)))
    got = df.select(*[F.col(f"x{i}") for i in range(1, 9)], tree_label([f"x{i}" for i in range(1, 9)]).alias("y"))
    for r in got.collect():
        x = [r[f"x{i}"] for i in range(1, 9)]
        assert r["y"] == (((x[0] & x[1]) | (x[2] & x[3])) & ((x[4] & x[5]) | (x[6] & x[7])))
    with pytest.raises(ValueError):
        tree_label(["x1", "x2", "x3"])


def test_job_both_layouts(spark, capsys, files):
    rows = job.run([files["cw"], "column-wise", "5", "csv", "0", "InstanceWiseMRMR"], spark)
    want = select(X, Y, 5, candidates=[j for j in range(20) if X[:, j].any()])
    assert [r["name"] for r in rows] == [str(f) for f, _ in want] and rows[0]["score"] == f"{want[0][1]:.3f}"
    assert "n_points" in capsys.readouterr().out
    rows = job.run([files["rw_svm"], "row-wise", "5", "libsvm", "0", "FeatureWiseMRMR", files["cl"]], spark)
    assert [r["name"] for r in rows] == [str(f) for f, _ in select(X, Y, 5)]
    with pytest.raises(ValueError):
        job.run([files["rw"], "diagonal", "5", "csv", "0", "mrmr"], spark)
    with pytest.raises(ValueError):
        job.run([files["rw"], "row-wise", "5", "json", "0", "mrmr"], spark)


def test_estimator_reduces_in_selection_order(spark, files):
    df = read_libsvm(spark, files["cw_svm"])
    model = InfoSelector(3).fit(df)
    assert model.selected == PICKS[:3]
    for r in model.transform(df).collect():
        assert r["selected"] == [r["features"].get(i, 0.0) for i in PICKS[:3]]
    a = read_instances_text(spark, files["cw"])
    red = reduce_to(a, PICKS[:3], keep=["label"], array_col="features").collect()
    assert [list(r)[1:] for r in red] == [[r["features"][i] for i in PICKS[:3]] for r in a.collect()]


def test_estimator_keeps_sparse_vectors_sparse(spark, files):
    from pyspark.ml.linalg import SparseVector
    vec = spark.read.format("libsvm").option("numFeatures", 20).load(files["cw_svm"])
    model = InfoSelector(4).fit(vec)
    assert model.selected == PICKS[:4]
    for r in model.transform(vec).collect():
        assert isinstance(r["selected"], SparseVector)
        assert r["selected"].toArray().tolist() == [r["features"][i] for i in PICKS[:4]]


def test_layout_for_picks_by_schema(spark, files):
    from infosieve import ArrayInstances, MapInstances, VectorInstances, WideInstances, layout_for
    arr = spark.createDataFrame([(1.0, [1.0, 0.0])], "y double, x array<double>")
    mp = spark.createDataFrame([(1.0, {1: 1.0})], "y double, x map<int, double>")
    wide = spark.createDataFrame([(1.0, 2.0, 3.0)], "y double, a double, b double")
    vec = spark.read.format("libsvm").option("numFeatures", 20).load(files["cw_svm"])
    assert isinstance(layout_for(arr, "y", "x", cache=False), ArrayInstances)
    assert isinstance(layout_for(mp, "y", "x", cache=False), MapInstances)
    assert isinstance(layout_for(wide, "y", cache=False), WideInstances)
    assert isinstance(layout_for(vec, "label", "features", cache=False), VectorInstances)


def test_dense_and_sparse_vectors_agree(spark):
    from pyspark.ml.linalg import Vectors
    dense = [(int(Y[i]), Vectors.dense(X[i].astype(float))) for i in range(50)]
    mixed = [(y, v if i % 2 else Vectors.sparse(20, [(j, x) for j, x in enumerate(v.values.tolist()) if x]))
             for i, (y, v) in enumerate(dense)]
    from infosieve import layout_for
    for rows in (dense, mixed):
        df = spark.createDataFrame(rows, ["y", "v"])
        got = select_features(layout_for(df, "y", "v"), 20, "mrmr", all_zero="keep").orderBy("rank").collect()
        assert [r["feature"] for r in got] == [f for f, _ in select(X, Y, 20)]


def test_bernoulli_sample(spark):
    from infosieve.operators.sample import bernoulli_sample
    df = spark.range(2000)
    assert bernoulli_sample(df, 1.0, "id").count() == 2000 and bernoulli_sample(df, 0.0, "id").count() == 0
    a = sorted(r.id for r in bernoulli_sample(df.repartition(4), 0.3, "id", seed=7).collect())
    b = sorted(r.id for r in bernoulli_sample(df.repartition(3), 0.3, "id", seed=7).collect())
    assert a == b and 450 < len(a) < 750 and len(set(a)) == len(a)      # same seed, same rows whatever the layout
    assert a != sorted(r.id for r in bernoulli_sample(df, 0.3, "id", seed=8).collect())


def test_scratch_files_are_deleted(spark):
    import os
    from infosieve.session import drop_scratch, local_path, scratch_path
    path = scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    assert os.path.isdir(local_path(path))
    assert drop_scratch(spark) >= 1 and not os.path.exists(local_path(path))
