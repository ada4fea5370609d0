"""Lines of whole vectors: written and read in parts."""

import glob
import os

import pytest

from infosieve import sources


def text_of(path):
    parts = [p for p in sorted(glob.glob(f"{path}/part-*")) if os.path.getsize(p)]
    return "".join(open(p).read() for p in parts), len(parts)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def small_splits(spark):
    small = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("n", [1, 2, 5, 1000])
def test_class_line(spark, tmp_out, small_splits, n):
    want = [(i, i * 7 % 11) for i in range(n)]
    path = f"{tmp_out}/line"
    sources.write_class_line(spark.createDataFrame(want[::-1], "pos long, label int").repartition(3), path)
    text, files = text_of(path)
    assert text == ",".join(str(v) for _, v in want) + "\n"
    assert files > 2 or n < 1000
    assert rows(sources.read_class_line(spark, path, label_type="int")) == want
    whole = f"{tmp_out}/one.csv"
    for end in ("\n", "\r\n", ""):
        with open(whole, "w", newline="") as f:
            f.write(text.rstrip("\n") + end)
        assert rows(sources.read_class_line(spark, whole, label_type="int")) == want
    with open(whole, "w") as f:
        f.write(text)
    assert rows(sources.read_class_vector(spark, whole)) == want


@pytest.mark.parametrize("m, n", [(1, 1), (1, 4), (3, 1), (12, 40), (40, 2)])
def test_feature_lines(spark, tmp_out, small_splits, m, n):
    want = sorted((3 * f + 1, p, float((f + 1) * (p + 2) % 5)) for f in range(m) for p in range(n))
    path = f"{tmp_out}/lines"
    sources.write_feature_lines(spark.createDataFrame(want[::-1], "feature long, pos long, value double").repartition(5), path)
    text, _ = text_of(path)
    assert text == "".join(",".join([str(3 * f + 1), *(str((f + 1) * (p + 2) % 5) for p in range(n))]) + "\n" for f in range(m))
    assert rows(sources.read_feature_lines(spark, path, id_type="long")) == want
    whole = f"{tmp_out}/one.csv"
    for end in ("\n", ""):
        with open(whole, "w") as f:
            f.write(text.rstrip("\n") + end)
        assert rows(sources.read_feature_lines(spark, whole, id_type="long")) == want


def test_tabs_and_string_ids(spark, tmp_out):
    want = [("a b", 0, "x"), ("a b", 1, "y"), ("é", 0, "z"), ("é", 1, "")]
    sources.write_feature_lines(spark.createDataFrame(want, "feature string, pos int, value string"), f"{tmp_out}/t", "tsv")
    assert text_of(f"{tmp_out}/t")[0] == "a b\tx\ty\né\tz\t\n"
    assert rows(sources.read_feature_lines(spark, f"{tmp_out}/t", "tsv", value_type="string")) == want


@pytest.mark.parametrize("cells", [[], [(0, 1), (2, 1)], [(0, 1), (0, 1)], [(0, 1), (1, None)], [(None, 1), (0, 1)], [(1, 1), (2, 1)],
                                   [(0, 1), (1, 1), (1, 1), (3, 1)]])
def test_vectors_with_gaps_raise(spark, tmp_out, cells):
    with pytest.raises(ValueError):
        sources.write_class_line(spark.createDataFrame(cells, "pos long, label int"), f"{tmp_out}/x")
    with pytest.raises(ValueError):
        sources.write_feature_lines(spark.createDataFrame([(1, *c) for c in cells], "feature int, pos long, value int"), f"{tmp_out}/y")


def test_malformed_lines_raise(spark, tmp_out):
    def file(text):
        with open(f"{tmp_out}/bad.csv", "w") as f:
            f.write(text)
        return f"{tmp_out}/bad.csv"

    for text in ("1,0\n1,1\n", "1,,0\n", "1,0\n\n1\n"):
        with pytest.raises(Exception, match="one line of labels"):
            sources.read_class_line(spark, file(text)).collect()
    for text in ("1,0,1\n2,0\n", "1,0\n2,0,1\n", "1,0,1\n2,0,1,1\n3,0\n", "1,0,1\n2\n"):
        with pytest.raises(Exception, match="differ in length"):
            sources.read_feature_lines(spark, file(text)).collect()
    for text in ("", "1\n"):
        with pytest.raises(ValueError, match="no lines"):
            sources.read_feature_lines(spark, file(text))
    with pytest.raises(ValueError, match="separator"):
        sources.read_class_line(spark, file("1,2\n"), "::")


def test_unfinished_folder_raises(spark, tmp_out):
    sources.write_class_line(spark.range(50).selectExpr("id AS pos", "id % 2 AS label"), f"{tmp_out}/line")
    os.remove(f"{tmp_out}/line/part-tail")
    with pytest.raises(ValueError, match="did not finish"):
        sources.read_class_line(spark, f"{tmp_out}/line")
