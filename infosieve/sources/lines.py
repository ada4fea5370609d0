"""Lines that hold a whole vector (A13, A14), written and read in parts of any size.

Every field is a row of its own and the field separator is Spark's line separator, so neither side ever holds
a line: the writer sorts fields by range over the tasks, the reader takes file splits of any line.  The files
of a folder, in name order, make the text (``hadoop fs -getmerge`` or ``concat`` joins them); one file of the
same text reads alike.

Spark ends each row with the separator.  The last field of a line therefore shares its row with the line
feed and the next line's id, and the very last one is a file of its own, ``part-tail``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.cells import col_of
from ..operators.transpose import value_text
from ..session import scratch_path
from .text import _SEPS

TAIL = "part-tail"


def _one_byte(sep: str) -> str:
    sep = _SEPS.get(sep, sep)
    if len(sep.encode()) != 1 or sep in "\r\n":
        raise ValueError(f"a separator of one byte is needed, not {sep!r}")
    return sep


def _checked(cells: DataFrame, key: list[str]) -> int:
    """The length n of the vectors; all must hold positions 0 ... n - 1 once each."""
    per = cells.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count("pos").alias("known"), F.min("pos").alias("lo"),
                                  F.max("pos").alias("hi"), F.count("text").alias("texts"))
    r = per.agg(F.min("n").alias("n"), F.max("n").alias("most"), F.min("known").alias("known"), F.min("texts").alias("texts"),
                F.min("lo").alias("lo"), F.max("lo").alias("lo2"), F.min("hi").alias("hi"), F.max("hi").alias("hi2")).first()
    n = r["n"]
    if not n:
        raise ValueError("no values to write")
    if (r["most"], r["known"], r["texts"], r["lo"], r["lo2"], r["hi"], r["hi2"]) != (n, n, n, 0, 0, n - 1, n - 1):
        raise ValueError("every vector needs a value at each position 0 ... n - 1")
    if cells.groupBy(*key, "pos").count().where("count > 1").limit(1).count():
        raise ValueError("a position has more than one value")
    return n


def _write(fields: DataFrame, order: list[str], last, path: str, sep: str, mode: str) -> None:
    """``text`` of all rows in order; the row where ``last`` holds ends the file."""
    spark = fields.sparkSession
    (fields.where(~last).repartitionByRange(*order).sortWithinPartitions(*order).select("text")
     .write.mode(mode).option("lineSep", sep).text(path))
    fields.where(last).select("text").coalesce(1).write.mode("overwrite").text(f"{path}/_tail")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    held = hadoop.Path(f"{path}/_tail")
    fs = held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in fs.globStatus(hadoop.Path(f"{path}/_tail/part-*")):
        if f.getLen() and not fs.rename(f.getPath(), hadoop.Path(f"{path}/{TAIL}")):
            raise OSError(f"{path}/{TAIL} exists")
    fs.delete(held, True)


def write_class_line(classes: DataFrame, path: str, pos: str = "pos", label: str = "label", sep: str = ",",
                     mode: str = "overwrite") -> None:
    """The labels of positions 0 ... n - 1 as one line ``l0,l1,...``; a missing or repeated position, a null
    and an empty table raise."""
    sep = _one_byte(sep)
    cells = classes.select(col_of(pos).cast("long").alias("pos"), value_text(classes, label).alias("text"))
    n = _checked(cells, [])
    _write(cells, ["pos"], F.col("pos") == n - 1, path, sep, mode)


def _successors(ids: DataFrame) -> DataFrame:
    """``feature, next``: of each id the one after it.  Ranges are sorted in parallel; only the first id of
    each range meets the others'."""
    spark, path = ids.sparkSession, scratch_path(ids.sparkSession, "line-ids")
    ids.repartitionByRange("feature").select("feature", F.spark_partition_id().alias("range")).write.parquet(path)
    kept = spark.read.parquet(path)
    following = (kept.groupBy("range").agg(F.min("feature").alias("first"))
                 .select("range", F.lead("first").over(Window.orderBy("range")).alias("following")))
    inside = kept.withColumn("next", F.lead("feature").over(Window.partitionBy("range").orderBy("feature")))
    return inside.join(following, "range").select("feature", F.coalesce("next", "following").alias("next"))


def write_feature_lines(long: DataFrame, path: str, sep: str = ",", mode: str = "overwrite") -> None:
    """Cells ``(feature, pos, value)`` as a line ``id,v0,v1,...`` per feature, by ascending id; every
    feature needs a value at each position 0 ... n - 1, zeros included."""
    sep = _one_byte(sep)
    cells = long.select("feature", F.col("pos").cast("long").alias("pos"), value_text(long, "value").alias("text"))
    n = _checked(cells, ["feature"])
    after = _successors(cells.where("pos = 0").select("feature"))
    first = after.agg(F.min("feature")).first()[0]
    if first is None or cells.where(F.col("feature").isNull()).limit(1).count():
        raise ValueError("a feature needs an id")
    ends = (cells.where(F.col("pos") == n - 1).join(after, "feature")
            .select("feature", "pos", F.when(F.col("next").isNull(), F.col("text"))
                    .otherwise(F.concat("text", F.lit("\n"), F.col("next").cast("string"))).alias("text"),
                    F.col("next").isNull().alias("last")))
    head = cells.where((F.col("feature") == F.lit(first)) & (F.col("pos") == 0)).select(
        "feature", F.lit(-1).cast("long").alias("pos"), F.col("feature").cast("string").alias("text"), F.lit(False).alias("last"))
    inner = cells.where(F.col("pos") < n - 1).withColumn("last", F.lit(False))
    _write(inner.unionByName(ends).unionByName(head), ["feature", "pos"], F.col("last"), path, sep, mode)


def _fields(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """``i, text``: all fields of the files numbered through; ``more`` tells whether others follow.

    A task reads its split's fields in order, so a field's number is its place in the split after
    the fields of all splits before; those sums are one row per split."""
    scan = (spark.read.option("lineSep", sep).text(path)
            .select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at")))
    name = F.element_at(F.split("file", "/"), -1)
    in_order = Window.orderBy(name.startswith(TAIL), F.length(name), name, "start")
    splits = scan.groupBy("file", "start").agg(F.min("at").alias("base"), F.count(F.lit(1)).alias("n"))
    splits = splits.select("file", "start", "base", (F.sum("n").over(in_order) - F.col("n")).alias("before"),
                           F.sum("n").over(Window.partitionBy()).alias("total"))
    i = F.col("before") + F.col("at") - F.col("base")
    return (scan.join(splits, ["file", "start"])
            .select(i.alias("i"), (i < F.col("total") - 1).alias("more"), F.regexp_replace("text", "\r", "").alias("text")))


def _whole(fields: DataFrame, path: str) -> None:
    """Files that Spark wrote need the last one, or a line feed at their end."""
    names = [f.rsplit("/", 1)[-1] for f in fields.sparkSession.read.text(path).inputFiles()]
    if any(f.startswith("part-") for f in names) and TAIL not in names:
        last = fields.where("NOT more").select("text").first()
        if last is None or not last[0].endswith("\n"):
            raise ValueError(f"{path} has no {TAIL}: its writer did not finish")


def read_class_line(spark: SparkSession, path: str, sep: str = ",", label_type: str = "double") -> DataFrame:
    """``(pos LONG, label)`` of one line of labels, read in splits.  A second line, an empty label and a folder
    whose writer did not finish raise."""
    fields = _fields(spark, path, _one_byte(sep))
    _whole(fields, path)
    text = F.trim(F.when(F.col("more"), F.col("text")).otherwise(F.regexp_replace("text", "\n+$", "")))
    wrong = F.raise_error(F.lit(f"{path}: a class vector is one line of labels, none empty"))
    label = F.when((F.length(text) == 0) | text.contains("\n"), wrong.cast("string")).otherwise(text)
    return fields.select(F.col("i").alias("pos"), label.cast(label_type).alias("label"))


def read_feature_lines(spark: SparkSession, path: str, sep: str = ",", id_type: str = "string",
                       value_type: str = "double") -> DataFrame:
    """``(feature, pos, value)`` of lines ``id,v0,v1,...`` of one length, read in splits.  Lines of
    different lengths, lines of an id alone and a folder whose writer did not finish raise."""
    fields = _fields(spark, path, _one_byte(sep))
    _whole(fields, path)
    n = fields.agg(F.coalesce(F.min(F.when(F.col("text").contains("\n"), F.col("i"))), F.max("i"))).first()[0]
    if not n:
        raise ValueError(f"{path} holds no lines of an id and values")
    edge = F.col("i") % n == 0
    text = F.when(F.col("more"), F.col("text")).otherwise(F.regexp_replace("text", "\n+$", ""))
    part = F.split(text, "\n")
    wide = F.when((F.col("i") > 0) & edge & F.col("more"), 2).otherwise(1)
    wrong = F.raise_error(F.lit(f"{path}: lines differ in length")).cast("array<string>")
    part = F.when((F.size(part) == wide) & (F.col("more") | edge), part).otherwise(wrong)
    fields = fields.select("i", "more", edge.alias("edge"), part.alias("part"))
    ids = fields.where("edge and more").select(F.floor(F.col("i") / n).alias("line"),
                                               F.trim(F.element_at("part", -1)).cast(id_type).alias("feature"))
    values = fields.where("i > 0").select(F.floor((F.col("i") - 1) / n).alias("line"), ((F.col("i") - 1) % n).alias("pos"),
                                          F.trim(F.col("part")[0]).cast(value_type).alias("value"))
    return values.join(ids, "line").select("feature", "pos", "value")
