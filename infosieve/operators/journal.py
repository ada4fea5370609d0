"""Journal of a selection: what a new driver needs to go on after the last finished iteration.

Folder layout: ``counts`` and ``state-<i>`` are Parquet tables, ``iteration-<i>`` holds the picks so far, the
state's name and the settings.  A table counts only with its ``_SUCCESS`` mark, and the picks of an iteration are
written last, so a driver lost at any moment leaves a journal that ends with a whole iteration.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Journal:
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _fs(self, spark: SparkSession):
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder

    def _whole(self, spark: SparkSession) -> list[str]:
        """Names of the tables that were written to the end."""
        fs, folder = self._fs(spark)
        if not fs.exists(folder):
            return []
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(n for n in names if fs.exists(path(f"{self.path}/{n}/_SUCCESS")))

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a table of the journal."""
        schema = df.schema
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self._read(df.sparkSession, name, schema)

    def _read(self, spark: SparkSession, name: str, schema: T.StructType | None = None) -> DataFrame:
        reader = spark.read if schema is None else spark.read.schema(schema)
        out = reader.parquet(f"{self.path}/{name}")
        out.journal_name = name
        return out

    def name_of(self, df: DataFrame) -> str:
        return df.journal_name

    def note(self, spark: SparkSession, iteration: int, picked: list, base: int, state: str, settings: str,
             schema: T.StructType) -> None:
        """Iteration ``iteration`` is finished: its picks and where its state lies."""
        rows = [(j, tuple(r[c] for c in schema.fieldNames())) for j, r in enumerate(picked, 1)] or [(0, None)]
        kind = T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("pick", schema)])
        (spark.createDataFrame(rows, kind).coalesce(1)
         .select("*", F.lit(iteration).alias("iteration"), F.lit(base).alias("base"), F.lit(state).alias("state"),
                 F.lit(settings).alias("settings")).write.mode("overwrite").parquet(f"{self.path}/iteration-{iteration:04d}"))
        fs, _ = self._fs(spark)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for old in self._whole(spark):
            if old.startswith("state-") and old < state:
                fs.delete(path(f"{self.path}/{old}"), True)

    def last(self, spark: SparkSession, settings: str) -> dict | None:
        """The last finished iteration; None for an empty journal.  Raises if it is another selection's."""
        whole = self._whole(spark)
        notes = [n for n in whole if n.startswith("iteration-")]
        if not notes:
            return None
        rows = self._read(spark, notes[-1]).orderBy("rank").collect()
        if rows[0]["settings"] != settings:
            raise ValueError(f"the journal {self.path} is of another selection: {rows[0]['settings']}, not {settings}")
        return {"iteration": rows[0]["iteration"], "base": rows[0]["base"], "picked": [r["pick"] for r in rows if r["rank"]],
                "state": self._read(spark, rows[0]["state"]), "counts": self._read(spark, "counts")}
