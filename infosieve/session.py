"""Spark session and shared-folder helpers.

The selection loop cuts lineage with reliable ``checkpoint()`` calls, and the scan
round-trip queries write their files next to the checkpoints.  Both use the folder the
cluster names in ``spark.checkpoint.dir``; a private one is only created when that
setting is missing and Spark runs in local mode (tests, laptops).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app_name: str = "infosieve",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, creating a private one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not _is_local(spark):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder (HDFS, S3, ...)")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="infosieve-ckpt-"))
    return sc.getCheckpointDir()


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder, for files a job writes and reads back."""
    base = ensure_checkpoint_dir(spark)
    _SCRATCH.append(base.rstrip("/") + f"/{name}-{uuid.uuid4().hex[:12]}")
    return _SCRATCH[-1]


def drop_scratch(spark: SparkSession) -> int:
    """Delete all scratch paths this process has made; call it once their results are used up."""
    conf, done = spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _SCRATCH:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        done += bool(path.getFileSystem(conf).delete(path, True))
    return done


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme so plain Python can look at a local folder (tests only)."""
    return path[5:] if path.startswith("file:") else path


__all__ = ["build_session", "ensure_checkpoint_dir", "scratch_path", "drop_scratch", "local_path"]
