import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[4]").appName("infosieve-tests")
         .config("spark.driver.memory", "6g")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="infosieve-test-ckpt-"))
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(autouse=True, scope="module")
def clean_session():
    """One JVM serves all files: nothing cached or stored by a file outlives it."""
    yield
    from pyspark.sql import SparkSession
    s = SparkSession.getActiveSession()
    if s is not None:
        import gc

        from infosieve.session import drop_scratch
        s.catalog.clearCache()
        drop_scratch(s)
        gc.collect()
        s._jvm.System.gc()


@pytest.fixture
def tmp_out(tmp_path):
    return str(tmp_path)
