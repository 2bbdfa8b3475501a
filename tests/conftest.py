import itertools
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[8]")
        .appName("planloom-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config(
            "spark.driver.extraJavaOptions",
            f"-Dderby.stream.error.file={tmp_path_factory.mktemp('derby') / 'derby.log'}",
        )
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    if session.conf.get("spark.checkpoint.dir", None) is None:
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield session
    session.stop()


_databases = itertools.count()


@pytest.fixture
def database():
    """An empty in-memory database inside the Spark process: (uri, options)."""
    uri = f"jdbc:derby:memory:test{next(_databases)};create=true"
    return uri, {"user": "app", "password": "app", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
