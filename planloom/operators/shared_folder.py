"""Where catalogue flows put the files and tables they write and read back."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings naming a database that every executor can reach.
JDBC_SETTINGS = {key: f"spark.planloom.jdbc.{key}" for key in ("uri", "user", "password", "driver")}


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder the cluster shares; a local one only when Spark itself is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        _require_local(spark, "spark.checkpoint.dir")
        base = tempfile.mkdtemp(prefix="planloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/planloom/{name}-{uuid.uuid4().hex}"


def new_table(spark: SparkSession, name: str) -> tuple[str, str, dict[str, str]]:
    """(uri, table, options) of a table to write.

    Without a configured database this is an in-memory one inside the Spark process, which
    no other process can see: enough for local mode, refused anywhere else.
    """
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    uri = spark.conf.get(JDBC_SETTINGS["uri"], None)
    if uri is not None:
        options = {key: spark.conf.get(JDBC_SETTINGS[key], None) for key in ("user", "password", "driver")}
        return uri, table, {key: value for key, value in options.items() if value is not None}
    _require_local(spark, JDBC_SETTINGS["uri"])
    options = {"user": "app", "password": "app", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    return "jdbc:derby:memory:planloom;create=true", table, options


def _require_local(spark: SparkSession, setting: str) -> None:
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError(f"{setting} must name a place all executors can reach")
