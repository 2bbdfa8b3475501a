"""Writing a database table so that each row arrives once, however often a task runs, and all rows at once.

Spark's writer commits partition by partition: a task that is lost after its commit runs again and inserts its rows twice, and a job that
fails halfway leaves a table half written, the old one already gone. Here rows first go to a staging table, each marked with its
partition and the attempt of the task that wrote it. When the job is done, one transaction moves one attempt of each partition to the
target. An attempt's rows are there together or not at all, since Spark commits them together.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from planloom.plans.model import PlanError, Storage
from planloom.sources.jdbc import option

log = logging.getLogger(__name__)


def write_staged(frame: DataFrame, storage: Storage, properties: Mapping[str, str], connections: int) -> None:
    """`frame` as the rows of the storage's table, by the storage's mode.

    An overwritten table of the same columns and types (with the option `truncate`, of the same columns) keeps its definition, indexes and rights, and its old rows until the new ones
    replace them; others are created anew right before the move. `properties` are those of the connection. Rows are dealt to
    `connections` tasks, so the work that makes them keeps its own number of tasks.
    """
    session, mode = frame.sparkSession, (storage.mode or "overwrite").lower()
    there = _schema(session, storage.uri, storage.table, properties)
    if there is not None and mode in ("error", "errorifexists"):
        raise PlanError(f"{storage} exists")
    if there is not None and mode == "ignore":
        return
    stage = f"{storage.table.rstrip('\"`]')}_{uuid.uuid4().hex[:12]}{storage.table[len(storage.table.rstrip('\"`]')) :]}"
    marks = _marks(frame.columns)
    try:
        stage_rows(frame.repartition(connections), storage.uri, stage, properties, marks)
        keep = there is not None and (mode == "append" or _fits(there, _schema(session, storage.uri, stage, properties), marks, properties))
        if not keep:
            frame.limit(0).write.jdbc(storage.uri, storage.table, mode="overwrite", properties=dict(properties))
        move_rows(session, storage.uri, stage, storage.table, frame.columns, marks, properties, clear=keep and mode == "overwrite")
    finally:
        _drop(session, storage.uri, stage, properties)


def _marks(columns: list[str]) -> tuple[str, str]:
    taken = {column.lower() for column in columns}
    names = []
    for name in ("written_by_part", "written_by_attempt"):
        while name in taken:
            name += "_"
        names.append(name)
    return names[0], names[1]


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    for batch in batches:
        marks = (pa.array([context.partitionId()] * batch.num_rows, pa.int32()),
                 pa.array([context.taskAttemptId()] * batch.num_rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([*batch.columns, *marks], [str(n) for n in range(batch.num_columns + 2)])


def stage_rows(frame: DataFrame, uri: str, stage: str, properties: Mapping[str, str], marks: tuple[str, str], mode: str = "errorifexists") -> None:
    """Writes the rows to the staging table, each with its partition and the task's attempt."""
    kinds = StructType([*frame.schema.fields, StructField(marks[0], IntegerType()), StructField(marks[1], LongType())])
    # By place: names may repeat up to their case.
    plain = frame.toDF(*(str(n) for n in range(len(frame.columns))))
    numbered = StructType([StructField(str(n), field.dataType, field.nullable) for n, field in enumerate(kinds)])
    rows = plain.mapInArrow(_marked, numbered).toDF(*kinds.names)
    rows.write.jdbc(uri, stage, mode=mode, properties=dict(properties))


def move_rows(
    session: SparkSession, uri: str, stage: str, table: str, columns: list[str], marks: tuple[str, str], properties: Mapping[str, str], clear: bool
) -> None:
    """In one transaction: the target's rows go, if `clear`, and one attempt of each staged partition comes."""
    dialect = session._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(uri)
    names = [dialect.quoteIdentifier(column) for column in columns]
    part, attempt = map(dialect.quoteIdentifier, marks)
    # No name of a column may hide one of these.
    move = (
        f"insert into {table} ({', '.join(names)}) select {', '.join(f's.{name}' for name in names)} from {stage} s join "
        f"(select {part} as p, min({attempt}) as a from {stage} group by {part}) m on s.{part} = m.p and s.{attempt} = m.a"
    )
    _execute(session, uri, properties, [*([f"delete from {table}"] if clear else []), move])


def _execute(session: SparkSession, uri: str, properties: Mapping[str, str], statements: list[str]) -> None:
    """Runs the statements in one transaction on a connection of the driver's."""
    jvm = session._jvm
    options = jvm.java.util.HashMap()
    for key, value in properties.items():
        options.put(key, value)
    scala_options = jvm.org.apache.spark.api.python.PythonUtils.toScalaMap(options)
    jdbc = jvm.org.apache.spark.sql.execution.datasources.jdbc.JDBCOptions(uri, "unused", scala_options)
    connection = jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(uri).createConnectionFactory(jdbc).apply(-1)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        try:
            for text in statements:
                statement.executeUpdate(text)
            connection.commit()
        except BaseException:
            connection.rollback()
            raise
        finally:
            statement.close()
    finally:
        connection.close()


def _drop(session: SparkSession, uri: str, stage: str, properties: Mapping[str, str]) -> None:
    if _schema(session, uri, stage, properties) is None:
        return
    try:
        _execute(session, uri, properties, [f"drop table {stage}"])
    except Exception as error:
        log.warning("the staging table %s is left: %s", stage, type(error).__name__)


def _schema(session: SparkSession, uri: str, table: str, properties: Mapping[str, str]) -> StructType | None:
    """The columns of a table; None if there is none."""
    try:
        return session.read.jdbc(uri, table, properties=dict(properties)).schema
    except PySparkException:
        return None
    except Exception as error:
        # What the driver says of a missing table reaches Python as it is.
        if "SQLException" in str(error) or "SQLSyntaxError" in str(error):
            return None
        raise


def _fits(there: StructType, staged: StructType, marks: tuple[str, str], properties: Mapping[str, str]) -> bool:
    """Whether a table has the columns and types of the staged rows; with the option `truncate`, the columns alone."""
    skipped, names_only = {name.lower() for name in marks}, str(option(properties, "truncate")).lower() == "true"
    kinds = [
        [(f.name.lower(), None if names_only else f.dataType.simpleString()) for f in schema if f.name.lower() not in skipped]
        for schema in (there, staged)
    ]
    return kinds[0] == kinds[1]
