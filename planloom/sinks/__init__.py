"""Targets: files are appended to, tables are overwritten, unless the plan sets `mode`."""

from __future__ import annotations

from pyspark.sql import DataFrame

from planloom.plans.model import PlanError, Storage
from planloom.sinks.staged import write_staged
from planloom.sources import AccessToken, connection_properties, locations
from planloom.sources.jdbc import CONNECTIONS, option

__all__ = ["write_storage"]


def _one_location(storage: Storage) -> str:
    paths = locations(storage)
    if len(paths) != 1:
        raise PlanError(f"a target is written to one path, not {len(paths)}: {storage}")
    return paths[0]


def _write_csv(frame: DataFrame, storage: Storage, _: AccessToken) -> None:
    frame.write.options(**storage.options).mode(storage.mode or "append").csv(_one_location(storage))


def _write_parquet(frame: DataFrame, storage: Storage, _: AccessToken) -> None:
    options = dict(storage.options)
    columns = options.pop("partitionBy", None) or []
    if isinstance(columns, str):
        columns = [column.strip() for column in columns.split(",")]
    writer = frame.write.options(**options).mode(storage.mode or "append")
    if columns:
        writer = writer.partitionBy(*columns)
    writer.parquet(_one_location(storage))


def _write_jdbc(frame: DataFrame, storage: Storage, access_token: AccessToken) -> None:
    # numPartitions is the number of concurrent connections, batchsize the rows per round trip. The frame is dealt anew to that many
    # tasks: Spark's writer would squeeze the whole stage that makes the rows into them.
    options = {key: value for key, value in storage.options.items() if key.lower() != "staged"}
    connections = int(option(options, "numPartitions") or CONNECTIONS)
    properties = connection_properties(options, access_token)
    if str(option(storage.options, "staged")).lower() == "false":
        frame = frame.repartition(connections)
        frame.write.jdbc(storage.uri, storage.table, mode=storage.mode or "overwrite", properties=properties)
    else:
        write_staged(frame, storage, properties, connections)


_WRITERS = {"csv": _write_csv, "parquet": _write_parquet, "jdbc": _write_jdbc}


def write_storage(frame: DataFrame, storage: Storage, access_token: AccessToken = None) -> None:
    """Run the job that computes `frame` and stores it."""
    try:
        writer = _WRITERS[storage.kind]
    except KeyError:
        raise PlanError(f"no writer for {storage}") from None
    writer(frame, storage, access_token)
