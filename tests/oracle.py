"""Comparing a Spark result with the oracle's: column names, types, and the bag of rows."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pyarrow as pa

TEST_DATA = Path("/root/testdata")

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def oracle_connection(table_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.sql("set timezone = 'UTC'")
    for table in TABLES:
        connection.sql(f"create view {table} as select * from read_parquet('{table_dir}/{table}.parquet')")
    return connection


def type_name(kind: pa.DataType) -> str:
    if pa.types.is_large_string(kind) or pa.types.is_string(kind):
        return "string"
    if pa.types.is_timestamp(kind):
        return "timestamp" if kind.tz is None else "timestamp with zone"
    return str(kind)


def shape(table: pa.Table) -> dict[str, str]:
    return {field.name: type_name(field.type) for field in table.schema}


def rows(table: pa.Table) -> Counter:
    table = table.select(sorted(table.column_names))
    return Counter(zip(*(map(repr, column.to_pylist()) for column in table.columns), strict=True))


def assert_same(actual: pa.Table, expected: pa.Table) -> None:
    assert shape(actual) == shape(expected)
    got, wanted = rows(actual), rows(expected)
    if got != wanted:
        missing, extra = wanted - got, got - wanted
        raise AssertionError(
            f"{actual.num_rows} rows against {expected.num_rows}; columns {sorted(actual.column_names)}; "
            f"missing {missing.total()} such as {list(missing)[:3]}; extra {extra.total()} such as {list(extra)[:3]}"
        )
