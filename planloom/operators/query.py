"""A catalogue entry: a plan over the given tables and, where SQL can say it, an independent check."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from planloom.plans import Plan, Storage, Transformation
from planloom.runner import open_plan


@dataclass(frozen=True)
class Query:
    """`steps` are (view id, SQL) pairs over `tables`; `oracle` is ANSI-style SQL for the same rows.

    `result` is what a target of the plan would write: by default the last view.
    """

    name: str
    tables: tuple[str, ...]
    steps: tuple[tuple[str, str], ...]
    oracle: str | None = None
    result: str | None = None

    def plan(self, table_dir: str) -> Plan:
        return Plan(
            inputs=tuple(parquet_input(table_dir, table) for table in self.tables),
            transformations=tuple(Transformation(view_id, sql) for view_id, sql in self.steps),
        )

    def __call__(self, spark: SparkSession, table_dir: str) -> DataFrame:
        opened = open_plan(spark, self.plan(table_dir))
        return opened.relation(self.result or self.steps[-1][0])


def parquet_input(table_dir: str, table: str) -> Storage:
    return Storage("parquet", id=table, path=f"{table_dir}/{table}.parquet")


def one_step(name: str, tables: str, sql: str, oracle: str | None = None) -> Query:
    """A single transformation; without `oracle` the same text is valid for the checking engine."""
    return Query(name, tuple(tables.split()), (("result", sql),), sql if oracle is None else oracle)
