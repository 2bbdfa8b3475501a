"""Inputs: every storage kind becomes a lazily evaluated DataFrame."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession

from planloom.plans.model import PlanError, Storage
from planloom.sources.jdbc import AccessToken, connection_properties, equal_parts, option, range_options, without_range
from planloom.sources.lake import lake_settings, locations

__all__ = ["AccessToken", "connection_properties", "lake_settings", "locations", "read_storage"]

log = logging.getLogger(__name__)


def _read_csv(session: SparkSession, storage: Storage, _: AccessToken) -> DataFrame:
    reader = session.read.options(**storage.options)
    if storage.schema:
        reader = reader.schema(storage.schema)
    return reader.csv(locations(storage))


def _read_parquet(session: SparkSession, storage: Storage, _: AccessToken) -> DataFrame:
    reader = session.read.options(**storage.options)
    if storage.schema:
        reader = reader.schema(storage.schema)
    return reader.parquet(*locations(storage))


def _read_jdbc(session: SparkSession, storage: Storage, access_token: AccessToken) -> DataFrame:
    # partitionColumn splits the scan into range queries, predicates (a list of conditions that
    # between them hold for each row once) into one query each.
    options = {key: value for key, value in storage.options.items() if key.lower() != "predicates"}
    predicates = option(storage.options, "predicates")
    properties = connection_properties(options, access_token)
    if not predicates and option(options, "partitionColumn") is None:
        log.warning("one task will read all of %s: set partitionColumn or predicates", storage)
        return session.read.jdbc(storage.uri, storage.table, properties=properties)
    if not predicates:
        given = range_options(options)
        if given is not None:
            return session.read.jdbc(storage.uri, storage.table, properties=properties | given)
        predicates = equal_parts(session, storage, properties)
    properties = without_range(properties)
    if not predicates:
        return session.read.jdbc(storage.uri, storage.table, properties=properties)
    return session.read.jdbc(storage.uri, storage.table, predicates=list(predicates), properties=properties)


_READERS = {"csv": _read_csv, "parquet": _read_parquet, "jdbc": _read_jdbc}


def read_storage(session: SparkSession, storage: Storage, access_token: AccessToken = None) -> DataFrame:
    """A DataFrame over the storage. Only CSV header or type inference and file listing run now."""
    try:
        reader = _READERS[storage.kind]
    except KeyError:
        raise PlanError(f"no reader for {storage}") from None
    return reader(session, storage, access_token)
