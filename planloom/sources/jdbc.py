"""Connection properties shared by JDBC inputs and JDBC targets."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping, Sequence
from datetime import date, datetime

from pyspark.sql import SparkSession

from planloom.plans.model import Storage

# Fixed value: seconds a connection attempt may take unless the plan says otherwise.
LOGIN_TIMEOUT = "300"
# Connections that a read or a write opens at a time, unless the plan sets numPartitions: a database
# stands far fewer of them than a cluster has cores.
CONNECTIONS = 16
# Rows of a part of a table that is read by a column, where the plan doesn't say how many parts there are.
ROWS_PER_PART = 1_000_000
# Values that one pass over the column counts rows below, and the most passes. Each pass looks 64 times closer where rows are dense.
MARKS = 64
ROUNDS = 24

AccessToken = str | Callable[[], str] | None


def connection_properties(options: Mapping[str, object], access_token: AccessToken = None) -> dict[str, str]:
    """The plan's options plus a login timeout; without a password, the caller's access token.

    JDBC properties are strings, so JSON booleans and numbers are rendered as such.
    """
    properties = {"loginTimeout": LOGIN_TIMEOUT}
    if "password" not in options:
        token = access_token() if callable(access_token) else access_token
        if token is not None:
            # Drivers that take a token want no other credentials beside it.
            properties.update(user="", password="", accessToken=token)
    properties.update({key: _text(value) for key, value in options.items() if value is not None})
    return properties


def _text(value: object) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def option(options: Mapping[str, object], name: str) -> object | None:
    """An option's value; names ignore case."""
    return next((value for key, value in options.items() if key.lower() == name.lower()), None)


def range_options(options: Mapping[str, object]) -> dict[str, str] | None:
    """What a read by ranges with given bounds lacks: a number of connections. None without a column or without both bounds."""
    if any(option(options, name) is None for name in ("partitionColumn", "lowerBound", "upperBound")):
        return None
    return {} if option(options, "numPartitions") else {"numPartitions": str(CONNECTIONS)}


def equal_parts(session: SparkSession, storage: Storage, properties: Mapping[str, str]) -> list[str] | None:
    """Conditions for parts of about equally many rows by the plan's partitionColumn; nulls are a part of their own.

    As many as numPartitions says, or as ROWS_PER_PART asks for, CONNECTIONS at least. The database counts rows below some values of the
    column, spread evenly over the range at first and then over those ranges that hold too many, until no range between two values
    holds more than a quarter of a part, or only one value. Each round is one pass over the column. None for a table without two values.
    """
    quote = session._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(storage.uri).quoteIdentifier
    name = quote(str(option(storage.options, "partitionColumn")))
    plain = without_range(properties)

    def ask(columns: str) -> Sequence:
        query = f"(select {columns} from {storage.table} ranged) counted"
        return session.read.jdbc(storage.uri, query, properties=plain).first()

    rows, known, low, high = ask(f"count(*) as n, count({name}) as known, min({name}) as low, max({name}) as high")
    if not known or low == high:
        return None
    wanted = option(storage.options, "numPartitions")
    parts = int(wanted) if wanted else max(CONNECTIONS, -(-rows // ROWS_PER_PART))
    share = known / parts
    # Values and the number of rows below each; the last value stands for all above.
    below = {low: 0, high: None}
    for _ in range(ROUNDS):
        points = sorted(below)
        counts = [known if below[point] is None else below[point] for point in points]
        heavy = [n for n in range(len(points) - 1) if counts[n + 1] - counts[n] > share / 4]
        marks = [mark for n in heavy for mark in _between(points[n], points[n + 1], max(1, MARKS // len(heavy))) if mark not in below]
        if not marks:
            break
        for start in range(0, len(marks), MARKS):
            asked = marks[start : start + MARKS]
            counted = ask(", ".join(f"count(case when {name} < {_literal(mark)} then 1 end) as n{n}" for n, mark in enumerate(asked)))
            below |= dict(zip(asked, counted, strict=True))
    below.pop(high)
    cuts = []
    for part in range(1, parts):
        cut = next((point for point in sorted(below) if below[point] >= part * share), None)
        if cut is not None and cut != low and cut not in cuts:
            cuts.append(cut)
    literals = [_literal(cut) for cut in cuts]
    bounds = [(None, literals[0]), *itertools.pairwise(literals), (literals[-1], None)] if literals else [(None, None)]
    conditions = []
    for first, last in bounds:
        sides = ([f"{name} >= {first}"] if first else []) + ([f"{name} < {last}"] if last else [])
        conditions.append(" and ".join(sides) or f"{name} is not null")
    return conditions + ([f"{name} is null"] if known < rows else [])


def _between(low: object, high: object, count: int) -> list:
    """Up to `count` values between two, evenly spread."""
    if isinstance(low, int):
        return sorted({low + (high - low) * n // (count + 1) for n in range(1, count + 1)} - {low, high})
    step = (high - low) / (count + 1)
    values = [low + step * n for n in range(1, count + 1)]
    return sorted({value for value in values if low < value < high})


def _literal(value: object) -> str:
    """A value in the database's SQL; times by the escapes that drivers translate."""
    if isinstance(value, datetime):
        return f"{{ts '{value:%Y-%m-%d %H:%M:%S.%f}'}}"
    if isinstance(value, date):
        return f"{{d '{value:%Y-%m-%d}'}}"
    return f"({value!r})" if isinstance(value, (int, float)) else f"({value})"


# The options of a range-partitioned read.
_RANGE_OPTIONS = {"partitioncolumn", "lowerbound", "upperbound", "numpartitions"}


def without_range(properties: Mapping[str, object]) -> dict[str, object]:
    return {key: value for key, value in properties.items() if key.lower() not in _RANGE_OPTIONS}
