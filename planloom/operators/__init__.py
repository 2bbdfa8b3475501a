"""The catalogue: every query as a plan, with an oracle wherever SQL can express one."""

from planloom.operators import aggregates, flows, intervals, joins, more_flows, more_sql, ordering, projections, scalars, windows
from planloom.operators.flows import Flow
from planloom.operators.query import Query

CATALOGUE: dict[str, Query | Flow] = {
    query.name: query
    for module in (projections, joins, intervals, aggregates, windows, ordering, scalars, more_sql)
    for query in module.QUERIES
} | {flow.name: flow for module in (flows, more_flows) for flow in module.FLOWS}

__all__ = ["CATALOGUE", "Flow", "Query"]
