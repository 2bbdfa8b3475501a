"""Queries that SQL can express, against it."""

import pytest
from oracle import assert_same, oracle_connection

import __spark_entry__ as contract
from planloom.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, name):
    assert contract.oracle_sql()[name] == ORACLES[name]
    with oracle_connection(SMALL) as connection:
        assert_same(QUERIES[name](spark, SMALL).toArrow(), connection.sql(ORACLES[name]).to_arrow_table())
