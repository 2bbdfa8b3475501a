"""Every registered query against its oracle, on whole tables."""

import re

import pytest
from oracle import TEST_DATA, assert_same, oracle_connection, rows

import __spark_entry__ as contract
from planloom.operators import CATALOGUE

SCALE = str(TEST_DATA / "sf0.01")


@pytest.fixture(scope="module")
def oracle():
    with oracle_connection(SCALE) as connection:
        yield connection


@pytest.mark.filterwarnings("ignore:view 'supplier' is defined more than once")
@pytest.mark.parametrize("name", [name for name, query in CATALOGUE.items() if query.oracle is not None])
def test_equals_oracle(spark, oracle, name):
    result = contract.queries()[name](spark, SCALE).toArrow()
    assert result.num_rows > 0
    assert_same(result, oracle.sql(contract.oracle_sql()[name]).to_arrow_table())


def test_every_catalogue_query_has_an_oracle():
    assert set(CATALOGUE) <= set(contract.oracle_sql())


def test_dirty_rows_end_no_query(spark, tmp_path):
    """Values beyond the range of integers, malformed addresses, and dates centuries apart."""
    spark.sql("""
        select * from values (1L, timestamp_ntz'2024-01-01 00:00:00', 7L, 'view', 5e9D, '{}'),
                             (2L, null, 7L, 'view', double('nan'), null), (3L, null, null, null, 1e300D, 'x')
        as t(event_id, ts, user_id, event_type, value, props)
    """).write.parquet(str(tmp_path / "events.parquet"))
    spark.sql("select * from values (1L, 'http://[bad', 'x'), (2L, null, null) as t(page_id, url, html)").write.parquet(
        str(tmp_path / "pages.parquet"))
    spark.sql("""
        select * from values (1L, 1L, 'F', 1D, timestamp_ntz'1650-01-01 00:00:00', 'x'),
                             (2L, 1L, 'F', 1D, timestamp_ntz'2024-01-01 00:00:00', 'x')
        as t(o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority)
    """).write.parquet(str(tmp_path / "orders.parquet"))
    bits = {row.user_id: row.any_bits for row in CATALOGUE["a19_counting"](spark, str(tmp_path)).collect()}
    assert bits == {7: 5 * 10**9, None: None}
    assert {row.page_id: row.host for row in CATALOGUE["x13_urls"](spark, str(tmp_path)).collect()} == {1: None, 2: None}
    years = CATALOGUE["q2_recursive_cte"](spark, str(tmp_path)).collect()
    assert sorted((row.y, row.orders) for row in years) == [(y, int(y in (1650, 2024))) for y in range(1650, 2025)]


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.columns == ["r_name", "n_name", "revenue", "lines"]
    assert rows(frame.toArrow()).total() > 0


def test_every_catalogue_row_of_the_survey_is_registered():
    wanted = [f"{letter}{number}" for letter, count in
              {"p": 3, "f": 7, "j": 14, "a": 18, "w": 7, "s": 2, "u": 6, "x": 11, "q": 5, "y": 2}.items()
              for number in range(1, count + 1)] + ["e1", "e2", "e3", "e4", "e5", "e7"]
    present = {re.match(r"[a-z]+\d+", name).group() for name in CATALOGUE}
    assert set(wanted) <= present
