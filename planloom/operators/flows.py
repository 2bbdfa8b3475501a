"""End-to-end flows (E and the source, sink and run rows they stand for).

Each flow runs whole plans, given as the documents a user would write, over whole tables,
and returns what reading the written data back gives.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from planloom.operators.shared_folder import new_folder, new_table
from planloom.plans import Plan, plan_from_base64
from planloom.runner import open_plan, run_plan

# Fixed value: the dialect of the delimited files.
SEMICOLONS = {"header": "true", "delimiter": ";"}

# Text with newlines, quotes and outer blanks survives a round trip only with these.
VERBATIM = {
    "header": True,
    "multiLine": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


@dataclass(frozen=True)
class Flow:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str

    def __call__(self, spark: SparkSession, table_dir: str) -> DataFrame:
        return self.run(spark, table_dir)


def _table(table_dir: str, table: str) -> dict:
    return {"id": table, "json_type": "ParquetStorage", "path": f"{table_dir}/{table}.parquet"}


def _csv(path: str, view_id: str | None = None, options: dict | None = None, **more: object) -> dict:
    return {"id": view_id, "json_type": "CsvStorage", "path": path, "options": options or SEMICOLONS, **more}


def _parquet(path: str, view_id: str | None = None, **options: object) -> dict:
    return {"id": view_id, "json_type": "ParquetStorage", "path": path, "options": options}


def _run(spark: SparkSession, inputs: list[dict], steps: dict[str, str], targets: list[tuple[str, dict]]) -> None:
    run_plan(spark, _plan(inputs, steps, targets))


def _view(spark: SparkSession, inputs: list[dict], steps: dict[str, str]) -> DataFrame:
    return open_plan(spark, _plan(inputs, steps)).view(list(steps)[-1])


def _plan(inputs: list[dict], steps: dict[str, str], targets: list[tuple[str, dict]] = ()) -> Plan:
    return Plan.from_dict(
        {
            "inputs": inputs,
            "transformations": [{"id": view_id, "sql": sql} for view_id, sql in steps.items()],
            "targets": [{"from_sql_query": query, "output": output} for query, output in targets],
        }
    )


def csv_to_csv(spark: SparkSession, table_dir: str) -> DataFrame:
    """Delimited text to delimited text, run twice: the second run appends."""
    folder = new_folder(spark, "csv_to_csv")
    _run(spark, [_table(table_dir, "orders")], {}, [("orders", _csv(f"{folder}/in"))])
    for _ in range(2):
        _run(
            spark,
            [_csv(f"{folder}/in", "received")],
            {"passed_on": "select * from received"},
            [("passed_on", _csv(f"{folder}/out"))],
        )
    return _view(
        spark,
        [_csv(f"{folder}/out", "written")],
        {
            "result": """
            select cast(o_orderkey as bigint) as o_orderkey, cast(o_custkey as bigint) as o_custkey, o_orderstatus,
                   cast(o_totalprice as double) as o_totalprice, cast(o_orderdate as timestamp_ntz) as o_orderdate,
                   o_orderpriority
            from written
            """
        },
    )


def csv_to_jdbc(spark: SparkSession, table_dir: str) -> DataFrame:
    """Delimited text plus a load timestamp to a database table, read back by key ranges."""
    folder = new_folder(spark, "csv_to_jdbc")
    uri, table, options = new_table(spark, "customers")
    stored = {"json_type": "JdbcStorage", "uri": uri, "table": table}
    _run(spark, [_table(table_dir, "customer")], {}, [("customer", _csv(f"{folder}/in"))])
    _run(
        spark,
        [_csv(f"{folder}/in", "received", schema="c_custkey bigint, c_name string, c_nationkey int, "
                                                 "c_acctbal double, c_mktsegment string")],
        {"loaded": "select *, current_timestamp() as loaded_at from received"},
        [("loaded", {**stored, "options": {**options, "batchsize": 5000}})],
    )
    return _view(
        spark,
        [{**stored, "id": "stored", "options": {**options, "partitionColumn": "c_custkey"}}],
        {
            "result": """
            select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment,
                   loaded_at is not null as stamped
            from stored
            """
        },
    )


def partitioned_parquet(spark: SparkSession, table_dir: str) -> DataFrame:
    """Three chained views, collapsed by the optimizer into one scan, to a partitioned directory."""
    folder = new_folder(spark, "partitioned_parquet")
    _run(
        spark,
        [_table(table_dir, "lineitem")],
        {
            "shipped": "select * from lineitem where l_shipdate <= timestamp_ntz'2001-06-01 00:00:00'",
            "priced": "select *, l_extendedprice * (1 - l_discount) as net from shipped",
            "summary": """
            select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty,
                   round(sum(net), 4) as sum_disc_price, count(*) as count_order
            from priced group by l_returnflag, l_linestatus
            """,
        },
        [("summary", _parquet(folder, partitionBy=["l_returnflag"], compression="zstd"))],
    )
    return _view(spark, [_parquet(folder, "written")], {"result": "select * from written"})


def partitioned_detail(spark: SparkSession, table_dir: str) -> DataFrame:
    """Every row to a partitioned directory. The rebalance hint gives each directory few files of
    even size and splits the directories that hold most of the rows."""
    folder = new_folder(spark, "partitioned_detail")
    _run(
        spark,
        [_table(table_dir, "events")],
        {"spread": "select /*+ rebalance(event_type) */ event_id, user_id, value, event_type from events"},
        [("spread", _parquet(folder, partitionBy="event_type"))],
    )
    return _view(spark, [_parquet(folder, "written")], {"result": "select * from written"})


def two_targets(spark: SparkSession, table_dir: str) -> DataFrame:
    """Three inputs, two views, one target of each file kind; what both need is computed once."""
    folder = new_folder(spark, "two_targets")
    plan = _plan(
        [_table(table_dir, table) for table in ("orders", "customer", "nation")],
        {
            "customer_orders": """
            select c.c_nationkey, c.c_mktsegment, sum(o.orders) as orders
            from (select o_custkey, count(*) as orders from orders group by o_custkey) o
                 join customer c on o.o_custkey = c.c_custkey
            group by c.c_nationkey, c.c_mktsegment
            """,
            "by_nation": """
            select /*+ broadcast(n) */ n.n_name as name, sum(o.orders) as orders
            from customer_orders o join nation n on o.c_nationkey = n.n_nationkey group by n.n_name
            """,
            "by_segment": "select c_mktsegment as name, sum(orders) as orders from customer_orders group by c_mktsegment",
        },
        [("by_nation", _csv(f"{folder}/nation")), ("by_segment", _parquet(f"{folder}/segment"))],
    )
    run_plan(spark, plan, share=["customer_orders"])
    return _view(
        spark,
        [_csv(f"{folder}/nation", "nations", schema="name string, orders bigint"),
         _parquet(f"{folder}/segment", "segments")],
        {"result": "select 'nation' as kind, * from nations union all select 'segment' as kind, * from segments"},
    )


def partitioned_jdbc(spark: SparkSession, table_dir: str) -> DataFrame:
    """A database table scanned in key ranges and joined with files."""
    uri, table, options = new_table(spark, "orders")
    stored = {"json_type": "JdbcStorage", "uri": uri, "table": table}
    _run(
        spark,
        [_table(table_dir, "orders")],
        {"kept": "select o_orderkey, o_custkey, o_totalprice from orders"},
        [("kept", {**stored, "options": {**options, "batchsize": 5000}})],
    )
    return _view(
        spark,
        [
            {**stored, "id": "stored", "options": {**options, "partitionColumn": "o_orderkey"}},
            _table(table_dir, "customer"),
        ],
        {
            "result": """
            select s.o_orderkey, s.o_totalprice, c.c_name
            from stored s join customer c on s.o_custkey = c.c_custkey
            """
        },
    )


def shared_view(spark: SparkSession, table_dir: str) -> DataFrame:
    """One view feeding two targets, each with its own timestamp, and a target given as a fragment."""
    folder = new_folder(spark, "shared_view")
    _run(
        spark,
        [_table(table_dir, "customer")],
        {"stamped": "select c_custkey, c_mktsegment, current_timestamp() as stamp from customer"},
        [
            ("stamped", _parquet(f"{folder}/first")),
            ("stamped", _parquet(f"{folder}/second")),
            ("(select c_custkey from stamped where c_mktsegment = 'BUILDING')", _csv(f"{folder}/third")),
        ],
    )
    return _view(
        spark,
        [
            _parquet(f"{folder}/first", "a"),
            _parquet(f"{folder}/second", "b"),
            _csv(f"{folder}/third", "c", schema="c_custkey bigint"),
        ],
        {
            "result": """
            select a.c_custkey, a.c_mktsegment, a.stamp < b.stamp as stamped_later,
                   c.c_custkey is not null as in_fragment
            from a join b on a.c_custkey = b.c_custkey left join c on a.c_custkey = c.c_custkey
            """
        },
    )


def multiline_csv(spark: SparkSession, table_dir: str) -> DataFrame:
    """Whole texts, newlines and quotes included, through delimited files."""
    folder = new_folder(spark, "multiline_csv")
    _run(
        spark,
        [_table(table_dir, "documents")],
        {"texts": "select doc_id, lang, text from documents"},
        [("texts", _csv(folder, options=VERBATIM))],
    )
    return _view(
        spark,
        [_csv(folder, "texts", options=VERBATIM, schema="doc_id bigint, lang string, text string")],
        {"result": "select doc_id, lang, cast(length(text) as bigint) as n_chars, md5(text) as digest from texts"},
    )


def merged_schema(spark: SparkSession, table_dir: str) -> DataFrame:
    """Two appends with different columns to one directory, read with mergeSchema."""
    folder = new_folder(spark, "merged_schema")
    _run(
        spark,
        [_table(table_dir, "customer"), _table(table_dir, "supplier")],
        {
            "customers": "select c_custkey as key, c_acctbal as balance, c_mktsegment as segment from customer",
            "suppliers": "select s_suppkey as key, s_acctbal as balance, s_name as name from supplier",
        },
        [("customers", _parquet(folder)), ("suppliers", _parquet(folder))],
    )
    return _view(
        spark,
        [_parquet(folder, "accounts", mergeSchema=True)],
        {"result": "select key, balance, segment, name from accounts"},
    )


def path_list(spark: SparkSession, table_dir: str) -> DataFrame:
    """Several paths, globs among them, as one input."""
    paths = [f"{table_dir}/order*.parquet", f"{table_dir}/orders.parquet"]
    return _view(
        spark,
        [{"id": "twice", "json_type": "parquet", "path": paths}],
        {"result": "select o_orderkey, o_totalprice from twice"},
    )


def inline_plan(spark: SparkSession, table_dir: str) -> DataFrame:
    """A plan that arrives as base64-encoded JSON, the form used when nothing can be mounted."""
    document = {
        "inputs": [_table(table_dir, "supplier"), _table(table_dir, "nation")],
        "transformations": [
            {
                "id": "result",
                "sql": """
                select /*+ broadcast(nation) */ n_name, count(*) as suppliers, round(sum(s_acctbal), 2) as balance
                from supplier join nation on s_nationkey = n_nationkey group by n_name
                """,
            }
        ],
    }
    plan = plan_from_base64(base64.b64encode(json.dumps(document).encode()).decode())
    return open_plan(spark, plan).view("RESULT")


def redefined_view(spark: SparkSession, table_dir: str) -> DataFrame:
    """A transformation that takes over the id of its own input."""
    opened = open_plan(
        spark,
        Plan.from_dict(
            {
                "inputs": [_table(table_dir, "supplier")],
                "transformations": [
                    {"id": "supplier", "sql": "select *, s_acctbal < 0 as in_debt from supplier"},
                    {"id": "result", "sql": "select s_suppkey, s_name, in_debt from supplier"},
                ],
            }
        ),
    )
    return opened.view("result")


def session_statements(spark: SparkSession, table_dir: str) -> DataFrame:
    """Statements that return no rows of data: a setting and a temporary view."""
    return _view(
        spark,
        [_table(table_dir, "part")],
        {
            "setting": "set spark.sql.caseSensitive = true",
            "declared": "create temporary view sized_parts as select *, p_size > 40 as large from part",
            "result": "select p_partkey, p_size, p_brand, large from sized_parts",
        },
    )


FLOWS = [
    Flow("e1_csv_to_csv", csv_to_csv, "select * from orders union all select * from orders"),
    Flow("e2_csv_to_jdbc", csv_to_jdbc, "select *, true as stamped from customer"),
    Flow(
        "e3_partitioned_parquet",
        partitioned_parquet,
        """
        select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty,
               round(sum(l_extendedprice * (1 - l_discount)), 4) as sum_disc_price, count(*) as count_order
        from lineitem where l_shipdate <= timestamp '2001-06-01 00:00:00'
        group by l_returnflag, l_linestatus
        """,
    ),
    Flow(
        "e3_partitioned_detail",
        partitioned_detail,
        "select event_id, user_id, value, event_type from events",
    ),
    Flow(
        "e4_two_targets",
        two_targets,
        """
        select 'nation' as kind, n_name as name, count(*) as orders
        from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name
        union all
        select 'segment', c_mktsegment, count(*)
        from orders join customer on o_custkey = c_custkey group by c_mktsegment
        """,
    ),
    Flow(
        "e5_partitioned_jdbc",
        partitioned_jdbc,
        "select o_orderkey, o_totalprice, c_name from orders join customer on o_custkey = c_custkey",
    ),
    Flow(
        "e7_shared_view",
        shared_view,
        """
        select c_custkey, c_mktsegment, true as stamped_later, c_mktsegment = 'BUILDING' as in_fragment
        from customer
        """,
    ),
    Flow(
        "src1_multiline_csv",
        multiline_csv,
        "select doc_id, lang, length(text) as n_chars, md5(text) as digest from documents",
    ),
    Flow(
        "src2_merged_schema",
        merged_schema,
        """
        select c_custkey as key, c_acctbal as balance, c_mktsegment as segment, cast(null as varchar) as name
        from customer
        union all
        select s_suppkey, s_acctbal, null, s_name from supplier
        """,
    ),
    Flow(
        "src5_path_list",
        path_list,
        "select o_orderkey, o_totalprice from orders union all select o_orderkey, o_totalprice from orders",
    ),
    Flow(
        "pln5_inline_plan",
        inline_plan,
        """
        select n_name, count(*) as suppliers, round(sum(s_acctbal), 2) as balance
        from supplier join nation on s_nationkey = n_nationkey group by n_name
        """,
    ),
    Flow("sem5_redefined_view", redefined_view, "select s_suppkey, s_name, s_acctbal < 0 as in_debt from supplier"),
    Flow(
        "trf6_session_statements",
        session_statements,
        "select p_partkey, p_size, p_brand, p_size > 40 as large from part",
    ),
]
