"""How a run behaves: laziness, ordering, isolation, failures."""

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, ArithmeticException, ParseException

from planloom import Plan, PlanError, open_plan, run_plan


@pytest.fixture
def numbers(spark, tmp_path):
    path = str(tmp_path / "numbers")
    spark.range(3).write.parquet(path)
    return {"id": "numbers", "json_type": "ParquetStorage", "path": path}


def plan_of(inputs, steps=(), targets=()):
    return Plan.from_dict({
        "inputs": inputs,
        "transformations": [{"id": view_id, "sql": sql} for view_id, sql in steps],
        "targets": [{"from_sql_query": query, "output": output} for query, output in targets],
    })


def parquet(path):
    return {"json_type": "ParquetStorage", "path": str(path)}


def values(frame):
    return sorted(row[0] for row in frame.collect())


def test_sem1_each_target_runs_its_own_lineage(spark, numbers, tmp_path):
    plan = plan_of([numbers], [("stamped", "select id, current_timestamp() as t from numbers")],
                   [("stamped", parquet(tmp_path / "a")), ("stamped", parquet(tmp_path / "b"))])
    run_plan(spark, plan)
    first, second = (spark.read.parquet(str(tmp_path / name)).select("t").distinct().collect() for name in "ab")
    assert len(first) == len(second) == 1 and first[0].t < second[0].t


def test_sem1_sharing_is_opt_in(spark, numbers, tmp_path):
    plan = plan_of([numbers], [("stamped", "select id, current_timestamp() as t from numbers")],
                   [("stamped", parquet(tmp_path / "a")), ("stamped where id > 0", parquet(tmp_path / "b"))])
    opened = run_plan(spark, plan, share=["stamped"])
    first, second = (spark.read.parquet(str(tmp_path / name)).select("t").distinct().collect() for name in "ab")
    assert first == second
    assert not opened.view("stamped").storageLevel.useMemory


def test_sem2_analysis_errors_come_before_any_write(spark, numbers, tmp_path):
    out = tmp_path / "out"
    for steps in ([("a", "select missing from numbers")],
                  [("a", "select * from later"), ("later", "select * from numbers")]):
        with pytest.raises(AnalysisException):
            run_plan(spark, plan_of([numbers], steps, [("numbers", parquet(out))]))
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        run_plan(spark, plan_of([numbers, {**numbers, "id": "x", "path": str(tmp_path / "none")}],
                                targets=[("numbers", parquet(out))]))
    assert not out.exists()


def test_sem3_data_errors_keep_earlier_targets(spark, numbers, tmp_path):
    plan = plan_of([numbers], [("bad", "select 1 div id as x from numbers")],
                   [("numbers", parquet(tmp_path / "good")), ("bad", parquet(tmp_path / "bad"))])
    open_plan(spark, plan)
    with pytest.raises(ArithmeticException):
        run_plan(spark, plan)
    assert spark.read.parquet(str(tmp_path / "good")).count() == 3


def test_sem4_ids_ignore_case(spark, numbers):
    opened = open_plan(spark, plan_of([numbers], [("allNumbers", "select * from NUMBERS")]))
    assert opened.view("ALLNUMBERS").count() == 3
    with pytest.raises(PlanError):
        open_plan(spark, plan_of([numbers], [("a-b", "select 1")]))


def test_sem5_redefinition_replaces(spark, numbers):
    with pytest.warns(UserWarning):
        opened = open_plan(spark, plan_of([numbers], [("numbers", "select *, 1 as k from numbers"),
                                                      ("seen", "select id + k as x from numbers")]))
    assert opened.view("numbers").columns == ["id", "k"]
    assert values(opened.view("seen")) == [1, 2, 3]


def test_sem6_listing_is_fixed_when_registered(spark, numbers):
    opened = open_plan(spark, plan_of([numbers], targets=[("numbers", parquet(numbers["path"]))]))
    opened.write_targets()
    assert opened.view("numbers").count() == 3
    assert spark.read.parquet(numbers["path"]).count() == 6


def test_sem7_overwriting_an_input_table_is_refused_before_anything_runs(spark, database):
    uri, options = database
    stored = {"id": "t", "json_type": "JdbcStorage", "uri": uri, "table": "t", "options": options}
    run_plan(spark, Plan.from_dict({"transformations": [{"id": "n", "sql": "select id from range(4)"}],
                                    "targets": [{"from_sql_query": "n", "output": stored}]}))
    with pytest.raises(PlanError, match="overwrite"):
        run_plan(spark, plan_of([stored], targets=[("t", stored)]))
    assert open_plan(spark, plan_of([stored])).view("t").count() == 4


def test_sem9_one_statement_per_transformation(spark, numbers):
    with pytest.raises(ParseException):
        open_plan(spark, plan_of([numbers], [("a", "select 1; select 2")]))


def test_sem10_default_modes(spark, numbers, tmp_path, database):
    uri, options = database
    plan = plan_of([numbers], targets=[
        ("numbers", parquet(tmp_path / "p")),
        ("numbers", {"json_type": "CsvStorage", "path": str(tmp_path / "c")}),
        ("numbers", {"json_type": "JdbcStorage", "uri": uri, "table": "n", "options": options}),
    ])
    for _ in range(2):
        run_plan(spark, plan)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 6
    assert spark.read.csv(str(tmp_path / "c")).count() == 6
    assert spark.read.jdbc(uri, "n", properties=options).count() == 3


@pytest.mark.parametrize(
    ("fragment", "expected"),
    [
        ("numbers", [0, 1, 2]),
        ("numbers where id > 1", [2]),
        ("numbers a join numbers b using (id)", [0, 1, 2]),
        ("(select max(id) from numbers)", [2]),
        ("range(2)", [0, 1]),
        ("numbers union all select * from numbers", [0, 0, 1, 1, 2, 2]),
        ("numbers order by id desc limit 1", [2]),
        ("parquet.`{path}`", [0, 1, 2]),
    ],
)
def test_trf5_target_fragments(spark, numbers, fragment, expected):
    opened = open_plan(spark, plan_of([numbers]))
    assert values(opened.relation(fragment.format(path=numbers["path"]))) == expected


def test_trf5_undefined_view(spark, numbers, tmp_path):
    with pytest.raises(AnalysisException):
        run_plan(spark, plan_of([numbers], targets=[("numbers", parquet(tmp_path / "o")),
                                                    ("nothing", parquet(tmp_path / "o"))]))
    assert not (tmp_path / "o").exists()


def test_trf5_a_target_may_read_what_an_earlier_one_wrote(spark, numbers, tmp_path):
    out = tmp_path / "first"
    run_plan(spark, plan_of([numbers], targets=[("numbers", parquet(out)),
                                                (f"parquet.`{out}` where id > 0", parquet(tmp_path / "second"))]))
    assert spark.read.parquet(str(tmp_path / "second")).count() == 2


def test_trf6_statements_become_views(spark, numbers):
    opened = open_plan(spark, plan_of([numbers], [
        ("conf", "set spark.sql.shuffle.partitions = 3"),
        ("ddl", "create temporary view evens as select id from numbers where id % 2 = 0"),
        ("fun", "create temporary function twice(x bigint) returns bigint return x * 2"),
        ("result", "select twice(id) from evens"),
    ]))
    assert opened.view("ddl").columns == []
    assert opened.view("conf").columns == ["key", "value"]
    assert values(opened.view("result")) == [0, 4]
    assert opened.session.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.shuffle.partitions") != "3"


def test_runs_do_not_see_each_other(spark, numbers):
    open_plan(spark, plan_of([numbers], [("only_here", "select 1 as x")]))
    with pytest.raises(AnalysisException):
        open_plan(spark, plan_of([numbers], [("a", "select * from only_here")]))
    assert not spark.catalog.tableExists("numbers")


def test_settings_made_at_run_time_reach_the_run(spark):
    plan = plan_of([], [("zone", "select current_timezone() as z")])
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert values(open_plan(spark, plan).view("zone")) == ["Asia/Tokyo"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_lake_settings_stay_in_the_run(spark, tmp_path):
    # There is no lake driver here: the settings are made, then its absence is reported.
    lake = {"id": "far", "json_type": "ParquetStorage", "path": "x", "storage_account": "acct",
            "container": "box", "sas_token": "tok"}
    with pytest.raises(Py4JJavaError, match="AzureBlobFileSystem"):
        open_plan(spark, plan_of([lake]))
    assert spark.conf.get("fs.azure.sas.box.acct.blob.core.windows.net", None) is None


def test_targets_are_written_in_order(spark, numbers, tmp_path):
    plan = plan_of([numbers], [("n", "select id, 'x' as t from numbers")],
                   [("n", parquet(tmp_path / "a")), ("n", parquet(tmp_path / "b"))])
    run_plan(spark, plan)
    times = [(tmp_path / name / "_SUCCESS").stat().st_mtime_ns for name in "ab"]
    assert times == sorted(times)
