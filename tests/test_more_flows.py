"""What the further flows promise beyond their rows: plans, stored types, and how statements behave."""

import pytest
from oracle import TEST_DATA
from pyspark.errors import PySparkException
from test_physical import explain

from planloom import Plan, open_plan, run_plan
from planloom.operators import CATALOGUE

SMALL = str(TEST_DATA / "sf0.001")


@pytest.fixture
def unbroadcast(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    session.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    return session


def events(**more):
    return {"id": "events", "json_type": "parquet", "path": f"{SMALL}/events.parquet", **more}


def test_levels_of_distinct_counts_copy_no_rows(spark):
    text = explain(CATALOGUE["a24_bitmap_distinct"](spark, SMALL))
    assert "Expand" not in text and "events.parquet" not in text and "bitmap_or_agg" in text


def test_bitmaps_of_null_and_negative_ids(spark, tmp_path):
    spark.sql("""
        select * from values (1L, timestamp_ntz'2024-01-01 00:00:00', cast(null as bigint), 'a', 1D, '{}'),
                             (2L, null, -5L, null, 1D, '{}'), (3L, timestamp_ntz'2024-01-01 00:00:00', 5L, 'a', 1D, '{}'),
                             (4L, timestamp_ntz'2024-01-01 00:00:00', 0L, 'a', 1D, '{}'), (null, null, 9000000000L, 'a', 1D, '{}')
        as t(event_id, ts, user_id, event_type, value, props)
    """).write.parquet(str(tmp_path / "events.parquet"))
    found = {(r.level, r.name): r.users for r in CATALOGUE["a24_bitmap_distinct"](spark, str(tmp_path)).collect()}
    assert found == {
        ("day", "2024-01-01"): 2, ("day", None): 2, ("week", "2024-01-01"): 2, ("week", None): 2,
        ("type", "a"): 3, ("type", None): 1, ("all", "all"): 4,
    }


def test_partitions_are_pruned_while_running(spark):
    frame = CATALOGUE["e9_runtime_pruning"](spark, SMALL)
    assert "dynamicpruning" in explain(frame).lower()
    assert {row.event_type for row in frame.collect()} == {"click", "error"}


def test_bucketed_tables_meet_without_a_shuffle(unbroadcast):
    text = explain(CATALOGUE["e10_bucketed_join"](unbroadcast, SMALL))
    assert "SortMergeJoin" in text and "Exchange" not in text and "Bucketed: true" in text


def test_variants_stay_variants_in_files(spark, tmp_path):
    target = {"json_type": "parquet", "path": str(tmp_path / "v")}
    step = {"id": "parsed", "sql": "select event_id, parse_json(props) as props from events"}
    run_plan(spark, Plan.from_dict({"inputs": [events()], "transformations": [step], "targets": [{"from_sql_query": "parsed", "output": target}]}))
    stored = spark.read.parquet(target["path"])
    assert dict(stored.dtypes)["props"] == "variant"
    stored.createOrReplaceTempView("stored_variants")
    assert spark.sql("select schema_of_variant_agg(props) as s from stored_variants").first().s == "OBJECT<k: BIGINT>"


def script(text, **more):
    return Plan.from_dict({"inputs": [events()], "transformations": [{"id": "result", "sql": text}], **more})


def test_a_script_gives_its_last_result(spark):
    text = """
        begin
          declare n int default 0;
          select 'not this one';
          repeat set n = n + 1; until n >= 5 end repeat;
          select n as rounds, count(*) as events from events;
        end
    """
    assert [tuple(row) for row in open_plan(spark, script(text)).view("result").collect()] == [(5, 1000)]


def test_a_script_can_handle_errors(spark):
    text = """
        begin
          declare caught boolean default false;
          begin
            declare exit handler for sqlexception begin set caught = true; end;
            select raise_error('no');
          end;
          select caught;
        end
    """
    assert open_plan(spark, script(text)).view("result").first().caught is True


def test_errors_of_a_script_come_before_the_first_write(spark, tmp_path):
    target = {"from_sql_query": "events", "output": {"json_type": "parquet", "path": str(tmp_path / "never")}}
    for text in ("begin select nothing from events; end", "begin select 1; select raise_error('late'); end", "begin selec 1; end"):
        with pytest.raises(PySparkException):
            run_plan(spark, script(text, targets=[target]))
        assert not (tmp_path / "never").exists()


def test_scripts_of_a_plan_keep_to_themselves(spark):
    opened = open_plan(spark, script("begin declare n int default 1; select n; end"))
    with pytest.raises(PySparkException):
        opened.session.sql("select n")


def test_reloads_touch_only_their_partitions(spark, tmp_path):
    path = tmp_path / "events"

    def write(condition, **options):
        plan = script(
            f"select event_id, value, event_type from events where {condition}",
            targets=[{
                "from_sql_query": "result",
                "output": {"json_type": "parquet", "path": str(path), "options": {"partitionBy": "event_type", **options}, "mode": "overwrite"},
            }],
        )
        run_plan(spark, plan)

    write("true")
    files = {file: file.stat().st_mtime_ns for file in path.rglob("*.parquet")}
    for _ in range(2):
        write("event_type = 'error' and value > 50", partitionOverwriteMode="dynamic")
        kept = {file for file in path.rglob("*.parquet") if "event_type=error" not in str(file)}
        assert kept == {file for file in files if "event_type=error" not in str(file)}
        assert all(file.stat().st_mtime_ns == files[file] for file in kept)
    assert spark.read.parquet(str(path)).where("event_type = 'error' and value <= 50").count() == 0


def test_rejected_rows_are_kept_once(spark):
    rows = CATALOGUE["src7_quarantine"](spark, SMALL).collect()
    assert len({row.event_id for row in rows}) == len(rows) == 1000
    assert {row.reason for row in rows if row.kind == "rejected"} == {"user_id", "value"}
