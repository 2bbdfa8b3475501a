"""Sources and sinks: round trips through files and an in-process database."""

import pytest
from pyspark.errors import AnalysisException

from planloom import Plan, PlanError, open_plan, run_plan
from planloom.plans import Storage
from planloom.sinks import write_storage
from planloom.sources import read_storage
from planloom.sources.jdbc import CONNECTIONS

SEMICOLONS = {"header": "true", "delimiter": ";"}


def csv(path, **options):
    return Storage("csv", path=str(path), options=options)


def parquet(path, **options):
    return Storage("parquet", path=str(path), options=options)


def bag(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


@pytest.fixture
def parcels(tmp_path):
    path = tmp_path / "parcels.txt"
    path.write_text("code;depot\nK7;north\nM2;quay\n")
    return path


class TestCsv:
    def test_options_reach_the_reader(self, spark, parcels):
        frame = read_storage(spark, csv(parcels, **SEMICOLONS))
        assert frame.columns == ["code", "depot"] and frame.count() == 2

    def test_without_options(self, spark, parcels):
        frame = read_storage(spark, csv(parcels))
        assert frame.dtypes == [("_c0", "string")] and frame.count() == 3

    def test_append(self, spark, parcels, tmp_path):
        frame = read_storage(spark, csv(parcels, **SEMICOLONS))
        for expected in (2, 4):
            write_storage(frame, csv(tmp_path / "out", **SEMICOLONS))
            assert read_storage(spark, csv(tmp_path / "out", **SEMICOLONS)).count() == expected

    def test_schema_and_inference(self, spark, tmp_path):
        write_storage(spark.range(3), csv(tmp_path / "n", header=True))
        assert read_storage(spark, csv(tmp_path / "n", header=True)).dtypes == [("id", "string")]
        assert read_storage(spark, csv(tmp_path / "n", header=True, inferSchema=True)).dtypes == [("id", "int")]
        declared = Storage("csv", path=str(tmp_path / "n"), options={"header": True}, schema="id bigint")
        assert read_storage(spark, declared).dtypes == [("id", "bigint")]

    def test_empty_string_and_null_read_back_as_null(self, spark, tmp_path):
        write_storage(spark.sql("select 1 as k, '' as t union all select 2, null"), csv(tmp_path / "e", header=True))
        assert bag(read_storage(spark, csv(tmp_path / "e", header=True))) == [("1", None), ("2", None)]

    def test_list_of_paths_and_glob(self, spark, parcels):
        paths = Storage("csv", path=(str(parcels), str(parcels.parent / "par*.txt")), options=SEMICOLONS)
        assert read_storage(spark, paths).count() == 4

    def test_arrays_are_refused(self, spark, tmp_path):
        with pytest.raises(AnalysisException, match="UNSUPPORTED_DATA_TYPE"):
            write_storage(spark.sql("select array(1) as a"), csv(tmp_path / "a"))


class TestParquet:
    def test_append_partitions_and_compression(self, spark, tmp_path):
        frame = spark.sql("select id, id % 2 as part, id % 3 as sub from range(6)")
        out = tmp_path / "out"
        for _ in range(2):
            write_storage(frame, parquet(out, partitionBy="part, sub", compression="gzip"))
        assert sorted(p.name for p in out.iterdir() if p.is_dir()) == ["part=0", "part=1"]
        assert list(out.rglob("sub=2/*.gz.parquet"))
        assert read_storage(spark, parquet(out)).count() == 12

    def test_reading_options_on_a_target_do_not_hurt(self, spark, tmp_path):
        write_storage(spark.range(1), parquet(tmp_path / "o", header="true"))
        assert read_storage(spark, parquet(tmp_path / "o")).count() == 1

    def test_modes(self, spark, tmp_path):
        path = str(tmp_path / "m")
        for mode, count in ((None, 3), ("overwrite", 3), ("ignore", 3), ("append", 6)):
            write_storage(spark.range(3), Storage("parquet", path=path, mode=mode))
            assert spark.read.parquet(path).count() == count
        with pytest.raises(AnalysisException, match="ALREADY_EXISTS"):
            write_storage(spark.range(3), Storage("parquet", path=path, mode="error"))

    def test_appended_schema_needs_merging(self, spark, tmp_path):
        write_storage(spark.sql("select 1 as a"), parquet(tmp_path / "s"))
        write_storage(spark.sql("select 2 as a, 'x' as b"), parquet(tmp_path / "s"))
        assert len(read_storage(spark, parquet(tmp_path / "s")).columns) in (1, 2)
        merged = read_storage(spark, parquet(tmp_path / "s", mergeSchema=True))
        assert bag(merged) == [(1, None), (2, "x")]

    def test_nested_types_survive(self, spark, tmp_path):
        frame = spark.sql("select array(1, 2) as a, map('k', 1.5D) as m, named_struct('x', date'2024-01-01') as s")
        write_storage(frame, parquet(tmp_path / "n"))
        assert read_storage(spark, parquet(tmp_path / "n")).schema.simpleString() == frame.schema.simpleString()

    def test_duplicate_columns_are_refused(self, spark, tmp_path):
        with pytest.raises(AnalysisException, match="COLUMN_ALREADY_EXISTS"):
            write_storage(spark.sql("select 1 as a, 2 as a"), parquet(tmp_path / "d"))

    def test_a_target_has_one_path(self, spark):
        with pytest.raises(PlanError, match="one path"):
            write_storage(spark.range(1), Storage("parquet", path=("a", "b")))


class TestJdbc:
    def storage(self, database, table="t", mode=None, **options):
        uri, base = database
        return Storage("jdbc", table=table, uri=uri, options={**base, **options}, mode=mode)

    def test_overwrite_replaces_rows_and_columns(self, spark, database):
        write_storage(spark.range(5), self.storage(database))
        write_storage(spark.sql("select 1 as a, 'x' as b"), self.storage(database, batchsize=10))
        assert bag(read_storage(spark, self.storage(database))) == [(1, "x")]

    def test_truncate_keeps_the_table(self, spark, database):
        typed = self.storage(database, createTableColumnTypes="a decimal(10, 2)")
        write_storage(spark.sql("select cast(1 as decimal(10, 2)) as a"), typed)
        frame = spark.sql("select cast(7 as decimal(5, 1)) as a")
        for options, kind in (({"truncate": True}, "decimal(10,2)"), ({}, "decimal(5,1)")):
            write_storage(frame, self.storage(database, **options))
            stored = read_storage(spark, self.storage(database))
            assert stored.dtypes == [("a", kind)] and bag(stored) == [(7,)]

    def test_append_mode(self, spark, database):
        write_storage(spark.range(5), self.storage(database))
        write_storage(spark.range(5), self.storage(database, mode="append"))
        assert read_storage(spark, self.storage(database)).count() == 10

    def test_partitioned_scan(self, spark, database):
        write_storage(spark.range(100), self.storage(database))
        split = self.storage(database, partitionColumn="id", lowerBound=0, upperBound=100, numPartitions=3)
        frame = read_storage(spark, split)
        assert frame.rdd.getNumPartitions() == 3
        assert sorted(row.id for row in frame.collect()) == list(range(100))

    def test_bounds_come_from_the_table(self, spark, database):
        write_storage(spark.range(100, 200), self.storage(database))
        frame = read_storage(spark, self.storage(database, partitionColumn="id"))
        assert frame.rdd.getNumPartitions() == CONNECTIONS
        sizes = [len(rows) for rows in frame.rdd.glom().collect()]
        assert sum(sizes) == 100 and max(sizes) < 20
        few = read_storage(spark, self.storage(database, partitionColumn="id", numPartitions=3))
        assert few.rdd.getNumPartitions() == 3 and few.count() == 100

    @pytest.mark.parametrize("rows", [0, 1])
    def test_a_range_without_width(self, spark, database, rows):
        write_storage(spark.range(rows), self.storage(database))
        assert read_storage(spark, self.storage(database, partitionColumn="id")).count() == rows

    def test_predicates(self, spark, database):
        write_storage(spark.range(10), self.storage(database))
        frame = read_storage(spark, self.storage(database, predicates=['"id" < 4', '"id" >= 4']))
        assert frame.rdd.getNumPartitions() == 2 and frame.count() == 10

    def test_subquery_as_table(self, spark, database):
        write_storage(spark.range(10), self.storage(database))
        assert read_storage(spark, self.storage(database, table='(select "id" from t where "id" > 6) q')).count() == 3

    def test_filters_reach_the_database(self, spark, database):
        write_storage(spark.range(10), self.storage(database))
        plan = read_storage(spark, self.storage(database)).where("id > 6")._jdf.queryExecution().toString()
        assert "GreaterThan(id,6)" in plan

    def test_timestamps_without_zone_come_back_with_one(self, spark, database):
        write_storage(spark.sql("select timestamp_ntz'2024-01-01 00:00:00' as t"), self.storage(database))
        assert read_storage(spark, self.storage(database)).dtypes == [("t", "timestamp")]

    def test_no_password(self, spark, database):
        uri, base = database
        write_storage(spark.range(2), self.storage(database, table="app.t"))
        bare = Storage("jdbc", table="app.t", uri=uri, options={"driver": base["driver"], "user": "app"})
        assert read_storage(spark, bare).count() == 2


class TestSamplePlans:
    def test_csv_to_csv(self, spark, parcels, tmp_path):
        document = {
            "inputs": [{"id": "parcels", "json_type": "CsvStorage", "path": str(parcels), "options": SEMICOLONS}],
            "transformations": [{"id": "sorted_out", "sql": "select depot, code from parcels"}],
            "targets": [{"from_sql_query": "sorted_out",
                         "output": {"json_type": "CsvStorage", "path": str(tmp_path / "o"), "options": SEMICOLONS}}],
        }
        run_plan(spark, Plan.from_dict(document))
        assert bag(read_storage(spark, csv(tmp_path / "o", **SEMICOLONS))) == [("north", "K7"), ("quay", "M2")]

    def test_csv_to_jdbc(self, spark, parcels, database):
        uri, options = database
        stored = {"id": "stored", "json_type": "JdbcStorage", "table": "received", "uri": uri, "options": options}
        document = {
            "inputs": [{"id": "parcels", "json_type": "CsvStorage", "path": str(parcels), "options": SEMICOLONS}],
            "transformations": [{"id": "logged", "sql": "select code, depot, current_timestamp() as seen from parcels"}],
            "targets": [{"from_sql_query": "logged", "output": stored}],
        }
        for _ in range(2):
            run_plan(spark, Plan.from_dict(document))
        rows = open_plan(spark, Plan.from_dict({"inputs": [stored]})).view("stored").collect()
        assert sorted((row.code, row.depot) for row in rows) == [("K7", "north"), ("M2", "quay")]
        assert all(row.seen is not None for row in rows)
