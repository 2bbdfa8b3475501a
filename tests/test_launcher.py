"""The command line."""

import base64
import json

import pytest

from planloom import PlanError
from planloom.__main__ import main


@pytest.fixture
def document(tmp_path):
    return {
        "inputs": [{"id": "parcels", "json_type": "ParquetStorage", "path": f"{tmp_path}/in"}],
        "transformations": [{"id": "even", "sql": "select id from parcels where id % 2 = 0"}],
        "targets": [{"from_sql_query": "even", "output": {"json_type": "ParquetStorage", "path": f"{tmp_path}/out"}}],
    }


def test_plan_from_file_and_inline(spark, tmp_path, document):
    spark.range(10).write.parquet(f"{tmp_path}/in")
    (tmp_path / "plan.json").write_text(json.dumps(document))
    main(["--plan", f"{tmp_path}/plan.json"])
    main(["--plan-base64", base64.b64encode(json.dumps(document).encode()).decode(), "--share", "even"])
    assert sorted(row.id for row in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted([0, 2, 4, 6, 8] * 2)


def test_wrong_calls(spark, tmp_path):
    with pytest.raises(SystemExit):
        main([])
    with pytest.raises(SystemExit):
        main(["--plan", "a", "--plan-base64", "b"])
    with pytest.raises(PlanError):
        main(["--plan-base64", "%%%"])
