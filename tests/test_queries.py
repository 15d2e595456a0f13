"""Every registered query against its SQL, and the shape of its plan."""
import pytest

import __spark_entry__ as entry
from check import compare, duck
from pressweave.queries import registry

SF = "/root/testdata/sf0.001"
REGISTRY = registry()
WRITES = {"report_digest", "image_resolve", "image_backfill", "csv_scan", "upsert_table", "stream_ingest", "stream_status", "stream_distinct", "stream_fresh", "stream_event_counts"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_matches_sql(spark, con, name):
    fn, sql = REGISTRY[name]
    line, ok = compare(spark, con, name, fn, sql, SF)
    assert ok, line


@pytest.mark.parametrize("name", [n for n in REGISTRY if n not in WRITES])
def test_plan_has_no_cross_join_and_no_python(spark, name):
    plan = REGISTRY[name][0](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "MapInPandas"):
        assert word not in plan, word


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
