"""Every registered query against its SQL on the smallest data set, and plan checks."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare

SF = "/root/testdata/sf0.001"
QUERIES, CHECKS = entry.queries(), entry.oracle_sql()
UNCHECKED = {k for k in QUERIES if k == "pipeline" or k.startswith("op")}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_all_queries_have_sql():
    assert set(QUERIES) - set(CHECKS) <= UNCHECKED
    assert set(CHECKS) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(set(QUERIES) - UNCHECKED))
def test_query_equals_its_sql(spark, con, key):
    note, _, ok = compare(spark, con, key, QUERIES[key], CHECKS.get(key), SF)
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).columns == [
        "doc_id", "chapter_no", "part", "chapter_id", "title", "content", "file_name", "level", "start_page", "end_page",
    ]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(k for k in set(QUERIES) - UNCHECKED if not k.startswith(("stream_", "sink_", "subscription"))))
def test_no_cross_joins(spark, key):
    plan = plan_of(QUERIES[key](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("key, columns, pushed", [
    ("scan_probability", "doc_id:bigint,text:string", None),
    ("batch_status", "l_orderkey:bigint,l_returnflag:string,l_linestatus:string", None),
    ("image_numbering", "p_partkey:bigint", None),
    ("word_counts", "doc_id:bigint,text:string", None),
])
def test_scans_read_only_what_they_need(spark, key, columns, pushed):
    assert f"ReadSchema: struct<{columns}>" in QUERIES[key](spark, SF)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
