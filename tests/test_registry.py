"""The driver contract, and a few registered queries against their SQL."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.check_oracle import compare, connect, type_problem

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ("inferred_edges", "components", "join_paths", "scored_clusters", "confusion", "timeline", "audit_log", "pii_mask")


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 4


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_its_sql(spark, name):
    con = connect(FOLDER)
    sql = entry.oracle_sql()[name]
    frame = entry.queries()[name](spark, FOLDER)
    assert compare(frame.toPandas(), con.execute(sql).df()) is None
    assert type_problem(frame, con, sql) is None


@pytest.mark.parametrize("name", ["incidence", "inferred_edges", "scored_clusters", "timeline", "subgraph_nodes", "overview", "confusion"])
def test_no_query_multiplies_tables(spark, name):
    frame = entry.queries()[name](spark, FOLDER)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_accounts_are_all_customers(spark):
    frame = entry.queries()["account_rollup"](spark, FOLDER)
    assert frame.count() == spark.read.parquet(f"{FOLDER}/customer.parquet").count()


def test_text_queries_read_no_order_lines(spark):
    import registry

    registry.forget(spark)
    for name in ("pii_mask", "personal_data", "evasion_check", "personal_columns"):
        plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" not in plan
    assert not any("activity" in run.__dict__ for run in registry._runs.values())


def test_forgetting_leaves_no_tables(spark):
    import registry
    from tieline.functions.lineage import application_dir

    entry.queries()["components"](spark, FOLDER).count()
    folder = spark._jvm.org.apache.hadoop.fs.Path(application_dir(spark))
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    assert files.exists(folder)
    registry.forget(spark)
    assert not files.exists(folder)
