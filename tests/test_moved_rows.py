"""How often rows of the large tables are moved and kept: the adapter's lines, the guard, observed edges of clusters."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tieline.operators import incidence, links, reports
from tieline.plans.detection import Detection
from tieline.sources import adapter


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Twelve customers, of whom neighbours buy the same part from the same supplier on one day."""
    at = tmp_path_factory.mktemp("tables")
    day = lambda n: datetime(1995, 3, 1) + timedelta(days=n)
    customers = [(c,) for c in range(12)] + [(3,), (None,)]
    orders = [(o, o % 12) for o in range(36)] + [(36, None), (37, 99), (None, 1)]
    lines = [
        (o, (o % 12) // 2, o % 7, n, day(0 if n == 0 else 5 * o + n), 10.5 * (o + 1), 0.05, "R" if o % 3 == 0 else "N")
        for o in range(38) for n in range(3)
    ] + [(5, 77, 1, 9, day(1), 1.0, 0.0, "R"), (5, 1, None, 8, None, 1.0, 0.0, "N")]
    told = {
        "customer": (customers, "c_custkey long"),
        "orders": (orders, "o_orderkey long, o_custkey long"),
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_shipdate timestamp, "
                            "l_extendedprice double, l_discount double, l_returnflag string"),
        "part": ([(p, f"brand{p % 3}") for p in range(6)], "p_partkey long, p_brand string"),
    }
    for name, (rows, schema) in told.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_lines_are_folded_by_account_where_they_lie(spark, folder):
    orders = adapter.activity(spark, folder).orders
    for folded in (
        orders.groupBy("account_id").agg(F.count("*")),
        incidence.touches(orders).groupBy("account_id", "kind", "key").agg(F.count("*")),
    ):
        assert "Exchange" not in plan(folded)
    # texts made of other columns are not stored
    assert "line_id" not in re.search(r"ReadSchema: (.*)", plan(orders)).group(1)


def test_nothing_as_large_as_the_events_is_cached(spark, folder):
    run = Detection(adapter.activity(spark, folder))
    edges = reports.subgraph_edges(run.members, run.inside, run.observed_inside)
    for frame in (run.incidence, run.fan_out, run.observed_inside):
        assert not frame.storageLevel.useMemory and not frame.storageLevel.useDisk
    assert not edges.storageLevel.useDisk


def test_edges_of_members_are_the_observed_ones(spark, folder):
    run = Detection(adapter.activity(spark, folder))
    assert run.members.count() > 0
    plain = reports.subgraph_edges(run.members, run.inside, run.observed)
    lean = reports.subgraph_edges(run.members, run.inside, run.observed_inside)
    assert plain.where("not derived").count() > 0
    assert rows(plain) == rows(lean.select(*plain.columns))


def test_guard_drops_single_accounts_before_the_join(spark):
    seen = spark.range(400).select(
        F.concat(F.lit("a"), F.col("id").cast("string")).alias("account"),
        F.when(F.col("id") < 60, "wide").when(F.col("id") < 200, F.concat(F.lit("n"), (F.col("id") % 70).cast("string")))
        .otherwise(F.concat(F.lit("single"), F.col("id").cast("string"))).alias("infra"),
        F.lit("DEVICE").alias("kind"), F.lit(1).alias("observations"),
        F.lit(datetime(2001, 1, 1)).alias("first_seen"), F.lit(datetime(2001, 1, 2)).alias("last_seen"),
    )
    counts = links.fan_out(seen)
    expected = seen.join(counts.where("account_count between 2 and 40").select("infra"), "infra", "left_semi")
    guarded = links.guarded(seen, counts=counts)
    assert rows(guarded) == rows(expected)
    assert "bitmap_construct_agg" in plan(guarded)


def test_entities_are_dealt_by_id_so_that_what_is_known_of_a_node_joins_in_place(spark, folder):
    run = Detection(adapter.activity(spark, folder))
    fan = run.fan_out.select(F.col("infra").alias("id"), "account_count")
    joined = run.entities.join(fan.hint("merge"), "id")
    assert joined.count() > 0
    by_type_and_key = re.compile(r"hashpartitioning\((?:type|kind)#\d+, key#\d+")
    assert not by_type_and_key.search(plan(joined))
    assert plan(joined).count("Exchange hashpartitioning(") <= 2


def test_entities_without_key_stay_one_row_a_type(spark):
    accounts = spark.createDataFrame(
        [("1", "c1", datetime(2001, 1, 2)), (None, None, datetime(2001, 1, 1)), (None, "c1", None)],
        "id string, customer_key string, opened_at timestamp",
    )
    none = spark.createDataFrame([], "id string, account_id string, placed_at timestamp, device_key string, address_key string, payment_key string")
    told = incidence.entities(accounts, none)
    assert rows(told) == sorted([
        ("ent_acc_1", "ACCOUNT", "1", datetime(2001, 1, 2), datetime(2001, 1, 2), 1),
        ("ent_cus_c1", "CUSTOMER", "c1", datetime(2001, 1, 2), datetime(2001, 1, 2), 2),
        (None, "ACCOUNT", None, datetime(2001, 1, 1), datetime(2001, 1, 1), 2),
        (None, "CUSTOMER", None, datetime(2001, 1, 1), datetime(2001, 1, 1), 1),
    ], key=str)


def test_guard_marks_every_bit_of_a_bitmap(spark):
    """Two accounts on each of many nodes: none may be lost by the bits."""
    seen = spark.range(6000).select(
        F.concat(F.lit("a"), F.col("id").cast("string")).alias("account"),
        F.concat(F.lit("n"), (F.col("id") % 3000).cast("string")).alias("infra"), F.lit("DEVICE").alias("kind"),
    )
    guarded = links.guarded(seen)
    assert guarded.count() == 6000
    # no text is made to ask for a bit
    assert not re.search(r"BroadcastHashJoin [^\n]*conv\(", plan(guarded))
