"""Infrastructure of one account is folded where its lines lie; only what accounts share moves."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

import registry
from tests.test_moved_rows import folder, plan, rows  # noqa: F401
from tieline.functions.marks import marked, marks
from tieline.operators import components, incidence, links, reports
from tieline.plans.detection import Detection
from tieline.sources import adapter, dossier


@pytest.fixture(scope="module")
def run(spark, folder):  # noqa: F811
    return Detection(adapter.activity(spark, folder))


def test_marked_rows_are_all_that_were_marked_and_the_rest_is_told_apart(spark):
    every, some = spark.range(5000).withColumn("h", F.xxhash64("id")), spark.range(0, 5000, 7)
    table = marks(some, F.xxhash64("id"))
    yes, no = (marked(every, F.col("h"), table, b) for b in (True, False))
    assert yes.count() + no.count() == 5000
    assert some.join(yes, "id", "left_anti").count() == 0 and yes.count() < 1000


def test_guard_and_entities_are_the_same_with_shared_nodes(run):
    whole = links.guarded(run.incidence, run.config)
    assert whole.count() > 0
    assert rows(run.guarded) == rows(whole.select(*run.guarded.columns))
    assert rows(run.all_entities) == rows(run.entities.select(*run.all_entities.columns))
    assert rows(run.entity_types.groupBy("type").count()) == rows(run.entities.groupBy("type").count())


def test_accounts_that_come_twice_share_their_keys(spark):
    day = datetime(2001, 1, 1)
    orders = spark.createDataFrame(
        [("o1", "a", day, "d1", None, None), ("o2", "b", day, "d2", None, None), ("o3", None, day, "d3", None, None)],
        "id string, account_id string, placed_at timestamp, device_key string, address_key string, payment_key string",
    )
    accounts = spark.createDataFrame([("a", "ent_acc_a"), ("a", "ent_acc_a"), ("b", "ent_acc_b")], "id string, entity_id string")
    shared = incidence.shared_nodes(orders, accounts)
    counts = rows(links.fan_out(incidence.incidence(orders, accounts, shared=shared)))
    assert ("ent_dev_d1", "DEVICE", 2) in counts
    assert not any(infra == "ent_dev_d2" for infra, *_ in counts)


def test_own_nodes_lie_where_their_edges_do(run):
    own = incidence.own_nodes(run.observed_inside, run.shared_nodes)
    assert own.count() > 0
    assert "Exchange hashpartitioning(dst" not in plan(own) and "Exchange hashpartitioning(cluster" not in plan(own)


def test_nodes_with_shared_marks_are_those_of_all_entities(run):
    edges = reports.subgraph_edges(run.members, run.inside, run.observed_inside)
    plain = reports.subgraph_nodes(run.members, edges, run.entities, links.link_fanout(run.edges, run.fan_out))
    lean = reports.subgraph_nodes(
        run.members, edges, run.shared_entities, links.link_fanout(run.edges, run.shared_fan_out), run.shared_nodes
    )
    assert plain.count() > run.members.count()
    assert rows(plain) == rows(lean.select(*plain.columns))
    assert lean.dtypes == plain.dtypes


def test_visible_edges_have_both_ends_shown(spark):
    nodes = spark.createDataFrame(
        [(c, f"n{k}", "ADDRESS" if k == 3 else "ACCOUNT") for c in ("x", "y") for k in range(4)], "cluster string, id string, type string"
    )
    pairs = [("x", "n0", "n1"), ("x", "n0", "n3"), ("x", "n3", "n0"), ("x", "gone", "n0"), ("x", "n1", "gone"), ("y", "n2", "n1"), ("z", "n0", "n1"), ("x", None, "n1"), (None, "n0", "n1")]
    edges = spark.createDataFrame([(*p, k % 2 == 0) for k, p in enumerate(pairs)], "cluster string, src string, dst string, derived boolean")
    kept = reports.visible(nodes, edges, ("ADDRESS",))[1].select("cluster", "src", "dst")
    assert rows(kept) == [("x", "n0", "n1"), ("y", "n2", "n1")]
    # no source is missing: edges only meet the nodes they lead to
    within = edges.where("src in ('n0', 'n2') and cluster != 'z'")
    assert plan(reports.visible(nodes, within)[1]).count("Join") == 1


def test_lines_of_unknown_parts_open_accounts_and_are_in_no_model_table(spark, tmp_path):
    day = lambda n: datetime(1995, 3, n)
    told = {
        "customer": ([(1,), (1,), (2,), (None,)], "c_custkey long"),
        "orders": ([(10, 1), (11, 1), (12, None)], "o_orderkey long, o_custkey long"),
        "lineitem": ([(10, 5, 1, 1, day(9), 1.0, 0.0, "R"), (11, 99, 1, 1, day(2), 1.0, 0.0, "R"), (11, None, 1, 2, day(4), 1.0, 0.0, "N")],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_shipdate timestamp, "
                     "l_extendedprice double, l_discount double, l_returnflag string"),
        "part": ([(5, "brand")], "p_partkey long, p_brand string"),
    }
    for name, (content, schema) in told.items():
        spark.createDataFrame(content, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    made = adapter.activity(spark, str(tmp_path))
    assert rows(made.accounts.select("id", "opened_at")) == sorted([("1", day(2)), ("1", day(2)), ("2", None), (None, None)], key=str)
    assert made.orders.count() == 1 and made.returns.count() == 1
    lines = adapter.order_lines(spark, str(tmp_path))
    # the opening of accounts moves no line again
    assert plan(adapter.accounts(spark.read.parquet(f"{tmp_path}/customer.parquet"), lines)).count("Exchange hashpartitioning(account_id") == 0


def test_named_nodes_and_edges_of_dossiers_meet_no_clusters(spark, folder):  # noqa: F811
    r = registry.run_of(spark, folder)
    d = r.detection
    nodes, edges = r.named_subgraph
    members = d.cluster_members.join(d.cluster_ids.select("cluster", "cluster_id"), "cluster_id").drop("cluster_id")
    named = dossier.dossier_json(d.clusters, members, nodes, edges, r.now)
    plain = dossier.dossier_json(d.clusters, members, r.subgraph_nodes, r.subgraph_edges, r.now)
    assert named.where("section = 'node'").count() > 0
    assert rows(named) == rows(plain)
    line = dossier.dossier_json(d.clusters, members, nodes.limit(0), edges, r.now)
    assert "Join" not in plan(line.where("section = 'node'"))


def test_stars_end_in_one_round(spark, monkeypatch):
    rounds, told = [], components.keep

    def counted(df):
        rounds.append(df)
        return told(df)

    monkeypatch.setattr(components, "keep", counted)
    stars = spark.range(2000).selectExpr("id * 7919 AS src", "(id div 40) * 7919 * 40 AS dst")
    found = components.connected_components(stars)
    assert found.count() == 2000 and found.select("component").distinct().count() == 50
    assert len(rounds) <= 2
