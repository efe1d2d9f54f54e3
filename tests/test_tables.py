"""Reviews, audit log, evaluation, reports and sinks."""

from __future__ import annotations

import csv
import json
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.scenarios import scenario
from tieline.config import DetectConfig
from tieline.operators import audit, evaluation, incidence, links, reports, reviews
from tieline.plans.detection import Detection, run_outcome
from tieline.sources import dossier, store

def now():
    return F.lit("2026-04-01 09:00:00").cast("timestamp")


@pytest.fixture(scope="module")
def detection(spark):
    ring, home = scenario(spark, "clear-ring"), scenario(spark, "legitimate-household")
    both = type(ring)(*[a.unionByName(b) for a, b in zip(ring, home)])
    return Detection(both)


# --- reviews ------------------------------------------------------------------------
def decision(review, sequence, what, verdict=None, why=None):
    return (review, sequence, what, "rita", None, verdict, why)


DECISIONS = "review_id string, sequence int, decision string, reviewer_id string, note string, reviewer_verdict string, benign_explanation string"


def test_review_queue(spark, detection):
    none = spark.createDataFrame([], reviews.REVIEWS)
    opened = reviews.open_reviews(detection.clusters, none, now())
    rows = {r.machine_verdict: r for r in opened.collect()}
    assert set(rows) == {"COORDINATION_LIKELY", "COORDINATION_POSSIBLE"}
    assert reviews.open_reviews(detection.clusters, opened, now()).count() == 0

    ring, home = rows["COORDINATION_LIKELY"].id, rows["COORDINATION_POSSIBLE"].id
    batch = spark.createDataFrame(
        [
            decision(ring, 1, "NEEDS_MORE_DATA"), decision(ring, 2, "CONFIRMED", "COORDINATION_LIKELY"),
            decision(ring, 3, "ESCALATED"), decision(home, 1, "DISMISSED", why="  "),
            decision(home, 2, "DISMISSED", "NO_COORDINATION_INDICATED", " one family "), decision("rev_x", 1, "CONFIRMED"),
            decision(home, 0, "BANNED"),
        ],
        DECISIONS,
    )
    judged = reviews.judge_decisions(batch, opened)
    refused = {(r.review_id, r.sequence): r.reason_code for r in reviews.rejected(judged).collect()}
    assert refused == {
        (ring, 3): "REVIEW_ALREADY_DECIDED", (home, 1): "VALIDATION_ERROR",
        ("rev_x", 1): "REVIEW_NOT_FOUND", (home, 0): "VALIDATION_ERROR",
    }
    after = reviews.apply_decisions(judged, opened, now())
    state = {r.id: r for r in after.collect()}
    assert (state[ring].status, state[ring].reviewed_by) == ("CONFIRMED", "rita")
    assert (state[home].status, state[home].machine_risk) == ("DISMISSED", rows["COORDINATION_POSSIBLE"].machine_risk)
    agreement = reviews.reviewer_agreement(after).first()
    assert (agreement.decided, agreement.agreed, float(agreement.rate)) == (2, 1, 0.5)
    assert [tuple(r) for r in reviews.dismissal_reasons(after).collect()] == [("one family", 1)]
    assert reviews.list_reviews(after, detection.clusters, "CONFIRMED").count() == 1
    again = reviews.judge_decisions(spark.createDataFrame([decision(ring, 9, "CONFIRMED")], DECISIONS), after)
    assert again.first().rejection == "REVIEW_ALREADY_DECIDED"


def test_more_data_leaves_the_review_pending(spark, detection):
    opened = reviews.open_reviews(detection.clusters, spark.createDataFrame([], reviews.REVIEWS), now())
    key = opened.first().id
    judged = reviews.judge_decisions(spark.createDataFrame([decision(key, 1, "NEEDS_MORE_DATA")], DECISIONS), opened)
    row = reviews.apply_decisions(judged, opened, now()).where(F.col("id") == key).first()
    assert (row.status, row.reviewed_by) == ("PENDING", "rita")
    assert reviews.reviewer_agreement(opened).first().rate is None


# --- audit ----------------------------------------------------------------------------
def test_audit_log_is_in_order_and_searchable(spark, detection):
    low = Detection(detection.activity, DetectConfig(risk_threshold=40))
    opened = reviews.open_reviews(low.clusters, spark.createDataFrame([], reviews.REVIEWS), now())
    events = audit.run_events(run_outcome(low.clusters), "run_1", "shared-entity", now(), "c1").unionByName(
        audit.review_requested_events(opened, now() + F.expr("interval 1 minute"), "c1")
    )
    log = audit.sequenced(events, after=10)
    rows = log.orderBy("sequence").collect()
    assert [r.sequence for r in rows] == list(range(11, 11 + len(rows)))
    assert {r.action for r in rows[:2]} == {"DETECTION_STARTED", "DETECTION_COMPLETED"}
    assert json.loads(next(r for r in rows if r.action == "DETECTION_COMPLETED").metadata)["clusters"] == 2
    newest = audit.query_audit(log, result="SUCCESS", since=datetime(2026, 4, 1), limit=1).first()
    assert newest.sequence == rows[-1].sequence
    assert audit.query_audit(log, actor_id="nobody").count() == 0
    assert audit.count_audit(log, correlation_id="c1").first().total == len(rows)
    assert audit.cluster_history(log, rows[-1].cluster_id).count() == 1
    assert audit.recent_failures(log).count() == 0


def test_guardrail_events(spark):
    clusters = spark.createDataFrame(
        [("clu_1", True, Decimal("34"), Decimal("7"), 8), ("clu_2", False, Decimal("1"), Decimal("9"), 3)],
        "cluster_id string, capped_by_guardrail boolean, structural_points decimal(9,2), behavioural_points decimal(9,2), account_count bigint",
    )
    (event,) = audit.guardrail_events(clusters, now(), "c").collect()
    assert (event.action, event.result, event.cluster_id) == ("GUARDRAIL_APPLIED", "BLOCKED", "clu_1")
    assert json.loads(event.metadata)["account_count"] == 8


# --- evaluation -------------------------------------------------------------------------
def predictions(spark, rows):
    return spark.createDataFrame(
        [(f"r{i}", t, "EASY", label, "dev", None if risk is None else Decimal(str(risk)), flagged, abstained, Decimal("0.5"), None)
         for i, (t, label, risk, flagged, abstained) in enumerate(rows)],
        "ring_id string, template string, difficulty string, actual_label string, split string, predicted_risk decimal(9,2), "
        "flagged boolean, abstained boolean, member_overlap decimal(9,4), cluster_id string",
    )


CASES = [
    ("A", "SUSPICIOUS", 80, True, False), ("A", "SUSPICIOUS", 60, False, False), ("B", "BENIGN", 75, True, False),
    ("B", "BENIGN", 30, False, False), ("C", "BENIGN", None, False, False), ("C", "BENIGN", 90, True, True),
]


def test_performance_has_denominators(spark):
    row = evaluation.performance(predictions(spark, CASES)).first()
    assert (row.tp, row.fp, row.tn, row.fn, row.abstained, row.total, row.decided) == (1, 1, 2, 1, 1, 6, 5)
    assert tuple(row.precision) == (Decimal("0.5000"), 1, 2) and row.f1 == Decimal("0.5000")
    assert tuple(row.false_positive_rate) == (Decimal("0.3333"), 1, 3)
    nothing = evaluation.performance(predictions(spark, CASES).where("false")).first()
    assert nothing.precision.value is None and nothing.f1 is None and nothing.total == 0


def test_evaluation_events(spark):
    measured = evaluation.performance(predictions(spark, CASES))
    events = {e.action: json.loads(e.metadata) for e in audit.evaluation_events(measured, "evr_1", "dev", now(), "c").collect()}
    assert events["EVALUATION_STARTED"] == {"split": "dev"}
    assert events["EVALUATION_COMPLETED"] == {"rings": 6, "precision": 0.5, "recall": 0.5}


def test_sweep_keeps_abstentions_and_takes_the_cheapest(spark):
    sweep = {r.threshold: r for r in evaluation.threshold_sweep(predictions(spark, CASES)).collect()}
    assert all(r.abstained == 1 for r in sweep.values())
    assert sweep[60].total_cost == 6 + 1 and sweep[80].total_cost == 10 + 1
    chosen = evaluation.select_threshold(evaluation.threshold_sweep(predictions(spark, CASES))).first()
    assert (chosen.threshold, chosen.cost_at_selection, chosen.candidates_evaluated) == (50, 7, 9)
    empty = evaluation.select_threshold(evaluation.threshold_sweep(predictions(spark, CASES).where("false"))).first()
    assert (empty.threshold, empty.candidates_evaluated) == (70, 0)


def test_hard_negatives_slices_and_recovery(spark):
    found = predictions(spark, CASES)
    worst = evaluation.hard_negatives(found).collect()
    assert [(r.template, r.false_positives, float(r.false_positive_rate), float(r.mean_risk)) for r in worst] == [
        ("B", 1, 0.5, 52.5), ("C", 0, 0.0, 90.0),
    ]
    assert {r.template: r.total for r in evaluation.slices(found, "template").collect()} == {"A": 2, "B": 2, "C": 2}
    flags = spark.createDataFrame([("r0", False), ("r1", True)], "ring_id string, baseline_flagged boolean")
    row = evaluation.coordination_recovery(found, flags).first()
    assert (row.baseline_missed, row.graph_recovered, row.graph_missed_baseline_caught, float(row.recovery_rate)) == (1, 1, 1, 1.0)


def test_matching_rings(spark, detection):
    members = detection.activity.accounts.select(
        F.when(F.col("id").startswith("clear"), "ring").otherwise("home").alias("ring_id"), F.col("id").alias("account_id")
    )
    rings = spark.createDataFrame(
        [("ring", "SUSPICIOUS", "T", "EASY", "dev"), ("home", "BENIGN", "H", "HARD", "dev"), ("ghost", "SUSPICIOUS", "T", "HARD", "dev")],
        "id string, label string, template string, difficulty string, split string",
    )
    got = {r.ring_id: r for r in evaluation.match_rings(rings, members, detection.cluster_accounts, detection.clusters).collect()}
    assert got["ring"].flagged and float(got["ring"].member_overlap) == 1
    assert not got["home"].flagged and got["home"].cluster_id
    assert got["ghost"].cluster_id is None and float(got["ghost"].member_overlap) == 0
    purity = {r.ring_id: r.pure for r in evaluation.split_purity(rings, members, detection.activity.accounts).collect()}
    assert purity == {"ring": True, "home": True}
    truth = members.where("ring_id = 'ring'").select("account_id", F.lit("SUSPICIOUS").alias("label"))
    everyone = evaluation.account_predictions(detection.activity.accounts, truth, detection.cluster_accounts, detection.clusters)
    row = evaluation.performance(everyone).first()
    assert (row.tp, row.tn, row.fp, row.fn) == (8, 4, 0, 0)
    labelled = evaluation.account_predictions(
        detection.activity.accounts, truth, detection.cluster_accounts, detection.clusters, include_unlabelled=False
    )
    assert labelled.count() == 8
    stored = rings.limit(1).withColumn("member_account_ids", F.array(F.lit("x"), F.lit("y")))
    assert evaluation.ring_members(stored).count() == 2


# --- reports and sinks -------------------------------------------------------------------
@pytest.fixture(scope="module")
def subgraph(detection):
    edges = reports.subgraph_edges(detection.members, detection.inside, detection.observed)
    nodes = reports.subgraph_nodes(
        detection.members, edges, detection.entities, links.link_fanout(detection.edges, detection.fan_out)
    )
    return nodes, edges


def test_visible_subgraph(subgraph):
    nodes, edges = subgraph
    shown, kept = reports.visible(nodes, edges, ("DEVICE",))
    assert shown.where("type = 'DEVICE'").count() == 0
    assert kept.where("type = 'USES'").count() == 0 and kept.where("derived").count() == edges.where("derived").count()
    assert reports.visible(nodes, edges, show_derived=False)[1].where("derived").count() == 0


def test_dossiers(detection, subgraph, tmp_path):
    nodes, edges = subgraph
    table = dossier.dossier_table(detection.clusters, nodes, edges, now())
    dossier.write_csv(table.withColumn("label", F.concat("label", F.lit(', "q"'))), str(tmp_path / "csv"))
    rows = []
    for part in (tmp_path / "csv").glob("*.csv"):
        with part.open(newline="", encoding="utf-8") as lines:
            rows.extend(csv.DictReader(lines))
    assert len({r["cluster_id"] for r in rows}) == 2 and len(rows) == table.count()
    assert all(r["label"].endswith(', "q"') for r in rows)
    assert all(int(r["degree"]) == int(r["derived_links"]) + int(r["observed_links"]) for r in rows)

    members = detection.cluster_members.join(detection.cluster_ids.select("cluster", "cluster_id"), "cluster_id").drop("cluster_id")
    whole = dossier.dossier_json(detection.clusters, members, nodes, edges, now())
    dossier.write_json(whole, str(tmp_path / "json"))
    documents = [json.loads(line) for part in (tmp_path / "json").glob("part-*") for line in part.read_text(encoding="utf-8").splitlines()]
    ids = {d["cluster"]["cluster_id"] if "cluster" in d else d["cluster_id"] for d in documents}
    assert len(ids) == 2
    count = lambda key: sum(key in d for d in documents)
    assert count("notice") == 2 and count("joined_via") == 12 == members.count()
    assert len(documents) == 2 + members.count() + nodes.count() + edges.count()
    assert {r.section for r in whole.select("section").distinct().collect()} == {"cluster", "member", "node", "edge"}


def test_coverage_and_overview(spark, detection):
    row = reports.coverage(detection.activity, detection.orphans).first()
    assert (row.accounts, row.with_device, row.orphan_accounts, float(row.missing_device)) == (12, 12, 0, 0.0)
    empty = spark.createDataFrame([], reviews.REVIEWS)
    runs = spark.createDataFrame(
        [("r1", 5, 4, 3, datetime(2021, 3, 1)), ("r2", 7, 6, 2, datetime(2021, 3, 2))],
        "id string, entity_count bigint, derived_edge_count bigint, cluster_count bigint, created_at timestamp",
    )
    none = spark.createDataFrame([], "id string, ring_count bigint, risk_threshold int, started_at timestamp")
    summary = reports.overview(
        detection.entities, detection.edges.select("derived"), detection.activity, detection.orphans,
        detection.clusters, empty, runs, none,
    )
    values = {(r.section, r.key): r.value for r in summary.collect()}
    assert values["totals", "clusters"] == 2 and values["totals", "runs"] == 2 and values["totals", "evaluations"] == 0
    assert values["entities_by_type", "ACCOUNT"] == 12
    assert values["latest_run", "cluster_count"] == 2 and values["totals", "reviews_decided"] == 0
    assert not any(section == "latest_evaluation" for section, _ in values)


def test_stored_lines_are_read_back(spark, detection):
    lines = dossier.cluster_lines(detection.clusters, F.lit("2021-01-01").cast("timestamp"))
    whole = detection.clusters.orderBy("cluster_id").collect()
    read = dossier.read_clusters(lines).orderBy("cluster_id").collect()
    for was, now in zip(whole, read, strict=True):
        assert not now.damaged and (now.risk_score, now.verdict) == (was.risk_score, was.verdict)
        assert [(s.signal, s.points) for s in now.signals] == [(s.signal, s.points) for s in was.signals]
        assert [s.detail for s in now.counter_signals] == [s.detail for s in was.counter_signals]
    bad = spark.createDataFrame(
        [("a", "cluster", '{"risk_score": '), ("b", "cluster", None), ("c", "cluster", '{"account_count": "many"}'), ("d", "node", "{}")],
        "cluster_id string, section string, document string",
    )
    got = {r.cluster_id: (r.damaged, r.risk_score, r.signals) for r in dossier.read_clusters(bad).collect()}
    assert got == {name: (True, None, None) for name in "abc"}


def test_edge_table_replaces_only_the_inferred_half(spark, detection, tmp_path):
    path = str(tmp_path / "edges")
    store.write_observed(detection.observed, path)
    store.replace_inferred(detection.edges, path)
    counts = lambda: {r.derived: r["count"] for r in store.read_edges(spark, path).groupBy("derived").count().collect()}
    before = counts()
    assert before[True] == detection.edges.count()
    store.replace_inferred(detection.edges.limit(1), path)
    spark.catalog.refreshByPath(path)
    assert counts() == {True: 1, False: before[False]}
    store.replace_inferred(detection.edges.limit(0), path)
    spark.catalog.refreshByPath(path)
    assert counts() == {False: before[False]}


def test_inserts_and_upserts(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "id string, run int, risk int")
    path = str(tmp_path / "rows")
    store.insert_new(frame([("a", 1, 1), ("a", 1, 1), ("b", 1, 2)]), path, "id")
    store.insert_new(frame([("b", 2, 9), ("c", 2, 3)]), path, "id")
    assert {tuple(r) for r in store.read_inserted(spark, path).collect()} == {("a", 1, 1), ("b", 1, 2), ("c", 2, 3)}
    log = str(tmp_path / "log")
    store.append(frame([("a", 3, 3)]), log)
    store.append(frame([("a", 3, 3)]), log)
    assert spark.read.parquet(log).count() == 2

    table = str(tmp_path / "clusters")
    store.upsert(frame([("a", 1, 10), ("b", 1, 20)]), table, "id", "run")
    store.upsert(frame([("b", 2, 25), ("c", 2, 30)]), table, "id", "run")
    store.upsert(frame([("a", 0, 99)]), table, "id", "run")
    assert {r.id: r.risk for r in store.read_latest(spark, table).collect()} == {"a": 10, "b": 25, "c": 30}
    assert store.read_latest(spark, str(tmp_path / "nothing")) is None


def test_upsert_leaves_untouched_buckets_alone(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "id string, run int, risk int")
    table = str(tmp_path / "clusters")
    store.upsert(frame([(f"k{i}", 1, i) for i in range(200)]), table, "id", "run")
    before = store.manifest(spark, table)
    store.upsert(frame([("k7", 2, -7)]), table, "id", "run")
    after = store.manifest(spark, table)
    changed = [b for b in after if before.get(b) != after[b]]
    assert len(changed) == 1 and len(after) > 40
    kept = {p.name for p in (tmp_path / "clusters").glob("part-*/*") if p.is_dir() and list(p.glob("*.parquet"))}
    assert len(list((tmp_path / "clusters").glob("part-*/key_bucket=*"))) == len(after) and kept
    got = {r.id: r.risk for r in store.read_latest(spark, table).collect()}
    assert got == {f"k{i}": (-7 if i == 7 else i) for i in range(200)}
    store.upsert(frame([]), table, "id", "run")
    assert store.manifest(spark, table) == after


def test_filter_spares_the_stored_rows(spark, tmp_path, monkeypatch):
    frame = lambda ids: spark.createDataFrame([(i, 1) for i in ids], "id string, run int")
    path = str(tmp_path / "labels")
    store.insert_new(frame([f"a{i}" for i in range(300)]), path, "id")
    news, both = frame([f"b{i}" for i in range(300)]), frame(["a5", "b5", "a299"])
    named = lambda rows: rows.withColumn(store.BUCKET, store._bucket(("id",)))
    assert {r.id for r in store.possible_repeats(named(both), path, "id").collect()} == {"a5", "a299"}
    assert store.possible_repeats(named(news), path, "id").count() == 0
    reads = []
    real = store._exists
    monkeypatch.setattr(store, "_exists", lambda s, p: reads.append(p) or real(s, p))
    store.insert_new(news, path, "id")
    assert not reads  # nothing could be a repeat, so the stored rows were not asked for
    store.insert_new(both, path, "id")
    assert reads and store.read_inserted(spark, path).count() == 600


def test_orders_of_unknown_accounts_drop_out(spark, detection):
    strangers = detection.activity.accounts.where(F.col("id") != "clear-ring_00")
    seen = incidence.incidence(detection.activity.orders, strangers)
    assert seen.where("account = 'ent_acc_clear-ring_00'").count() == 0
    by_table = incidence.incidence(detection.activity.orders, strangers, detection.entities)
    assert sorted(map(tuple, by_table.collect())) == sorted(map(tuple, seen.collect()))
