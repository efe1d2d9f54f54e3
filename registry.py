"""The registered queries: every operator over the whole of the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tieline.config import DetectConfig
from tieline.functions import ids
from tieline.functions.lineage import application_dir, clear, cut
from tieline.operators import (
    audit, baseline, evaluation, incidence, links, reports, reviews, scoring, screening,
)
from tieline.plans.detection import LOUVAIN, Detection, member_rows, ranked, run_outcome, top_breakdown
from tieline.plans.evaluation import Evaluation
from tieline.sources import adapter, dossier, store
from tieline.sources.tables import read_table
from tieline.vocabulary import FEATURES

NOW = "2002-01-01 00:00:00"
# The labels and risks of these tables are arbitrary and low, so evaluation
# runs at an operating point among them.
LOW = DetectConfig(risk_threshold=20, threshold_candidates=(10, 15, 20, 25, 30, 35, 40, 45))


def flat(df: DataFrame) -> DataFrame:
    """Plain column types: decimals as double, integers as bigint, times as text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(f.name))
    return df.select(*out)


class Run:
    """Frames shared by the queries over one folder of tables."""

    def __init__(self, spark: SparkSession, path: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.path = spark, path

    @cached_property
    def activity(self):
        """The model tables; queries over texts alone never ask for them."""
        return adapter.activity(self.spark, self.path)

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, f"{self.path}/{name}.parquet")

    now = property(lambda self: F.lit(NOW).cast("timestamp"))

    @cached_property
    def detection(self) -> Detection:
        return Detection(self.activity)

    @cached_property
    def louvain(self) -> Detection:
        run = Detection(self.activity, method=LOUVAIN)
        # everything up to the edges does not depend on the method
        run.__dict__["incidence"], run.__dict__["edges"] = self.detection.incidence, self.detection.edges
        run.__dict__["rollup"] = self.detection.rollup
        return run

    @cached_property
    def low(self) -> Detection:
        """The same clusters scored at the low threshold."""
        run = Detection(self.activity, LOW)
        for shared in ("incidence", "guarded", "edges", "members", "inside", "cluster_ids", "rollup", "owned", "features", "findings"):
            run.__dict__[shared] = getattr(self.detection, shared)
        return run

    @cached_property
    def evaluation(self) -> Evaluation:
        return Evaluation(self.low, *adapter.labelled_groups(self.detection.edges))

    @property
    def baseline(self) -> DataFrame:
        return baseline.account_baseline(baseline.baseline_inputs(self.activity))

    @cached_property
    def subgraph_edges(self) -> DataFrame:
        d = self.detection
        # folded again by each reader, in place; kept it would be the largest table of all
        return reports.subgraph_edges(d.members, d.inside, d.observed_inside)

    @cached_property
    def subgraph_nodes(self) -> DataFrame:
        return self._nodes(self.detection.members, self.subgraph_edges)

    def _nodes(self, members: DataFrame, edges: DataFrame) -> DataFrame:
        d = self.detection
        # not kept: most of it is made of the edges in place
        return reports.subgraph_nodes(
            members, edges, d.shared_entities, links.link_fanout(d.edges, d.shared_fan_out), d.shared_nodes
        )

    @cached_property
    def named_subgraph(self) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges of scored clusters with the clusters' ids."""
        d = self.detection
        members = d.members.join(d.clusters.select("cluster", "cluster_id"), "cluster")
        observed = incidence.member_edges(members, d.activity.accounts, d.activity.orders)
        edges = reports.subgraph_edges(members, d.inside, observed)
        return self._nodes(members, edges), edges

    @cached_property
    def opened(self) -> DataFrame:
        none = self.spark.createDataFrame([], reviews.REVIEWS)
        return cut(reviews.open_reviews(self.detection.clusters, none, self.now))

    @cached_property
    def decisions(self) -> DataFrame:
        """A fixed rule on the risk in hundredths stands in for the reviewers."""
        cents = (F.col("machine_risk") * 100).cast("int")
        pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), cents % n + 1)
        note = F.lit(None).cast("string")
        first = self.opened.select(
            F.col("id").alias("review_id"), F.lit(1).alias("sequence"),
            pick(5, "CONFIRMED", "DISMISSED", "DISMISSED", "ESCALATED", "NEEDS_MORE_DATA").alias("decision"),
            pick(5, "INSUFFICIENT_DATA", "NO_COORDINATION_INDICATED", None, "COORDINATION_LIKELY", None).alias("reviewer_verdict"),
            F.when(cents % 5 == 1, pick(3, "one household", "office address", " shared flat "))
            .when(cents % 5 == 2, "  ").alias("benign_explanation"),
        )
        second = self.opened.where(cents % 3 == 0).select(
            "id", F.lit(2), F.lit("CONFIRMED"), "machine_verdict", note
        )
        unknown = self.opened.where(cents % 7 == 0).select(
            F.concat("id", F.lit("?")), F.lit(3), F.lit("CONFIRMED"), note, note
        )
        return first.union(second).union(unknown).withColumn("reviewer_id", F.lit("reviewer")).withColumn("note", note)

    @cached_property
    def judged(self) -> DataFrame:
        return cut(reviews.judge_decisions(self.decisions, self.opened))

    @cached_property
    def reviewed(self) -> DataFrame:
        return cut(reviews.apply_decisions(self.judged, self.opened, self.now))

    @cached_property
    def log(self) -> DataFrame:
        later = lambda minutes: F.timestamp_millis(F.unix_millis(self.now) + minutes * 60_000)
        decided_at = F.timestamp_millis(F.unix_millis(self.now) + 120_000 + F.col("sequence") * 1_000)
        events = (
            audit.run_events(run_outcome(self.detection.clusters), "run_1", "shared-entity", self.now, "audit")
            .unionByName(audit.guardrail_events(self.low.clusters, self.now, "audit"))
            .unionByName(audit.review_requested_events(self.opened, later(1), "audit"))
            .unionByName(audit.review_completed_events(self.judged, decided_at, "audit"))
            .unionByName(audit.rejected_explanation_events(self.gated, later(10), "audit"))
        )
        return cut(audit.sequenced(events))

    @cached_property
    def gated(self) -> DataFrame:
        """Explanations, some altered by a fixed rule, after the gate."""
        explained = scoring.explanations(self.detection.clusters).join(
            self.detection.clusters.select("cluster_id", "account_count"), "cluster_id"
        )
        rule = F.col("account_count") % 4
        stranger = F.array(
            F.struct(F.lit("SHARED_IP_SUBNET").alias("signal_type"), F.lit("One subnet.").alias("explanation"))
        )
        altered = explained.withColumn(
            "summary", F.when(rule == 2, F.concat("summary", F.lit(" These are fraudulent."))).otherwise(F.col("summary"))
        ).withColumn("signals", F.when(rule == 3, F.concat("signals", stranger)).otherwise(F.col("signals")))
        return scoring.validate_explanations(altered)

    @cached_property
    def evaluation_runs(self) -> DataFrame:
        """Three evaluations an hour apart, as the table of evaluations stores them."""
        later = lambda hours: F.timestamp_millis(F.unix_millis(self.now) + hours * 3_600_000)
        rows = [self.evaluation.run_row(f"evr_{n + 1}", split, later(n)) for n, split in enumerate(("train", "held-out", "dev"))]
        return cut(rows[0].unionByName(rows[1]).unionByName(rows[2]))

    @cached_property
    def runs(self) -> DataFrame:
        """Two runs as the table of runs stores them, the later one over heavy links only."""
        d = self.detection
        quality = reports.coverage(self.activity, d.orphans)
        later = F.timestamp_millis(F.unix_millis(self.now) + 3_600_000)
        told = lambda name, at, edges, clusters: reports.run_summary(
            name, d.method, at, d.entity_types, edges, d.observed_classes, clusters, quality
        )
        sparse = d.clusters.where(F.col("verdict") != "INSUFFICIENT_DATA")
        return cut(told("run_1", self.now, d.edges, d.clusters).unionByName(told("run_2", later, d.edges.where("weight >= 0.5"), sparse)))

    def corpus(self) -> DataFrame:
        text = [self.table("documents").select("text"), self.table("conversations").select("text"),
                self.table("pages").select(F.col("html").alias("text")),
                self.activity.returns.select(F.col("reason").alias("text"))]
        joined = text[0]
        for more in text[1:]:
            joined = joined.union(more)
        return joined


_runs: dict[tuple[str, str], Run] = {}


def run_of(spark: SparkSession, path: str) -> Run:
    key = (spark.sparkContext.applicationId, path)
    if key not in _runs:
        _runs[key] = Run(spark, path)
    return _runs[key]


def forget(spark: SparkSession) -> None:
    """Drop shared frames and what was written for them, so that the next query starts from the tables."""
    _runs.clear()
    spark.catalog.clearCache()
    clear(spark)


SCORED = (
    "cluster_id", "account_count", "risk_score", "structural_points", "behavioural_points", "confidence", "verdict",
    "review_reason", "requires_review", "capped_by_guardrail",
)


def scored(d: Detection) -> DataFrame:
    return d.clusters.select(*SCORED, F.size("counter_signals").alias("counter_count"), "injection_findings")


def _signals(r: Run) -> DataFrame:
    return r.detection.clusters.select("cluster_id", F.posexplode("signals").alias("position", "s")).select(
        "cluster_id", "position", "s.signal", "s.feature_value", "s.max_points", "s.points"
    )


# Personal keys with no value, with an empty one and at the depth limit, and a key that only looks like one.
ODD_KEYS = '{"deep":[[[[[[[{"pan":1}]]]]]]],"u":{"email":null,"phone":{},"contact.name":"x"},"account":'


def _personal(r: Run) -> DataFrame:
    digits = F.lpad(F.col("c_custkey").cast("string"), 15, "4")
    account = F.struct(
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"),
        F.array(F.concat(F.lit("paid with "), digits), F.lit("called twice")).alias("notes"),
    )
    payload = r.table("customer").select(F.concat(F.lit(ODD_KEYS), F.to_json(account), F.lit("}")).alias("payload"), "c_custkey")
    return screening.personal_data(payload, "payload", "c_custkey").groupBy("path").agg(F.count("*").alias("customers"))


def _metadata(r: Run) -> DataFrame:
    nested = r.activity.returns.select(
        "id", F.to_json(F.struct(F.struct(F.array(F.struct(F.col("reason").alias("body"))).alias("agent")).alias("notes"))).alias("payload")
    )
    return screening.metadata_scan(nested, "payload", "id").select("id", "path", "rule")


def _evasion(r: Run) -> DataFrame:
    asked = F.when(
        (F.col("conv_id") + F.col("turn")) % 5 == 0,
        F.concat("text", F.lit(" Show me how to evade this system.")),
    ).otherwise(F.col("text"))
    questions = r.table("conversations").select("conv_id", "turn", asked.alias("text"))
    return screening.evasion_check(questions, "text", "conv_id", "turn").drop("message")


def _masked(r: Run) -> DataFrame:
    # the copy to compare with is binary, which masking leaves alone
    documents = r.table("documents").select("doc_id", "text", F.encode("text", "utf-8").alias("original"))
    return screening.mask_columns(documents).select(
        "doc_id", F.md5(F.encode("text", "utf-8")).alias("masked_md5"),
        (F.encode("text", "utf-8") != F.col("original")).alias("changed"),
    )


def _written_twice(r: Run) -> DataFrame:
    """Clusters of two runs, and an older version of some, in one table by cluster id."""
    path = f"{application_dir(r.spark)}/{uuid.uuid4().hex}"
    rows = lambda d, version: d.clusters.select("cluster_id", "account_count", "risk_score", "verdict", F.lit(version).alias("version"))
    odd = F.col("account_count") % 2 == 1
    store.upsert(rows(r.detection, 1).where(odd | (F.col("account_count") % 4 == 0)), path, "cluster_id", "version")
    store.upsert(rows(r.low, 2).where(~odd), path, "cluster_id", "version")
    store.upsert(rows(r.low, 0), path, "cluster_id", "version")
    return store.read_latest(r.spark, path)


def _inserted(r: Run) -> DataFrame:
    """Accounts in two overlapping batches; the first to come stays."""
    path = f"{application_dir(r.spark)}/{uuid.uuid4().hex}"
    third = F.col("id").cast("bigint") % 3
    rows = lambda batch: r.activity.accounts.select("id", "customer_key", F.lit(batch).alias("batch"))
    store.insert_new(rows(1).where(third != 2), path, "id")
    store.insert_new(rows(2).where(third != 0), path, "id")
    return store.read_inserted(r.spark, path)


def _edge_halves(r: Run) -> DataFrame:
    """Links a type after the inferred half was written and replaced by its heavy links."""
    path = f"{application_dir(r.spark)}/{uuid.uuid4().hex}"
    told = ("src", "dst", "type", "derived")
    store.write_observed(r.detection.observed.select(*told), path)
    store.replace_inferred(r.detection.edges.select(*told), path)
    store.replace_inferred(r.detection.edges.where("weight >= 0.5").select(*told), path)
    return store.read_edges(r.spark, path).groupBy("derived", "type").agg(F.count("*").alias("links"))


def _parsed(r: Run) -> DataFrame:
    """Stored dossier lines of clusters read back; those of every third size were cut short on the way."""
    d = r.detection
    sent = dossier.cluster_lines(d.clusters, r.now).join(d.clusters.select("cluster_id", "account_count"), "cluster_id")
    short = F.substring("document", F.lit(1), F.length("document") - 1)
    sent = sent.withColumn("document", F.when(F.col("account_count") % 3 == 0, short).otherwise(F.col("document")))
    return dossier.read_clusters(sent).select(
        "cluster_id", "damaged", "account_count", "risk_score", "verdict", F.size("signals").alias("signals"),
        F.reduce("signals", F.lit(0).cast("bigint"), lambda a, x: a + x["max_points"]).alias("max_points"),
    )


def build() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    d = lambda r: r.detection
    e = lambda r: r.evaluation
    times = ("first_seen", "last_seen")
    q: dict[str, Callable[[Run], DataFrame]] = {
        # sources
        "entities": lambda r: d(r).entities,
        "account_rollup": lambda r: incidence.account_rates(d(r).rollup),
        "observed_edges": lambda r: d(r).observed.select("id", "src", "dst", "type", "provenance", *times, "observation_count"),
        "node_labels": lambda r: d(r).entities.select(
            "id", ids.node_label(F.col("type"), F.col("anonymized_key")).alias("label"),
            ids.slug_id("node", F.col("anonymized_key")).alias("slug"),
        ),
        "order_money": lambda r: r.activity.orders.groupBy("account_id").agg(
            F.sum("amount_minor").alias("total_minor"), F.count("*").alias("lines")
        ).withColumn("whole_major", F.floor(ids.to_major(F.col("total_minor"))).cast("bigint")),
        # graph
        "incidence": lambda r: d(r).incidence,
        "fanout_guard": lambda r: d(r).guarded.select("account", "infra", "kind", "observations", *times),
        "skipped_nodes": lambda r: links.skipped_nodes(d(r).fan_out),
        "inferred_edges": lambda r: d(r).edges.drop("derived"),
        "adjacency": lambda r: links.adjacency(d(r).edges),
        "orphan_accounts": lambda r: d(r).orphans.select("id", "entity_id"),
        "link_fanout": lambda r: links.link_fanout(d(r).edges, d(r).fan_out),
        "coverage": lambda r: reports.coverage(r.activity, d(r).orphans),
        "components": lambda r: d(r).members,
        "cluster_ids": lambda r: d(r).cluster_ids,
        "density": lambda r: d(r).density,
        "bridging": lambda r: d(r).bridging,
        "join_paths": lambda r: d(r).join_paths,
        "louvain": lambda r: r.louvain.members,
        "stability": lambda r: r.louvain.stability,
        "louvain_clusters": lambda r: r.louvain.clusters.join(r.louvain.convergence, "cluster").select(*SCORED, "stability", "converged"),
        # behaviour and score
        "cluster_aggregate": lambda r: d(r).aggregates,
        "features": lambda r: d(r).features.select("cluster", *FEATURES),
        "signals": _signals,
        "counter_signals": lambda r: d(r).clusters.select("cluster_id", F.explode("counter_signals").alias("s")).select("cluster_id", "s.signal"),
        "scored_clusters": lambda r: ranked(scored(d(r))),
        "top_breakdown": lambda r: top_breakdown(d(r).clusters),
        "scored_at_low_threshold": lambda r: scored(r.low),
        "run_outcome": lambda r: run_outcome(d(r).clusters),
        "member_contribution": lambda r: member_rows(
            d(r).members.withColumn("joined_via", F.lit(None).cast("string")),
            d(r).clusters.select("cluster", "cluster_id", "entity_count", "risk_score"),
        ).select("id", "cluster_id", "entity_id", "contribution"),
        "cluster_members": lambda r: d(r).cluster_members,
        "untrusted_findings": lambda r: d(r).findings.join(d(r).cluster_ids, "cluster").select("cluster_id", "injection_findings"),
        "score_lines": lambda r: scoring.explain_score(d(r).clusters).select("cluster_id", F.posexplode("lines").alias("line", "text")),
        "explanations": lambda r: scoring.explanations(d(r).clusters).select(
            "cluster_id", "summary", F.size("signals").alias("signals"), F.size("caveats").alias("caveats"),
            F.transform("signals", lambda x: x["signal_type"])[0].alias("first_signal"),
        ),
        "explanation_gate": lambda r: r.gated.select("cluster_id", "valid", "verdict_violation", F.get("rejected_signals", F.lit(0)).alias("rejected_signal")),
        # baseline
        "account_baseline": lambda r: r.baseline.drop("reasons"),
        "baseline_reasons": lambda r: r.baseline.select("account_id", F.explode("reasons").alias("reason")),
        "baseline_sweep": lambda r: baseline.baseline_sweep(baseline.baseline_inputs(r.activity)),
        # evaluation
        "ring_match": lambda r: e(r).all_predictions,
        "evaluation_cases": lambda r: e(r).cases("evr_1", "held-out").drop("id", "evaluation_run_id"),
        "confusion": lambda r: evaluation.flat_rates(e(r).comparison()),
        "hard_negatives": lambda r: evaluation.hard_negatives(e(r).all_predictions),
        "recovery": lambda r: evaluation.coordination_recovery(e(r).all_predictions, e(r).baseline_flags, "template"),
        "threshold_sweep": lambda r: evaluation.flat_rates(evaluation.threshold_sweep(e(r).all_predictions, LOW)),
        "selected_threshold": lambda r: e(r).selected_threshold(),
        "slices_by_template": lambda r: evaluation.flat_rates(evaluation.slices(e(r).all_predictions, "template")),
        "slices_by_difficulty": lambda r: evaluation.flat_rates(evaluation.slices(e(r).all_predictions, "difficulty")),
        "overlap_distribution": lambda r: evaluation.overlap_distribution(e(r).all_predictions),
        "split_purity": lambda r: evaluation.split_purity(e(r).rings, e(r).members, r.activity.accounts),
        "split_counts": lambda r: evaluation.split_counts(r.activity.accounts),
        "evaluation_list": lambda r: reports.evaluation_list(r.evaluation_runs).drop("ring_metrics"),
        # reports
        "cluster_list": lambda r: reports.cluster_list(d(r).clusters, review_only=True, offset=10).select("cluster_id", "risk_score", "verdict"),
        "cluster_total": lambda r: reports.cluster_total(d(r).clusters, review_only=True),
        "clusters_by_size": lambda r: reports.clusters_by_size(d(r).clusters).select("cluster_id", "entity_count"),
        "top_signals": lambda r: reports.top_signals(d(r).clusters).select("cluster_id", F.explode("signals").alias("s")).select("cluster_id", "s.signal", "s.points"),
        "subgraph_edges": lambda r: r.subgraph_edges.select("cluster", "src", "dst", "type", "derived", "weight", "via"),
        "subgraph_nodes": lambda r: r.subgraph_nodes,
        "visible_subgraph": lambda r: reports.visible(r.subgraph_nodes, r.subgraph_edges, ("ADDRESS",))[1].select("cluster", "src", "dst", "type", "derived"),
        "node_degree": lambda r: reports.node_degree(r.subgraph_edges),
        "dossier_table": lambda r: dossier.dossier_table(d(r).clusters, r.subgraph_nodes, r.subgraph_edges, r.now).drop("generated_at", "notice"),
        "dossier_json": lambda r: dossier.dossier_json(
            d(r).clusters, d(r).cluster_members.join(d(r).cluster_ids.select("cluster", "cluster_id"), "cluster_id").drop("cluster_id"),
            *r.named_subgraph, r.now,
        ),
        "cluster_detail": lambda r: reports.cluster_detail(
            d(r).clusters, d(r).members.join(d(r).cluster_ids, "cluster").select("cluster_id", "entity_id"), r.activity.accounts, d(r).entities
        ).select("cluster_id", "entity_id", "account_id", "customer_key", "tenure_days", "risk_score", "verdict", "event_count"),
        "timeline": lambda r: reports.timeline(d(r).cluster_accounts, r.activity).drop("detail"),
        "overview": lambda r: reports.overview(
            d(r).entity_types, d(r).edges.select("derived").union(d(r).observed_classes), r.activity, d(r).orphans,
            d(r).clusters, r.reviewed, r.runs, r.evaluation_runs,
        ),
        "run_summary": lambda r: r.runs.select("id", "method", "entity_count", "edge_count", "derived_edge_count", "cluster_count", "created_at"),
        "latest_run": lambda r: reports.latest(r.runs.select("id", "method", "cluster_count", "created_at"), "created_at"),
        "header_counts": lambda r: reports.header_counts(d(r).clusters, r.reviewed),
        "failure_summary": lambda r: reports.failure_summary(r.log, d(r).clusters, d(r).findings).select("category", "events"),
        "recent_failures": lambda r: audit.recent_failures(r.log).select("sequence", "action", "object_id"),
        # reviews and audit
        "open_reviews": lambda r: r.opened.select("id", "cluster_id", "reason_code", "machine_verdict", "machine_risk", "machine_confidence"),
        "rejected_decisions": lambda r: reviews.rejected(r.judged),
        "reviewed": lambda r: r.reviewed.select("id", "cluster_id", "status", "reviewer_verdict", "benign_explanation", "machine_risk"),
        "list_reviews": lambda r: reviews.list_reviews(r.reviewed, d(r).clusters, "CONFIRMED").select("id", "cluster_id", "status"),
        "reviewer_agreement": lambda r: reviews.reviewer_agreement(r.reviewed),
        "dismissal_reasons": lambda r: reviews.dismissal_reasons(r.reviewed),
        "audit_log": lambda r: r.log.select("sequence", "id", "timestamp", "action", "object_id", "cluster_id", "result", "severity"),
        "audit_query": lambda r: audit.query_audit(
            r.log, action="HUMAN_REVIEW_COMPLETED", severity="notice", since=datetime(2002, 1, 1), offset=5
        ).select("sequence", "action", "object_id"),
        "cluster_history": lambda r: audit.cluster_history(r.log).select("cluster_id", "sequence", "action"),
        # stored tables
        "dossier_parsed": _parsed,
        "upserted_clusters": _written_twice,
        "inserted_accounts": _inserted,
        "edge_halves": _edge_halves,
        # text
        "injection_scan": lambda r: screening.injection_scan(
            r.activity.returns.select("account_id", "id", F.col("reason").alias("text")), "text", "account_id", "id"
        ),
        "injection_rule_counts": lambda r: screening.rule_counts(screening.injection_scan(r.corpus(), "text")),
        "metadata_scan": _metadata,
        "evasion_check": _evasion,
        "pii_mask": _masked,
        "personal_columns": lambda r: screening.personal_columns(r.table("documents"), "text", "source"),
        "personal_data": _personal,
    }
    return {name: _registered(make) for name, make in q.items()}


def _registered(make: Callable[[Run], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, path: flat(make(run_of(spark, path)))
