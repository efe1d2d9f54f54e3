"""A detection run from the activity tables to scored clusters."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieline.config import DetectConfig
from tieline.functions.fixed import half_up, scaled, units
from tieline.functions.ids import digest_id
from tieline.functions.lineage import cut, keep
from tieline.operators import aggregate, components, incidence, links, scoring, screening
from tieline.operators.features import extract_features
from tieline.operators.louvain import louvain_runs, rotated_starts
from tieline.operators.overlap import stability
from tieline.sources.tables import Activity

SHARED_ENTITY, LOUVAIN = "shared-entity", "louvain"


class Detection:
    """The frames of one run, each built once when first asked for.

    ``text_findings`` counts return reasons addressed to the analysis per
    cluster and routes such clusters to review.
    """

    def __init__(
        self,
        activity: Activity,
        config: DetectConfig = DetectConfig(),
        method: str = SHARED_ENTITY,
        text_findings: bool = True,
    ):
        if method not in (SHARED_ENTITY, LOUVAIN):
            raise ValueError(f"unknown method {method!r}")
        self.activity, self.config, self.method = activity, config, method
        self.text_findings = text_findings

    # --- graph ---------------------------------------------------------------
    @cached_property
    def incidence(self) -> DataFrame:
        return incidence.incidence(self.activity.orders, self.activity.accounts)

    @cached_property
    def fan_out(self) -> DataFrame:
        return cut(links.fan_out(self.incidence))

    @cached_property
    def shared_nodes(self) -> DataFrame:
        """Marks of the infrastructure that may not be one account's own."""
        return cut(incidence.shared_nodes(self.activity.orders, self.activity.accounts))

    @cached_property
    def shared_incidence(self) -> DataFrame:
        """Incidences without the infrastructure of one account; written once."""
        return cut(incidence.incidence(self.activity.orders, self.activity.accounts, shared=self.shared_nodes))

    @cached_property
    def shared_fan_out(self) -> DataFrame:
        """``fan_out`` without the infrastructure of one account."""
        return cut(links.fan_out(self.shared_incidence))

    @cached_property
    def guarded(self) -> DataFrame:
        # a node of one account links no one
        return keep(links.guarded(self.shared_incidence, self.config, self.shared_fan_out))

    @cached_property
    def edges(self) -> DataFrame:
        """Inferred edges, written once: they are read by every later step."""
        return cut(links.inferred_edges(self.guarded))

    @cached_property
    def observed(self) -> DataFrame:
        return incidence.observed_edges(self.activity.accounts, self.activity.orders)

    @cached_property
    def observed_inside(self) -> DataFrame:
        """Observed edges from members, with their cluster."""
        return incidence.member_edges(self.members, self.activity.accounts, self.activity.orders)

    @cached_property
    def entities(self) -> DataFrame:
        return incidence.entities(self.activity.accounts, self.activity.orders)

    @cached_property
    def shared_entities(self) -> DataFrame:
        """Accounts, customers and shared infrastructure."""
        return incidence.entities(self.activity.accounts, self.activity.orders, self.shared_nodes)

    @cached_property
    def all_entities(self) -> DataFrame:
        """``entities`` in no place; only what is shared moves."""
        return self.shared_entities.unionByName(incidence.own_entities(self.activity.orders, self.shared_nodes))

    @cached_property
    def entity_types(self) -> DataFrame:
        """The type of every entity, for those that only count them; a few bytes a file."""
        return cut(self.all_entities.select("type"))

    @cached_property
    def observed_classes(self) -> DataFrame:
        """``derived`` of every observed edge, for those that only count them."""
        return cut(self.observed.select("derived"))

    @cached_property
    def orphans(self) -> DataFrame:
        return links.orphans(self.activity.accounts, self.edges)

    # --- clusters ------------------------------------------------------------
    @cached_property
    def members(self) -> DataFrame:
        """(cluster, entity_id)"""
        if self.method == LOUVAIN:
            return self.louvain_runs.where("run = 0").select("cluster", "entity_id")
        spanning = links.spanning_links(self.guarded, self.config)
        return cut(components.clusters_of(components.connected_components(spanning), self.config))

    @cached_property
    def inside(self) -> DataFrame:
        return keep(components.intra_edges(self.edges, self.members))

    @cached_property
    def cluster_ids(self) -> DataFrame:
        return keep(components.cluster_ids(self.members, self.method))

    @cached_property
    def density(self) -> DataFrame:
        return components.density(self.inside, self.members)

    @cached_property
    def bridging(self) -> DataFrame:
        return components.bridging(self.inside, None if self.method == LOUVAIN else self.config)

    @cached_property
    def join_paths(self) -> DataFrame:
        if self.method == LOUVAIN:
            return components.community_join_paths(self.inside, self.members)
        return components.join_paths(self.inside, self.members, self.config)

    @cached_property
    def rotations(self) -> list[str]:
        """Nodes that the perturbed runs start from."""
        return rotated_starts(self.activity.accounts, self.config.stability_runs) if self.config.stability_runs else []

    @cached_property
    def louvain_runs(self) -> DataFrame:
        """Run 0 in id order and the perturbed runs, over one contraction and one adjacency."""
        return louvain_runs(self.edges, self.config, [None, *self.rotations])

    @cached_property
    def stability(self) -> DataFrame | None:
        """Only measured for Louvain; components do not depend on node order."""
        if self.method != LOUVAIN or not self.rotations:
            return None
        return stability(self.members, self.louvain_runs.where("run > 0"), len(self.rotations))

    @cached_property
    def convergence(self) -> DataFrame:
        """(cluster, converged) of Louvain clusters."""
        return self.louvain_runs.where("run = 0").groupBy("cluster").agg(F.every("converged").alias("converged"))

    # --- behaviour -----------------------------------------------------------
    @cached_property
    def rollup(self) -> DataFrame:
        return keep(incidence.account_activity(self.activity))

    @cached_property
    def owned(self) -> DataFrame:
        """Members that are accounts, with their account id."""
        return keep(aggregate.cluster_accounts(self.members, self.activity.accounts))

    @cached_property
    def aggregates(self) -> DataFrame:
        return aggregate.aggregate_clusters(
            self.owned, self.rollup, self.activity.orders, self.activity.returns, self.config
        )

    @cached_property
    def findings(self) -> DataFrame:
        """(cluster, injection_findings) over whole return reasons."""
        reasons = self.activity.returns.select("account_id", "id", F.col("reason").alias("text"))
        hits = screening.injection_scan(reasons, "text", "account_id", "id")
        return cut(
            hits.join(self.owned.select("account_id", "cluster"), "account_id")
            .groupBy("cluster")
            .agg(F.count("*").alias("injection_findings"))
        )

    @cached_property
    def features(self) -> DataFrame:
        density = self.density.select("cluster", "density")
        return cut(extract_features(self.aggregates.join(density, "cluster")))

    @cached_property
    def clusters(self) -> DataFrame:
        """One row per cluster with everything the scorer says, unordered."""
        inputs = self.features
        if self.stability is not None:
            inputs = inputs.join(self.stability, "cluster", "left")
        if self.text_findings:
            inputs = inputs.join(self.findings, "cluster", "left").withColumn(
                "injection_findings", F.coalesce("injection_findings", F.lit(0))
            )
        ids = self.cluster_ids.select("cluster", "cluster_id", F.col("size").alias("entity_count"))
        scored = scoring.score(inputs.join(ids, "cluster"), self.config)
        return cut(scored.withColumn("method", F.lit(self.method)))

    @cached_property
    def cluster_accounts(self) -> DataFrame:
        """(cluster_id, account_id) of every scored cluster."""
        ids = self.cluster_ids.select("cluster", "cluster_id")
        return self.owned.join(ids, "cluster").select("cluster_id", "entity_id", "account_id")

    @cached_property
    def cluster_members(self) -> DataFrame:
        """Membership rows with each member's share of the score and how it joined."""
        scored = self.clusters.select("cluster", "cluster_id", "entity_count", "risk_score")
        return member_rows(self.join_paths, scored)


def member_rows(paths: DataFrame, scored: DataFrame) -> DataFrame:
    share = scaled(half_up(units(F.col("risk_score"), 2), F.greatest("entity_count", F.lit(1)) * 100, 4), 4)
    return paths.join(scored, "cluster").select(
        digest_id("mem", F.col("cluster_id"), F.col("entity_id")).alias("id"),
        "cluster_id", "entity_id", F.lit("ACCOUNT").alias("entity_type"),
        share.alias("contribution"), "joined_via",
    )


def run_outcome(clusters: DataFrame) -> DataFrame:
    """Clusters, likely, insufficient and capped counts of a run."""
    return clusters.agg(
        F.count("*").alias("clusters"),
        F.count_if(F.col("verdict") == "COORDINATION_LIKELY").alias("coordination_likely"),
        F.count_if(F.col("verdict") == "INSUFFICIENT_DATA").alias("insufficient"),
        F.count_if("capped_by_guardrail").alias("capped"),
    )


def top_breakdown(clusters: DataFrame, count: int = 10) -> DataFrame:
    """The riskiest clusters with every signal of their score, strongest first."""
    best = clusters.orderBy(F.desc("risk_score"), "cluster_id").limit(count)
    return best.select("cluster_id", "risk_score", "verdict", F.posexplode("signals").alias("position", "s")).select(
        "cluster_id", "risk_score", "verdict", "position", "s.signal", "s.points", "s.max_points"
    )


def ranked(clusters: DataFrame) -> DataFrame:
    """Clusters by risk, highest first."""
    return clusters.orderBy(F.desc("risk_score"), "cluster_id")
