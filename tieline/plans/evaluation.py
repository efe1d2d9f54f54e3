"""Evaluation of a detection run on one split of labelled groups."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieline.config import BaselineThresholds
from tieline.functions.ids import digest_id
from tieline.functions.lineage import keep
from tieline.operators import baseline, evaluation
from tieline.plans.detection import Detection


class Evaluation:
    """Detection covers the whole graph and is computed once; a split only says which groups count.

    ``rings`` needs id, label, template, difficulty and split; ``members`` is
    (ring_id, account_id); ``truth`` is (account_id, label).
    """

    def __init__(self, detection: Detection, rings: DataFrame, members: DataFrame, truth: DataFrame,
                 thresholds: BaselineThresholds = BaselineThresholds()):
        self.detection, self.config = detection, detection.config
        self.rings, self.members, self.truth, self.thresholds = rings, members, truth, thresholds

    @cached_property
    def all_predictions(self) -> DataFrame:
        d = self.detection
        return keep(
            evaluation.match_rings(self.rings, self.members, d.cluster_accounts, d.clusters, self.config)
        )

    def predictions(self, split: str | None = None) -> DataFrame:
        found = self.all_predictions
        return found if split is None else found.where(F.col("split") == split)

    @cached_property
    def baseline(self) -> DataFrame:
        inputs = baseline.baseline_inputs(self.detection.activity, self.thresholds)
        return baseline.account_baseline(inputs, self.thresholds)

    @cached_property
    def baseline_flags(self) -> DataFrame:
        return keep(evaluation.baseline_ring_flags(self.members, self.baseline))

    def accounts(self, split: str | None = None, include_unlabelled: bool = True) -> DataFrame:
        d = self.detection
        found = evaluation.account_predictions(
            d.activity.accounts, self.truth, d.cluster_accounts, d.clusters, self.config, include_unlabelled
        )
        return found if split is None else found.where(F.col("split") == split)

    def selected_threshold(self, split: str = "dev") -> DataFrame:
        return evaluation.select_threshold(
            evaluation.threshold_sweep(self.predictions(split), self.config), self.config
        )

    def comparison(self, split: str | None = None) -> DataFrame:
        """Graph and baseline on groups, and the graph on accounts, one row each."""
        graph = self.predictions(split)
        views = {
            "graph": graph,
            "baseline": evaluation.baseline_predictions(graph, self.baseline_flags),
            "graph-accounts": self.accounts(split),
        }
        rows = None
        for name, predictions in views.items():
            row = evaluation.performance(predictions).select(F.lit(name).alias("view"), "*")
            rows = row if rows is None else rows.unionByName(row)
        return rows

    def cases(self, run_id: str, split: str | None = None) -> DataFrame:
        """One row per group for the case table."""
        return self.predictions(split).select(
            digest_id("evc", F.lit(run_id), F.col("ring_id")).alias("id"),
            F.lit(run_id).alias("evaluation_run_id"),
            "ring_id", "cluster_id", "template", "difficulty", "actual_label", "predicted_risk",
            F.col("flagged").alias("predicted_flagged"), "abstained",
            evaluation.classify().alias("classification"), "member_overlap",
        )

    def run_row(self, run_id: str, split: str, at: Column) -> DataFrame:
        """One row for the evaluation table."""
        return (
            evaluation.performance(self.predictions(split))
            .select(F.struct("*").alias("ring_metrics"), F.col("total").alias("ring_count"))
            .select(
                F.lit(run_id).alias("id"), F.lit(split).alias("split"), F.lit("graph").alias("detector"),
                F.lit(self.detection.method).alias("method"),
                F.lit(self.config.risk_threshold).alias("risk_threshold"),
                "ring_count", "ring_metrics", at.alias("started_at"), at.alias("finished_at"),
            )
        )
