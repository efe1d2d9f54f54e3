"""The append-only audit log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieline.functions.ids import digest_id
from tieline.functions.ranking import global_rank
from tieline.operators.reviews import _null

COLUMNS = (
    "timestamp", "actor_type", "actor_id", "action", "object_type", "object_id", "cluster_id",
    "correlation_id", "previous_state", "new_state", "metadata", "result", "severity",
)
_LIMIT, _CEILING, _RECENT = 100, 500, 50


def event(
    df: DataFrame, *, at: Column, actor_type: str, actor_id: Column, action: str, object_type: str,
    object_id: Column, correlation_id: str, result: str, severity: Column | str,
    cluster_id: Column | None = None, previous_state: Column | None = None,
    new_state: Column | None = None, metadata: Column | None = None,
) -> DataFrame:
    """One event per row of ``df``; states and metadata are JSON text."""
    text = lambda value: _null("string") if value is None else F.to_json(value)
    return df.select(
        at.alias("timestamp"),
        F.lit(actor_type).alias("actor_type"),
        actor_id.alias("actor_id"),
        F.lit(action).alias("action"),
        F.lit(object_type).alias("object_type"),
        object_id.alias("object_id"),
        (_null("string") if cluster_id is None else cluster_id).alias("cluster_id"),
        F.lit(correlation_id).alias("correlation_id"),
        text(previous_state).alias("previous_state"),
        text(new_state).alias("new_state"),
        F.coalesce(text(metadata), F.lit("{}")).alias("metadata"),
        F.lit(result).alias("result"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
    )


def sequenced(events: DataFrame, after: int = 0) -> DataFrame:
    """Ids and consecutive sequence numbers in time order, continuing after ``after``."""
    named = events.withColumn(
        "id", digest_id("aud", F.col("action"), F.col("object_id"), F.col("correlation_id"), F.col("timestamp").cast("string"))
    )
    return global_rank(named, "timestamp", "id", name="_rank").select(
        (F.col("_rank") + 1 + after).alias("sequence"), "id", *COLUMNS
    )


def guardrail_events(clusters: DataFrame, at: Column, correlation_id: str) -> DataFrame:
    """One event per cluster the structural guardrail held back."""
    return event(
        clusters.where("capped_by_guardrail"), at=at, actor_type="SYSTEM", actor_id=F.lit("structural-guardrail"),
        action="GUARDRAIL_APPLIED", object_type="cluster", object_id=F.col("cluster_id"),
        cluster_id=F.col("cluster_id"), correlation_id=correlation_id, result="BLOCKED", severity="notice",
        metadata=F.struct("structural_points", "behavioural_points", "account_count"),
    )


def review_requested_events(opened: DataFrame, at: Column, correlation_id: str) -> DataFrame:
    return event(
        opened, at=at, actor_type="SYSTEM", actor_id=F.lit("routing"), action="HUMAN_REVIEW_REQUESTED",
        object_type="human_review", object_id=F.col("id"), cluster_id=F.col("cluster_id"),
        correlation_id=correlation_id, result="SUCCESS", severity="notice",
        new_state=F.struct("reason_code", "machine_verdict"),
        metadata=F.struct(F.col("reason_detail").alias("detail")),
    )


def review_completed_events(judged: DataFrame, at: Column, correlation_id: str) -> DataFrame:
    accepted = judged.where(F.col("rejection").isNull())
    return event(
        accepted, at=at, actor_type="REVIEWER", actor_id=F.col("reviewer_id"), action="HUMAN_REVIEW_COMPLETED",
        object_type="human_review", object_id=F.col("review_id"), cluster_id=F.col("cluster_id"),
        correlation_id=correlation_id, result="SUCCESS",
        severity=F.when(~F.col("agreed_with_machine"), "notice").otherwise("info"),
        previous_state=F.struct("status", "machine_verdict", "machine_risk"),
        new_state=F.struct("decision", "reviewer_verdict"),
        metadata=F.struct("agreed_with_machine", "benign_explanation"),
    )


def rejected_explanation_events(gated: DataFrame, at: Column, correlation_id: str) -> DataFrame:
    """One event per explanation the gate refused."""
    return event(
        gated.where(~F.col("valid")), at=at, actor_type="EXPLAINER", actor_id=F.lit("external"),
        action="EXPLANATION_REJECTED", object_type="cluster", object_id=F.col("cluster_id"),
        cluster_id=F.col("cluster_id"), correlation_id=correlation_id, result="BLOCKED", severity="warning",
        metadata=F.struct("rejected_signals", "verdict_violation"),
    )


def run_events(outcome: DataFrame, run_id: str, method: str, at: Column, correlation_id: str) -> DataFrame:
    """Start and completion of a detection run from its outcome counts."""
    common = dict(
        at=at, actor_type="DETECTOR", actor_id=F.lit("tieline"), object_type="detection_run",
        object_id=F.lit(run_id), correlation_id=correlation_id, severity="info",
    )
    started = event(
        outcome, action="DETECTION_STARTED", result="INFO", metadata=F.struct(F.lit(method).alias("method")), **common
    )
    completed = event(
        outcome, action="DETECTION_COMPLETED", result="SUCCESS",
        metadata=F.struct(
            F.lit(method).alias("method"), "clusters", F.col("coordination_likely").alias("flagged"), "capped"
        ),
        **common,
    )
    return started.unionByName(completed)


def evaluation_events(measured: DataFrame, run_id: str, split: str, at: Column, correlation_id: str) -> DataFrame:
    """Start and completion of an evaluation from its one row of performance figures."""
    common = dict(
        at=at, actor_type="SYSTEM", actor_id=F.lit("tieline"), object_type="evaluation_run",
        object_id=F.lit(run_id), correlation_id=correlation_id, severity="info",
    )
    started = event(
        measured, action="EVALUATION_STARTED", result="INFO", metadata=F.struct(F.lit(split).alias("split")), **common
    )
    completed = event(
        measured, action="EVALUATION_COMPLETED", result="SUCCESS",
        metadata=F.struct(
            F.col("total").alias("rings"), F.col("precision.value").alias("precision"), F.col("recall.value").alias("recall")
        ),
        **common,
    )
    return started.unionByName(completed)


def query_audit(
    log: DataFrame, *, cluster_id: str | None = None, correlation_id: str | None = None, action: str | None = None,
    actor_id: str | None = None, severity: str | None = None, result: str | None = None,
    since: datetime | None = None, until: datetime | None = None, limit: int = _LIMIT, offset: int = 0,
) -> DataFrame:
    """Events matching all given conditions, newest first."""
    return (
        _matching(log, locals())
        .orderBy(F.desc("sequence"))
        .offset(offset)
        .limit(min(limit, _CEILING))
    )


def count_audit(log: DataFrame, **conditions) -> DataFrame:
    """How many events match, regardless of limit and offset."""
    return _matching(log, conditions).agg(F.count("*").alias("total"))


def _matching(log: DataFrame, wanted: dict) -> DataFrame:
    for column in ("cluster_id", "correlation_id", "action", "actor_id", "severity", "result"):
        if wanted.get(column) is not None:
            log = log.where(F.col(column) == wanted[column])
    if wanted.get("since") is not None:
        log = log.where(F.col("timestamp") >= F.lit(wanted["since"]))
    if wanted.get("until") is not None:
        log = log.where(F.col("timestamp") <= F.lit(wanted["until"]))
    return log


def cluster_history(log: DataFrame, cluster_id: str | None = None) -> DataFrame:
    """What happened to one cluster, or to each, oldest first."""
    if cluster_id is not None:
        return log.where(F.col("cluster_id") == cluster_id).orderBy("sequence")
    return log.where(F.col("cluster_id").isNotNull()).orderBy("cluster_id", "sequence")


def recent_failures(log: DataFrame) -> DataFrame:
    return log.where(F.col("result").isin("FAILURE", "BLOCKED")).orderBy(F.desc("sequence")).limit(_RECENT)
