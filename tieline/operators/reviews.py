"""The review queue as batch operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieline.config import DetectConfig
from tieline.functions.fixed import ratio
from tieline.functions.ids import digest_id
from tieline.vocabulary import REVIEW_DECISIONS

REVIEWS = (
    "id string, cluster_id string, reason_code string, reason_detail string, "
    "machine_verdict string, machine_risk decimal(9,2), machine_confidence decimal(9,4), "
    "status string, reviewed_by string, reviewed_at timestamp, reviewer_note string, "
    "reviewer_verdict string, benign_explanation string, created_at timestamp"
)


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def open_reviews(clusters: DataFrame, existing: DataFrame, now: Column) -> DataFrame:
    """New pending reviews for routed clusters that have none pending.

    What the machine said is copied, so a later run cannot change it.
    """
    pending = existing.where(F.col("status") == "PENDING").select("cluster_id")
    return clusters.where("requires_review").join(pending, "cluster_id", "left_anti").select(
        digest_id("rev", F.col("cluster_id"), now.cast("string")).alias("id"),
        "cluster_id",
        F.coalesce("review_reason", F.lit("HIGH_RISK_HIGH_CONFIDENCE")).alias("reason_code"),
        F.coalesce("review_detail", F.lit("Routed for human review.")).alias("reason_detail"),
        F.col("verdict").alias("machine_verdict"),
        F.col("risk_score").alias("machine_risk"),
        F.col("confidence").alias("machine_confidence"),
        F.lit("PENDING").alias("status"),
        _null("string").alias("reviewed_by"),
        _null("timestamp").alias("reviewed_at"),
        _null("string").alias("reviewer_note"),
        _null("string").alias("reviewer_verdict"),
        _null("string").alias("benign_explanation"),
        now.alias("created_at"),
    )


def judge_decisions(decisions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Each decision with the reason it is rejected for, or NULL.

    ``sequence`` orders a batch: once a decision closes a review, later ones for
    it are rejected as already decided.
    """
    known = reviews.select(F.col("id").alias("review_id"), "cluster_id", "status", "machine_verdict", "machine_risk")
    explained = F.trim(F.coalesce("benign_explanation", F.lit(""))) != ""
    first = (
        F.when(F.col("status").isNull(), "REVIEW_NOT_FOUND")
        .when(F.col("status") != "PENDING", "REVIEW_ALREADY_DECIDED")
        .when(~F.col("decision").isin(*REVIEW_DECISIONS), "VALIDATION_ERROR")
        .when((F.col("decision") == "DISMISSED") & ~explained, "VALIDATION_ERROR")
    )
    checked = decisions.join(known, "review_id", "left").withColumn("rejection", first)
    closing = (
        checked.where(F.col("rejection").isNull() & (F.col("decision") != "NEEDS_MORE_DATA"))
        .groupBy("review_id")
        .agg(F.min("sequence").alias("closed_at"))
    )
    return checked.join(closing, "review_id", "left").withColumn(
        "rejection",
        F.coalesce(
            "rejection", F.when(F.col("sequence") > F.col("closed_at"), F.lit("REVIEW_ALREADY_DECIDED"))
        ),
    ).drop("closed_at").withColumn(
        "agreed_with_machine", F.col("reviewer_verdict") == F.col("machine_verdict")
    )


def apply_decisions(judged: DataFrame, reviews: DataFrame, now: Column) -> DataFrame:
    """The review table after the accepted decisions; NEEDS_MORE_DATA leaves a review pending."""
    last = (
        judged.where(F.col("rejection").isNull())
        .groupBy(F.col("review_id").alias("id"))
        .agg(
            F.max_by(
                F.struct("decision", "reviewer_id", "note", "reviewer_verdict", "benign_explanation"), "sequence"
            ).alias("new")
        )
    )
    decided = F.col("new").isNotNull()
    changed = {
        "status": F.when(F.col("new.decision") == "NEEDS_MORE_DATA", "PENDING").otherwise(F.col("new.decision")),
        "reviewed_by": F.col("new.reviewer_id"),
        "reviewed_at": now,
        "reviewer_note": F.col("new.note"),
        "reviewer_verdict": F.col("new.reviewer_verdict"),
        "benign_explanation": F.col("new.benign_explanation"),
    }
    return reviews.alias("r").join(last, "id", "left").select(
        *[
            (F.when(decided, changed[c]).otherwise(F.col(f"r.{c}")) if c in changed else F.col(f"r.{c}" if c != "id" else "id")).alias(c)
            for c in reviews.columns
        ]
    )


def rejected(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("rejection").isNotNull()).select(
        "review_id", "sequence", "decision", F.col("rejection").alias("reason_code")
    )


def list_reviews(
    reviews: DataFrame, clusters: DataFrame, status: str | None = None, limit: int | None = None,
    config: DetectConfig = DetectConfig(),
) -> DataFrame:
    """Reviews beside their cluster as it is now, newest first."""
    chosen = reviews if status is None else reviews.where(F.col("status") == status)
    now = clusters.select("cluster_id", "account_count", "risk_score", "confidence", "verdict")
    return (
        chosen.join(now, "cluster_id")
        .orderBy(F.desc("created_at"), "id")
        .limit(min(limit or config.list_default, config.list_ceiling))
    )


def reviewer_agreement(reviews: DataFrame) -> DataFrame:
    """Share of decided reviews whose reviewer agreed with the machine."""
    decided = (F.col("status") != "PENDING") & F.col("reviewer_verdict").isNotNull()
    agreed = decided & (F.col("reviewer_verdict") == F.col("machine_verdict"))
    return reviews.agg(F.count_if(decided).alias("decided"), F.count_if(agreed).alias("agreed")).withColumn(
        "rate", ratio(F.col("agreed"), F.col("decided"))
    )


def dismissal_reasons(reviews: DataFrame) -> DataFrame:
    """Accepted ordinary explanations, most frequent first."""
    text = F.coalesce(F.nullif(F.trim("benign_explanation"), F.lit("")), F.lit("(none recorded)"))
    return (
        reviews.where(F.col("status") == "DISMISSED")
        .groupBy(text.alias("explanation"))
        .agg(F.count("*").alias("reviews"))
        .orderBy(F.desc("reviews"), "explanation")
    )
