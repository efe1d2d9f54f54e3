from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.scenarios import scenario
from tieline.operators import aggregate, baseline, incidence, scoring
from tieline.operators.features import extract_features
from tieline.plans.detection import Detection

EXPECTED = {
    "clear-ring": (97.52, "COORDINATION_LIKELY", 8),
    "borderline-cluster": (63.52, "COORDINATION_POSSIBLE", 0),
    "legitimate-household": (54.32, "COORDINATION_POSSIBLE", 0),
    "sparse-data": (28.0, "INSUFFICIENT_DATA", 0),
    "prompt-injection": (97.52, "COORDINATION_LIKELY", 8),
}


@pytest.mark.parametrize("name", EXPECTED)
def test_published_risk_and_verdict(spark, name):
    risk, verdict, flagged = EXPECTED[name]
    activity = scenario(spark, name)
    (row,) = Detection(activity).clusters.collect()
    assert float(row.risk_score) == risk
    assert row.verdict == verdict
    assert row.risk_score == row.structural_points + row.behavioural_points
    assert sum(s.points for s in row.signals) == row.risk_score
    flags = baseline.account_baseline(baseline.baseline_inputs(activity)).where("flagged").count()
    assert flags == flagged


def test_isolated_account_is_no_cluster_but_an_account_signal(spark):
    activity = scenario(spark, "isolated-high-returner")
    assert Detection(activity).members.count() == 0
    (flag,) = baseline.account_baseline(baseline.baseline_inputs(activity)).collect()
    assert flag.flagged
    # scored by itself, as a cluster of one, it abstains
    owned = activity.accounts.select(
        F.lit("c").alias("cluster"), "entity_id", F.col("id").alias("account_id"), "tenure_days"
    )
    measures = aggregate.aggregate_clusters(
        owned, incidence.account_activity(activity), activity.orders, activity.returns
    ).withColumn("density", F.lit(0).cast("decimal(9,4)"))
    (row,) = scoring.score(extract_features(measures)).collect()
    assert float(row.risk_score) == 60.84
    assert row.verdict == "INSUFFICIENT_DATA"


def test_household_structure_and_behaviour(spark):
    (row,) = Detection(scenario(spark, "legitimate-household")).clusters.collect()
    assert (float(row.structural_points), float(row.behavioural_points)) == (30.67, 23.65)
    assert len(row.counter_signals) == 4
    assert row.review_reason == "LEGITIMATE_EXPLANATION_PLAUSIBLE"


def test_injected_text_reroutes_and_changes_nothing_else(spark):
    (clean,) = Detection(scenario(spark, "clear-ring")).clusters.collect()
    (hostile,) = Detection(scenario(spark, "prompt-injection")).clusters.collect()
    assert hostile.injection_findings > 0 and clean.injection_findings == 0
    assert hostile.review_reason == "UNTRUSTED_CONTENT_FLAGGED" and hostile.requires_review
    assert (hostile.risk_score, hostile.confidence, hostile.verdict) == (
        clean.risk_score, clean.confidence, clean.verdict,
    )


def test_explanation_passes_its_own_gate(spark):
    clusters = Detection(scenario(spark, "clear-ring")).clusters
    (gated,) = scoring.validate_explanations(scoring.explanations(clusters)).collect()
    assert gated.valid and gated.signals
    assert "no account has been touched" in " ".join(gated.caveats)
    lines = scoring.explain_score(clusters).first().lines
    assert any("Sent back" in line for line in lines)
    assert "risk in all:" in lines[-1] and lines[-1].startswith("  97.5")
    assert "+ 20.0  Return rate" in lines[0]


def test_run_is_repeatable(spark):
    activity = scenario(spark, "clear-ring")
    first, second = (Detection(activity).clusters.select("cluster_id", "risk_score").collect() for _ in range(2))
    assert first == second
