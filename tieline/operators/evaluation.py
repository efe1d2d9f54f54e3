"""Evaluation against labelled groups, every rate with its denominator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieline.config import DetectConfig
from tieline.functions.fixed import half_up, ratio, scaled, units
from tieline.functions.skew import attach
from tieline.operators.overlap import overlaps

RATES = {
    "precision": ("tp", ("tp", "fp")),
    "recall": ("tp", ("tp", "fn")),
    "false_positive_rate": ("fp", ("fp", "tn")),
    "false_negative_rate": ("fn", ("fn", "tp")),
    "abstention_rate": ("abstained", ("total",)),
}


def rate(num: Column, den: Column) -> Column:
    """(value, numerator, denominator); the value is NULL, not 0, without a denominator."""
    return F.struct(
        ratio(num, den).alias("value"), num.alias("numerator"), den.alias("denominator")
    )


def ring_members(rings: DataFrame) -> DataFrame:
    """(ring_id, account_id) of groups stored with a member array."""
    return rings.select(F.col("id").alias("ring_id"), F.explode("member_account_ids").alias("account_id"))


def match_rings(
    rings: DataFrame,
    members: DataFrame,
    cluster_accounts: DataFrame,
    clusters: DataFrame,
    config: DetectConfig = DetectConfig(),
) -> DataFrame:
    """One prediction per labelled group from the cluster that overlaps it most.

    Ties go to the riskier cluster, then the smaller id.  Below the match floor
    the group counts as unmatched, but its best overlap stays visible.  A match
    the detector declined to interpret is an abstention.
    """
    found = overlaps(
        members.select(F.col("ring_id").alias("group"), F.col("account_id").alias("member")),
        cluster_accounts.select(F.col("cluster_id").alias("group"), F.col("account_id").alias("member")),
    )
    facts = clusters.select(F.col("cluster_id").alias("right_group"), "risk_score", "verdict")
    scored = attach(found, facts, "right_group", "left_group")
    best = scored.groupBy(F.col("left_group").alias("ring_id")).agg(
        F.min(
            F.struct(
                (-F.col("overlap")).alias("distance"), (-F.col("risk_score")).alias("safety"),
                F.col("right_group").alias("cluster_id"), "verdict",
            )
        ).alias("best")
    )
    overlap = F.coalesce(-F.col("best.distance"), F.lit(0)).cast("decimal(9,4)")
    matched = overlap >= F.lit(config.match_floor)
    risk = F.when(matched, -F.col("best.safety")).cast("decimal(9,2)")
    return rings.select(F.col("id").alias("ring_id"), "template", "difficulty", "label", "split").join(
        best, "ring_id", "left"
    ).select(
        "ring_id", "template", "difficulty", F.col("label").alias("actual_label"), "split",
        risk.alias("predicted_risk"),
        F.coalesce(risk >= config.risk_threshold, F.lit(False)).alias("flagged"),
        F.coalesce(matched & (F.col("best.verdict") == "INSUFFICIENT_DATA"), F.lit(False)).alias("abstained"),
        overlap.alias("member_overlap"),
        F.when(matched, F.col("best.cluster_id")).alias("cluster_id"),
    )


def classify() -> Column:
    """TP, FP, TN, FN or ABSTAINED; an abstention is neither right nor wrong."""
    suspicious = F.col("actual_label") == "SUSPICIOUS"
    return (
        F.when(F.col("abstained"), "ABSTAINED")
        .when(F.col("flagged") & suspicious, "TP")
        .when(F.col("flagged"), "FP")
        .when(~suspicious, "TN")
        .otherwise("FN")
    )


def performance(predictions: DataFrame, *by: str) -> DataFrame:
    """Confusion counts and rates, overall or per group."""
    outcome = F.col("outcome")
    counts = predictions.select(*by, classify().alias("outcome")).groupBy(*by).agg(
        F.count_if(outcome == "TP").alias("tp"),
        F.count_if(outcome == "FP").alias("fp"),
        F.count_if(outcome == "TN").alias("tn"),
        F.count_if(outcome == "FN").alias("fn"),
        F.count_if(outcome == "ABSTAINED").alias("abstained"),
        F.count("*").alias("total"),
    )
    rated = counts.withColumn("decided", F.col("total") - F.col("abstained")).withColumns(
        {name: rate(F.col(num), sum((F.col(d) for d in den[1:]), F.col(den[0]))) for name, (num, den) in RATES.items()}
    )
    p, r = units(F.col("precision.value")), units(F.col("recall.value"))
    return rated.withColumn("f1", scaled(half_up(p * r * 2, p + r), 4))


def flat_rates(measured: DataFrame) -> DataFrame:
    """Rate structs as ``name``, ``name_num`` and ``name_den`` columns."""
    out = []
    for column in measured.columns:
        if column in RATES:
            out += [
                F.col(f"{column}.value").alias(column),
                F.col(f"{column}.numerator").alias(f"{column}_num"),
                F.col(f"{column}.denominator").alias(f"{column}_den"),
            ]
        else:
            out.append(F.col(column))
    return measured.select(*out)


def hard_negatives(predictions: DataFrame) -> DataFrame:
    """Ordinary groups per template: false positives and mean risk, worst first."""
    return (
        predictions.where(F.col("actual_label") == "BENIGN")
        .groupBy("template")
        .agg(
            F.count("*").alias("groups"),
            F.count_if(F.col("flagged") & ~F.col("abstained")).alias("false_positives"),
            F.count("predicted_risk").alias("_rated"),
            F.sum("predicted_risk").alias("_risk"),
        )
        .select(
            "template", "groups", "false_positives",
            ratio(F.col("false_positives"), F.col("groups")).alias("false_positive_rate"),
            scaled(half_up(units(F.col("_risk"), 2), F.col("_rated")), 2).alias("mean_risk"),
        )
        .orderBy(F.desc("false_positive_rate"), "template")
    )


def slices(predictions: DataFrame, key: str) -> DataFrame:
    """Performance per value of ``key``, largest group first."""
    return performance(predictions, key).orderBy(F.desc("total"), key)


def threshold_sweep(predictions: DataFrame, config: DetectConfig = DetectConfig()) -> DataFrame:
    """Cost of every candidate threshold; flags are derived afresh, abstentions stay."""
    candidates = F.array(*[F.lit(t) for t in config.threshold_candidates])
    rescored = predictions.withColumn("threshold", F.explode(candidates)).withColumn(
        "flagged", F.coalesce(F.col("predicted_risk") >= F.col("threshold"), F.lit(False))
    )
    cost = (
        F.col("fp") * config.cost_false_positive
        + F.col("fn") * config.cost_false_negative
        + F.col("abstained") * config.cost_abstention
    )
    return (
        performance(rescored, "threshold")
        .withColumn("total_cost", cost)
        .withColumn("cost_per_group", ratio(F.col("total_cost"), F.col("total")))
        .withColumn("household_false_positives", F.col("fp"))
        .orderBy("total_cost", "threshold")
    )


def select_threshold(sweep: DataFrame, config: DetectConfig = DetectConfig()) -> DataFrame:
    """The cheapest candidate, the lowest on a tie; the configured one without any groups."""
    return sweep.agg(
        F.min_by("threshold", F.struct("total_cost", "threshold")).alias("threshold"),
        F.min("total_cost").alias("cost"),
        F.count("*").alias("candidates"),
        F.max("total").alias("groups"),
    ).select(
        F.coalesce("threshold", F.lit(config.risk_threshold)).alias("threshold"),
        F.coalesce("cost", F.lit(0)).alias("cost_at_selection"),
        F.col("candidates").alias("candidates_evaluated"),
        F.coalesce("groups", F.lit(0)).alias("groups"),
    )


def account_predictions(
    accounts: DataFrame,
    truth: DataFrame,
    cluster_accounts: DataFrame,
    clusters: DataFrame,
    config: DetectConfig = DetectConfig(),
    include_unlabelled: bool = True,
) -> DataFrame:
    """Accounts named by a flagged cluster against their label.

    Unlabelled accounts count as ordinary ones unless left out.
    """
    named = (
        clusters.where((F.col("risk_score") >= config.risk_threshold) & (F.col("verdict") != "INSUFFICIENT_DATA"))
        .select("cluster_id")
        .join(cluster_accounts, "cluster_id")
        .select("account_id", F.lit(True).alias("flagged"))
        .distinct()
    )
    labelled = accounts.select(F.col("id").alias("account_id"), "split").join(
        truth.select("account_id", "label"), "account_id", "left"
    )
    if not include_unlabelled:
        labelled = labelled.where(F.col("label").isNotNull())
    return labelled.join(named, "account_id", "left").select(
        "account_id", "split",
        F.coalesce("label", F.lit("BENIGN")).alias("actual_label"),
        F.coalesce("flagged", F.lit(False)).alias("flagged"),
        F.lit(False).alias("abstained"),
    )


def baseline_ring_flags(members: DataFrame, baseline: DataFrame) -> DataFrame:
    """Whether the per-account baseline flags any member of each group."""
    return (
        members.join(baseline.select("account_id", "flagged"), "account_id", "left")
        .groupBy("ring_id")
        .agg(F.coalesce(F.bool_or("flagged"), F.lit(False)).alias("baseline_flagged"))
    )


def baseline_predictions(predictions: DataFrame, flags: DataFrame) -> DataFrame:
    """The same groups as the baseline sees them."""
    return predictions.drop("flagged", "abstained", "predicted_risk").join(flags, "ring_id", "left").select(
        "ring_id", "template", "difficulty", "actual_label", "split",
        F.coalesce("baseline_flagged", F.lit(False)).alias("flagged"),
        F.lit(False).alias("abstained"),
    )


def coordination_recovery(predictions: DataFrame, flags: DataFrame, *by: str) -> DataFrame:
    """Suspicious groups the baseline missed and the graph found, and the reverse."""
    b, g = F.col("baseline_flagged"), F.col("flagged")
    return (
        predictions.where(F.col("actual_label") == "SUSPICIOUS")
        .join(flags, "ring_id", "left")
        .withColumn("baseline_flagged", F.coalesce("baseline_flagged", F.lit(False)))
        .groupBy(*by)
        .agg(
            F.count("*").alias("suspicious_rings"),
            F.count_if(b).alias("baseline_detected"),
            F.count_if(~b).alias("baseline_missed"),
            F.count_if(~b & g).alias("graph_recovered"),
            F.count_if(b & ~g).alias("graph_missed_baseline_caught"),
        )
        .withColumn("recovery_rate", ratio(F.col("graph_recovered"), F.col("baseline_missed")))
    )


def overlap_distribution(predictions: DataFrame, config: DetectConfig = DetectConfig()) -> DataFrame:
    """How clean the matches were: mean and least non-zero overlap, and how many fall short."""
    some = F.when(F.col("member_overlap") > 0, F.col("member_overlap"))
    return predictions.agg(
        F.sum(some).alias("_sum"),
        F.count(some).alias("_n"),
        F.min(some).alias("min_overlap"),
        F.count_if(F.col("member_overlap") < F.lit(config.match_floor)).alias("below_floor"),
    ).select(
        scaled(half_up(units(F.col("_sum")), F.col("_n")), 4).alias("mean_overlap"), "min_overlap", "below_floor"
    )


def split_purity(rings: DataFrame, members: DataFrame, accounts: DataFrame) -> DataFrame:
    """Splits among each group's accounts, and whether all agree with the group's own."""
    split_of = accounts.select(F.col("id").alias("account_id"), F.col("split").alias("account_split"))
    return (
        members.join(split_of, "account_id")
        .join(rings.select(F.col("id").alias("ring_id"), "split"), "ring_id")
        .groupBy("ring_id", "split")
        .agg(
            F.count_distinct("account_split").alias("splits"),
            F.count_if(F.col("account_split") != F.col("split")).alias("strays"),
        )
        .select("ring_id", "split", "splits", (F.col("strays") == 0).alias("pure"))
    )


def split_counts(accounts: DataFrame) -> DataFrame:
    return accounts.groupBy("split").agg(F.count("*").alias("accounts"))
