"""Behaviour of each cluster, from per-account figures and return times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tieline.config import DetectConfig
from tieline.functions.fixed import half_up, ratio, scaled
from tieline.functions.lineage import cut
from tieline.functions.skew import attach
from tieline.operators import incidence
from tieline.vocabulary import NO_RETURNS_DAYS

# Values per bucket in the two-step median.  For milliseconds this splits 35
# years into a million buckets of a million values, which bounds both windows.
MEDIAN_BUCKET = 1 << 20


def exact_median(values: DataFrame, key: str, value: str, bucket: int = MEDIAN_BUCKET) -> DataFrame:
    """Exact median of an integral column per key, as the sum of the two middle values.

    (key, n, middle_sum); the median is ``middle_sum / 2``.  Equal values are
    counted map-side, the middle is first located among buckets and then among
    the values of the one or two buckets holding it, so no task ever sorts or
    holds all values of a key.
    """
    counted = (
        values.where(F.col(value).isNotNull())
        .groupBy(key, F.call_function("div", F.col(value), F.lit(bucket)).alias("bucket"), F.col(value).alias("v"))
        .agg(F.count("*").alias("n"))
    )
    buckets = counted.groupBy(key, "bucket").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    over_key = Window.partitionBy(key)
    low, high = F.call_function("div", F.col("total") + 1, F.lit(2)), F.call_function("div", F.col("total"), F.lit(2)) + 1
    holding = (
        buckets.withColumn("end", F.sum("n").over(upto))
        .withColumn("total", F.sum("n").over(over_key))
        .withColumn("before", F.col("end") - F.col("n"))
        .where(
            ((low > F.col("before")) & (low <= F.col("end")))
            | ((high > F.col("before")) & (high <= F.col("end")))
        )
        .select(key, "bucket", "before", "total")
    )
    within = Window.partitionBy(key, "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    is_low = (low > F.col("end") - F.col("n")) & (low <= F.col("end"))
    is_high = (high > F.col("end") - F.col("n")) & (high <= F.col("end"))
    zero = F.lit(0).cast("bigint")
    return (
        counted.join(holding, [key, "bucket"])
        .withColumn("end", F.col("before") + F.sum("n").over(within))
        .groupBy(key)
        .agg(
            F.max("total").alias("n"),
            F.sum(F.when(is_low, F.col("v")).otherwise(zero) + F.when(is_high, F.col("v")).otherwise(zero)).alias(
                "middle_sum"
            ),
        )
    )


def return_spread(cluster_returns: DataFrame) -> DataFrame:
    """Median absolute deviation of return times per cluster.

    ``spread_quarter_ms`` is four times the deviation in milliseconds, a whole
    number; clusters with fewer than two returns have no row.  Both medians are
    located by buckets, whatever the size of a cluster.
    """
    times = cluster_returns.select("cluster", F.unix_millis("initiated_at").alias("t"))
    centre = exact_median(times, "cluster", "t").where(F.col("n") >= 2)
    away = attach(times, centre, "cluster", "t").select(
        "cluster", F.abs(F.col("t") * 2 - F.col("middle_sum")).alias("away")
    )
    return exact_median(away, "cluster", "away", 2 * MEDIAN_BUCKET).select(
        "cluster", F.col("middle_sum").alias("spread_quarter_ms")
    )


def cluster_accounts(members: DataFrame, accounts: DataFrame) -> DataFrame:
    """Members that are known accounts."""
    return members.join(
        accounts.select("entity_id", F.col("id").alias("account_id"), "tenure_days"), "entity_id"
    ).select("cluster", "entity_id", "account_id", "tenure_days")


def aggregate_clusters(
    owned: DataFrame, rollup: DataFrame, orders: DataFrame, returns: DataFrame,
    config: DetectConfig = DetectConfig(),
) -> DataFrame:
    """The sixteen measures of each cluster.

    ``owned`` is (cluster, entity_id, account_id, tenure_days), ``rollup`` one
    row per account.
    """
    figures = owned.join(rollup.drop("entity_id", "tenure_days"), "account_id")
    # ten decimals per account keep the mean exact to the four that are shown
    rate = F.coalesce(half_up(F.col("return_count"), F.col("order_count"), 10, wide=True), F.lit(0))
    top_rate = F.coalesce(ratio(F.col("return_count"), F.col("order_count"), 4, 18), F.lit(0).cast("decimal(18,4)"))
    base = figures.groupBy("cluster").agg(
        F.count("*").alias("account_count"),
        *[
            F.sum(c).cast("bigint").alias(c)
            for c in ("order_count", "return_count", "refund_count", "order_value_minor", "refund_value_minor")
        ],
        # tenures are whole days, so the median's buffer is bounded by the calendar
        F.median("tenure_days").alias("median_tenure_days"),
        F.max(top_rate).alias("max_account_return_rate"),
        F.sum(rate.cast("decimal(28,0)")).alias("rate_sum"),
    )
    # one narrow row per account, hashed by partition: events are not sorted for the join
    owners = owned.select("cluster", "account_id").hint("shuffle_hash")
    distinct_keys = incidence.distinct_keys(orders.join(owners, "account_id"), "cluster")
    distinct_counts = distinct_keys.groupBy("cluster").agg(
        *[
            F.count_if(F.col("kind") == kind).alias(name)
            for kind, name in (
                ("DEVICE", "distinct_devices"), ("ADDRESS", "distinct_addresses"),
                ("PAYMENT", "distinct_payments"), ("CATEGORY", "distinct_categories"),
            )
        ]
    )
    came_back = returns.select("account_id", "initiated_at", "days_after_delivery").join(owners, "account_id")
    delays = came_back.groupBy("cluster").agg(F.median("days_after_delivery").alias("median_days"))
    spread = return_spread(came_back)
    zero = F.lit(0)
    joined = base
    for part in (distinct_counts, delays, spread):
        joined = joined.join(part, "cluster", "left")
    return joined.select(
        "cluster", "account_count", "order_count", "return_count", "refund_count",
        "order_value_minor", "refund_value_minor",
        *[
            F.coalesce(c, zero).alias(c)
            for c in ("distinct_devices", "distinct_addresses", "distinct_payments", "distinct_categories")
        ],
        "median_tenure_days",
        "spread_quarter_ms",
        F.coalesce("median_days", F.lit(float(NO_RETURNS_DAYS))).alias("median_days_after_delivery"),
        F.col("max_account_return_rate").cast("decimal(9,4)").alias("max_account_return_rate"),
        scaled(
            half_up(F.col("rate_sum"), F.col("account_count").cast("decimal(20,0)") * 1_000_000, wide=True), 4
        ).alias("mean_account_return_rate"),
        ratio(F.col("order_count"), F.col("account_count"), 2, 18).alias("events_per_account"),
    )
