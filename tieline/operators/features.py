"""Ten bounded features of a cluster, as decimals with four places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieline.functions.fixed import clamp, half_up, scaled
from tieline.vocabulary import (
    CATEGORY_SPAN,
    FEATURES,
    REFUND_SHARE_BAND,
    RETURN_RATE_BAND,
    SYNCHRONISATION_HOURS,
    VELOCITY_DAYS,
)

_ONE = 10_000
_QUARTER_MS_PER_HOUR = 4 * 3_600_000


def saturate(num: Column, den: Column, band: tuple[int, int], wide: bool = False) -> Column:
    """How far ``num / den`` has moved from the low to the high end of a band in hundredths."""
    low, high = band
    kind = "decimal(24,0)" if wide else "bigint"
    n, d = num.cast(kind), den.cast(kind)
    above = F.greatest(n * 100 - d * low, F.lit(0).cast(kind)).cast(kind)
    return clamp(F.coalesce(half_up(above, (d * (high - low)).cast(kind), 4, wide), F.lit(0)), 0, _ONE)


def concentration(members: Column, distinct: Column) -> Column:
    """1 when all members go through one node, 0 when each has its own."""
    spread = F.greatest(members - distinct, F.lit(0))
    return F.when((members < 2) | (distinct == 0), F.lit(0)).otherwise(half_up(spread, members - 1, 4))


def _feature_units() -> dict[str, Column]:
    c = F.col
    accounts, orders, returns = c("account_count"), c("order_count"), c("return_count")
    refund_band = saturate(c("refund_value_minor"), c("order_value_minor"), REFUND_SHARE_BAND, wide=True)
    # medians of whole days end in .0 or .5, so twice the median is whole
    twice_days = (c("median_days_after_delivery") * 2).cast("bigint")
    slowness = F.greatest(F.lit(2 * VELOCITY_DAYS) - twice_days, F.lit(0))
    limit = SYNCHRONISATION_HOURS * _QUARTER_MS_PER_HOUR
    tightness = F.greatest(F.lit(limit) - c("spread_quarter_ms"), F.lit(0))
    span = F.least(orders, F.lit(CATEGORY_SPAN))
    unused = F.greatest(span - c("distinct_categories"), F.lit(0))
    return {
        "shared_payment": concentration(accounts, c("distinct_payments")),
        "shared_device": concentration(accounts, c("distinct_devices")),
        "shared_address": concentration(accounts, c("distinct_addresses")),
        "return_rate": saturate(returns, orders, RETURN_RATE_BAND),
        "refund_concentration": refund_band,
        "return_velocity": F.when(returns == 0, F.lit(0)).otherwise(
            clamp(half_up(slowness, 2 * VELOCITY_DAYS, 4), 0, _ONE)
        ),
        "temporal_synchronisation": F.when(
            (returns < 3) | c("spread_quarter_ms").isNull(), F.lit(0)
        ).otherwise(half_up(tightness, limit, 4)),
        "value_concentration": refund_band,
        "category_concentration": F.when(span <= 1, F.lit(0)).otherwise(half_up(unused, span - 1, 4)),
    }


def extract_features(aggregates: DataFrame) -> DataFrame:
    """Add the ten features; expects the measures and ``density`` per cluster."""
    features = {name: scaled(value.cast("bigint"), 4) for name, value in _feature_units().items()}
    features["cluster_density"] = F.col("density").cast("decimal(9,4)")
    return aggregates.withColumns({name: features[name] for name in FEATURES})
