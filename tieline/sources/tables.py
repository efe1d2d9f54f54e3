"""The model's tables and the bulk read of one activity snapshot."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

ACCOUNTS = (
    "id string, entity_id string, customer_key string, opened_at timestamp, "
    "tenure_days int, split string"
)
TRUTH = "account_id string, ring_id string, label string"
ORDERS = (
    "id string, account_id string, product_category string, amount_minor bigint, "
    "placed_at timestamp, device_key string, address_key string, payment_key string"
)
RETURNS = (
    "id string, order_id string, account_id string, reason string, "
    "initiated_at timestamp, days_after_delivery int"
)
REFUNDS = "id string, return_id string, account_id string, amount_minor bigint, processed_at timestamp"
RINGS = (
    "id string, label string, template string, difficulty string, split string, "
    "member_account_ids array<string>, shared_infrastructure map<string,array<string>>"
)
EXPLANATIONS = (
    "cluster_id string, summary string, "
    "signals array<struct<signal_type:string,explanation:string>>, caveats array<string>"
)
DECISIONS = (
    "review_id string, decision string, reviewer_id string, note string, "
    "reviewer_verdict string, benign_explanation string"
)


class Activity(NamedTuple):
    """Accounts with their orders, returns and refunds, as four relations."""

    accounts: DataFrame
    orders: DataFrame
    returns: DataFrame
    refunds: DataFrame


def read_table(spark: SparkSession, path: str, *columns: str, schema: str | None = None) -> DataFrame:
    """A Parquet scan of the columns, in the scan's own splits."""
    reader = spark.read.schema(schema) if schema else spark.read
    table = reader.parquet(path)
    return table.select(*columns) if columns else table


def read_activity(spark: SparkSession, path: str) -> Activity:
    """Four typed Parquet scans; nothing is nested or fetched per account."""
    read = lambda name, schema: read_table(spark, f"{path}/{name}", schema=schema)
    return Activity(
        read("accounts", ACCOUNTS),
        read("orders", ORDERS),
        read("return_events", RETURNS),
        read("refund_events", REFUNDS),
    )
