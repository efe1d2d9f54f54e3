"""From events to graph material: entities, rollups, observed edges, incidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieline.functions.fixed import ratio
from tieline.functions.ids import digest_id, entity_id
from tieline.functions.marks import marked, marks
from tieline.sources.tables import Activity
from tieline.vocabulary import LINKING

ACCOUNT_ID = "ent_acc_"  # as entity_id names accounts


def touches(orders: DataFrame, *also: str) -> DataFrame:
    """One row per order and infrastructure key it carries; null keys give none."""
    keys = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), F.col(column).alias("key"))
            for kind, (column, *_) in LINKING.items()
        ]
    )
    return (
        orders.select("id", "account_id", "placed_at", *also, F.explode(keys).alias("touched"))
        .where(F.col("touched.key").isNotNull())
        .select("id", "account_id", "placed_at", *also, "touched.kind", "touched.key")
    )


def shared_nodes(orders: DataFrame, accounts: DataFrame) -> DataFrame:
    """Marks of all infrastructure that two incidences or more may be of, and of few others.

    Most keys are one account's own.  Only a hash of each account's keys moves to
    tell which are not; what is known of all others is folded where their
    account's orders lie.  An account that comes twice shares its keys with itself.
    """
    used = touches(orders).select("account_id", _node_hash().alias("h")).distinct()
    rows = accounts.groupBy(F.col("id").alias("account_id")).agg(F.count("*").alias("n"))
    times = used.join(rows.hint("shuffle_hash"), "account_id", "left").select("h", F.coalesce("n", F.lit(1)).alias("n"))
    return marks(times.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"), F.col("h"))


def _node_hash(node: Column | None = None) -> Column:
    """Of touches, for which no text is made, or of a node's id."""
    return F.xxhash64("kind", "key") if node is None else F.xxhash64(node_type(node, *LINKING), node_key(node))


def node_type(node: Column, *kinds: str) -> Column:
    """The type that an id names, and null where that is none of ``kinds``."""
    return F.coalesce(*[F.when(node.startswith(entity_id(F.lit(k), F.lit(""))), F.lit(k)) for k in kinds])


def node_key(node: Column) -> Column:
    return F.substring(node, F.length(entity_id(F.lit("ACCOUNT"), F.lit(""))) + 1, F.length(node))


def not_own(rows: DataFrame, node: Column, shared: DataFrame) -> DataFrame:
    """Rows whose node is no infrastructure of one account alone."""
    kinds = marked(rows.where(node_type(node, *LINKING).isNotNull()), _node_hash(node), shared)
    return kinds.unionByName(rows.where(node_type(node, *LINKING).isNull()))


def own_nodes(edges: DataFrame, shared: DataFrame) -> DataFrame:
    """Infrastructure at the end of one account's observed edges alone, with all that is known of it, and the edges' other columns."""
    of = F.col("dst")
    own = marked(edges.where(~F.col("derived") & node_type(of, *LINKING).isNotNull()), _node_hash(of), shared, False)
    return own.select(
        "*", of.alias("node"), node_type(of, *LINKING).alias("kind"), node_key(of).alias("key"),
        F.col("observation_count").alias("event_count"),
    )


def entities(accounts: DataFrame, orders: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """Every distinct node with first and last sighting and its event count.

    With ``shared`` infrastructure that is one account's own is left out.
    """
    from_accounts = accounts.select(
        F.explode(
            F.array(
                F.struct(F.lit("ACCOUNT").alias("type"), F.col("id").alias("key")),
                F.struct(F.lit("CUSTOMER").alias("type"), F.col("customer_key").alias("key")),
            )
        ).alias("node"),
        F.col("opened_at").alias("at"),
    ).select("node.type", "node.key", "at")
    touched = touches(orders) if shared is None else marked(touches(orders), _node_hash(), shared)
    from_orders = touched.select(F.col("kind").alias("type"), "key", F.col("placed_at").alias("at"))
    seen = (
        F.min("at").alias("first_seen"),
        F.max("at").alias("last_seen"),
        F.count("*").alias("event_count"),
    )
    # an id names its type and whole key, so rows are dealt by it alone and a join on it moves none again
    by_id = (
        from_accounts.where(F.col("key").isNotNull()).unionByName(from_orders)
        .groupBy(entity_id(F.col("type"), F.col("key")).alias("id"))
        .agg(*seen)
    )
    named = by_id.select(
        "id", node_type(F.col("id"), "ACCOUNT", "CUSTOMER", *LINKING).alias("type"),
        node_key(F.col("id")).alias("anonymized_key"), "first_seen", "last_seen", "event_count",
    )
    unnamed = from_accounts.where(F.col("key").isNull()).groupBy("type").agg(*seen)
    no = F.lit(None).cast("string")
    return named.unionByName(
        unnamed.select(no.alias("id"), "type", no.alias("anonymized_key"), "first_seen", "last_seen", "event_count")
    )


def account_activity(activity: Activity) -> DataFrame:
    """Per-account counts, sums and rates.

    Each event table is reduced to one row per account before any join, so the
    event tables are never multiplied with one another.
    """
    bought = activity.orders.groupBy("account_id").agg(
        F.count("*").alias("order_count"),
        F.sum("amount_minor").alias("order_value_minor"),
    )
    categories = (
        activity.orders.select("account_id", "product_category")
        .distinct()
        .groupBy("account_id")
        .agg(F.count("product_category").alias("distinct_categories"))
    )
    came_back = activity.returns.groupBy("account_id").agg(F.count("*").alias("return_count"))
    paid_back = activity.refunds.groupBy("account_id").agg(
        F.count("*").alias("refund_count"),
        F.sum("amount_minor").alias("refund_value_minor"),
    )
    measures = (
        "order_count", "return_count", "refund_count",
        "order_value_minor", "refund_value_minor", "distinct_categories",
    )
    joined = activity.accounts.withColumnRenamed("id", "account_id")
    for part in (bought, categories, came_back, paid_back):
        joined = joined.join(part, "account_id", "left")
    return joined.select(
        "account_id", "entity_id", "customer_key", "opened_at", "tenure_days", "split",
        *[F.coalesce(F.col(m), F.lit(0)).cast("bigint").alias(m) for m in measures],
    )


def account_rates(rollup: DataFrame) -> DataFrame:
    """Return rate and refund share of each account, 0 where nothing was ordered."""
    zero = F.lit(0).cast("decimal(18,4)")
    return rollup.withColumns(
        {
            "return_rate": F.coalesce(
                ratio(F.col("return_count"), F.col("order_count"), 4, 18), zero
            ),
            "refund_share": F.coalesce(
                ratio(F.col("refund_value_minor"), F.col("order_value_minor"), 4, 18, wide=True), zero
            ),
        }
    )


def observed_edges(accounts: DataFrame, orders: DataFrame, *also: str) -> DataFrame:
    """Edges asserted by events, with the first event as provenance.

    Events are folded by account and key as they come, where orders kept by
    account need no shuffle; ids and texts are made of the folded rows.
    ``also`` names columns of both tables that depend on the source alone and
    are passed on.
    """
    event = lambda prefix, suffix: F.concat(F.lit(prefix), "id", F.lit(suffix))
    folded = lambda events, *key: events.groupBy(*key, *also).agg(
        F.min("at").alias("first_seen"),
        F.max("at").alias("last_seen"),
        F.count("*").alias("observation_count"),
        F.min_by("event", F.struct("at", "event")).alias("provenance"),
    )
    told = ("first_seen", "last_seen", "observation_count", "provenance", *also)
    edge_type = F.coalesce(
        *[F.when(F.col("kind") == kind, F.lit(edge)) for kind, (_, edge, *_) in LINKING.items()]
    )
    used = touches(orders, *also).select(
        "account_id", "kind", "key", F.col("placed_at").alias("at"), event("order ", "").alias("event"), *also
    )
    owned = accounts.select(
        "customer_key", "entity_id", F.col("opened_at").alias("at"), event("account ", " opened").alias("event"), *also
    )
    return (
        folded(used, "account_id", "kind", "key")
        .select(
            entity_id(F.lit("ACCOUNT"), F.col("account_id")).alias("src"),
            entity_id(F.col("kind"), F.col("key")).alias("dst"),
            edge_type.alias("type"), *told,
        )
        .unionByName(
            folded(owned, "customer_key", "entity_id").select(
                entity_id(F.lit("CUSTOMER"), F.col("customer_key")).alias("src"),
                F.col("entity_id").alias("dst"), F.lit("OWNS").alias("type"), *told,
            )
        )
        .select(
            digest_id("edg", F.col("src"), F.col("dst"), F.col("type")).alias("id"),
            "src", "dst", "type",
            F.lit(False).alias("derived"),
            F.lit(1).cast("decimal(9,4)").alias("weight"),
            "provenance",
            F.lit(None).cast("string").alias("via"),
            "first_seen", "last_seen", "observation_count", *also,
        )
    )


def member_edges(members: DataFrame, accounts: DataFrame, orders: DataFrame) -> DataFrame:
    """Observed edges from members of clusters, with their cluster; events of all others are left out first.

    Other columns of ``members`` that its cluster decides are passed on.
    """
    also = [c for c in members.columns if c != "entity_id"]
    accounts_of = members.where(F.col("entity_id").startswith(ACCOUNT_ID)).select(
        F.substring("entity_id", F.lit(len(ACCOUNT_ID) + 1), F.length("entity_id")).alias("account_id"), *also
    )
    customer = entity_id(F.lit("CUSTOMER"), F.col("customer_key"))
    owned = accounts.join(members.withColumnRenamed("entity_id", "_member"), customer == F.col("_member"))
    return observed_edges(owned, orders.join(accounts_of.hint("shuffle_hash"), "account_id"), *also)


def own_entities(orders: DataFrame, shared: DataFrame) -> DataFrame:
    """The entities that ``entities`` leaves out with ``shared``, folded by account where the orders lie."""
    own = marked(touches(orders), _node_hash(), shared, False)
    folded = own.groupBy("account_id", "kind", "key").agg(
        F.min("placed_at").alias("first_seen"), F.max("placed_at").alias("last_seen"), F.count("*").alias("event_count")
    )
    return folded.select(
        entity_id(F.col("kind"), F.col("key")).alias("id"), F.col("kind").alias("type"), F.col("key").alias("anonymized_key"),
        "first_seen", "last_seen", "event_count",
    )


def incidence(
    orders: DataFrame, accounts: DataFrame, nodes: DataFrame | None = None, shared: DataFrame | None = None
) -> DataFrame:
    """Account-to-infrastructure incidences, resolved to node ids.

    Orders of unknown accounts drop out.  Events are folded to one row per
    (account, key) before anything is joined.  Node ids follow from type and
    key; pass ``nodes`` to resolve against an entity table with ids of its own.
    With ``shared`` infrastructure that is one account's own is left out.
    """
    touched = touches(orders) if shared is None else marked(touches(orders), _node_hash(), shared)
    folded = touched.groupBy("account_id", "kind", "key").agg(
        F.count("*").alias("observations"),
        F.min("placed_at").alias("first_seen"),
        F.max("placed_at").alias("last_seen"),
    )
    owners = accounts.select(F.col("id").alias("account_id"), F.col("entity_id").alias("account"))
    # one narrow row per account: hashed by partition, so that the folded rows are not sorted
    resolved = folded.join(owners.hint("shuffle_hash"), "account_id")
    if nodes is None:
        resolved = resolved.withColumn("infra", entity_id(F.col("kind"), F.col("key")))
    else:
        known = nodes.select(
            F.col("type").alias("kind"), F.col("anonymized_key").alias("key"), F.col("id").alias("infra")
        )
        resolved = resolved.join(known, ["kind", "key"])
    return resolved.select(
        "account", "infra", "kind", "observations", "first_seen", "last_seen"
    )


def distinct_keys(orders: DataFrame, owner: str = "account_id") -> DataFrame:
    """Distinct infrastructure keys and categories of each owner of orders."""
    columns = {kind: column for kind, (column, *_) in LINKING.items()} | {"CATEGORY": "product_category"}
    keys = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.col(c).alias("key")) for k, c in columns.items()]
    )
    return (
        orders.select(owner, F.explode(keys).alias("touched"))
        .where(F.col("touched.key").isNotNull())
        .select(owner, "touched.kind", "touched.key")
        .distinct()
    )
