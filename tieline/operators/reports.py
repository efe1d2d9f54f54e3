"""Reports over a run: listings, subgraphs, timelines and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieline.config import DetectConfig
from tieline.functions.fixed import half_up, ratio, scaled, units
from tieline.functions.ids import money_text, node_label
from tieline.functions.lineage import cut
from tieline.functions.marks import marked, marks
from tieline.functions.skew import attach
from tieline.operators import incidence
from tieline.operators.scoring import contributing
from tieline.sources.tables import Activity
from tieline.vocabulary import FAILURE_CATEGORIES


# --- clusters ----------------------------------------------------------------
def _listed(clusters: DataFrame, verdict, method, review_only, min_risk) -> DataFrame:
    if verdict is not None:
        clusters = clusters.where(F.col("verdict") == verdict)
    if method is not None:
        clusters = clusters.where(F.col("method") == method)
    if review_only:
        clusters = clusters.where("requires_review")
    if min_risk is not None:
        clusters = clusters.where(F.col("risk_score") >= min_risk)
    return clusters


def cluster_list(
    clusters: DataFrame, verdict: str | None = None, method: str | None = None, review_only: bool = False,
    min_risk: float | None = None, limit: int | None = None, offset: int = 0,
    config: DetectConfig = DetectConfig(),
) -> DataFrame:
    """A page of clusters by risk."""
    return (
        _listed(clusters, verdict, method, review_only, min_risk)
        .orderBy(F.desc("risk_score"), "cluster_id")
        .offset(offset)
        .limit(min(limit or config.list_default, config.list_ceiling))
    )


def cluster_total(
    clusters: DataFrame, verdict: str | None = None, method: str | None = None, review_only: bool = False,
    min_risk: float | None = None,
) -> DataFrame:
    """How many clusters the same conditions select."""
    return _listed(clusters, verdict, method, review_only, min_risk).agg(F.count("*").alias("total"))


def clusters_by_size(clusters: DataFrame) -> DataFrame:
    return clusters.orderBy(F.desc("entity_count"), "cluster_id")


def top_signals(clusters: DataFrame, count: int = 3) -> DataFrame:
    """The strongest contributing signals of each cluster."""
    return clusters.select("cluster_id", F.slice(contributing(F.col("signals")), 1, count).alias("signals"))


# --- subgraph ----------------------------------------------------------------
def subgraph_edges(members: DataFrame, inside: DataFrame, observed: DataFrame) -> DataFrame:
    """Edges of every cluster: inferred ones among its members, observed ones from them.

    ``members`` is (cluster, entity_id); ``inside`` inferred edges with their cluster;
    ``observed`` may be all observed edges, or those of members with their cluster.
    Other columns of ``members``, which its cluster decides, are told as well.
    """
    also = [c for c in members.columns if c not in ("cluster", "entity_id")]
    columns = ("cluster", "id", "src", "dst", "type", "derived", "weight", "provenance", "via",
               "first_seen", "last_seen", "observation_count")
    of_members = observed
    if "cluster" not in observed.columns:
        of_members = observed.join(members.withColumnRenamed("entity_id", "src"), "src")
    if also:
        inside = inside.join(members.select(F.col("entity_id").alias("src"), *also), "src")
    return inside.select(*columns, *also).unionByName(of_members.select(*columns, *also))


def subgraph_nodes(
    members: DataFrame, edges: DataFrame, entities: DataFrame, link_fanout: DataFrame, shared: DataFrame | None = None
) -> DataFrame:
    """Nodes of every cluster: its members and the infrastructure they touched.

    What is known of a node is put together first, one row a node, and joined
    once; a node that very many clusters touch is spread over tasks.  With
    ``shared`` the infrastructure of one account, of which its edge tells all,
    is made of the edge where that lies, and ``entities`` and ``link_fanout``
    need hold no more than the rest.  Other columns of ``members``, which its
    cluster decides, are told as well and must be in ``edges``.
    """
    also = [c for c in members.columns if c not in ("cluster", "entity_id")]
    infra = edges.where(~F.col("derived")).select("cluster", F.col("dst").alias("id"), *also)
    if shared is not None:
        infra = incidence.not_own(infra, F.col("id"), shared)
    ids = members.select("cluster", F.col("entity_id").alias("id"), *also).union(infra).distinct()
    fan = link_fanout.select(F.col("infra").alias("id"), "link_count", "account_count")
    facts = entities.join(fan, "id", "left")
    nodes = (
        attach(ids, facts, "id", "cluster")
        .select(
            "cluster", "id", "type", "anonymized_key",
            node_label(F.col("type"), F.col("anonymized_key")).alias("label"),
            "first_seen", "last_seen", "event_count",
            F.coalesce("link_count", F.lit(0)).alias("link_count"),
            F.coalesce("account_count", F.lit(0)).alias("account_count"),
            *also,
        )
    )
    if shared is None:
        return nodes
    own = incidence.own_nodes(edges, shared).select(
        "cluster", F.col("node").alias("id"), F.col("kind").alias("type"), F.col("key").alias("anonymized_key"),
        node_label(F.col("kind"), F.col("key")).alias("label"), "first_seen", "last_seen", "event_count",
        F.lit(0).cast("bigint").alias("link_count"), F.lit(1).cast("bigint").alias("account_count"), *also,
    )
    return nodes.unionByName(own)


def visible(
    nodes: DataFrame, edges: DataFrame, hidden_types: tuple[str, ...] = (), show_derived: bool = True,
    show_observed: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Nodes of the types not hidden, and the edges between them of the classes shown.

    An edge moves once, to the node it leads to.  Edges have few different
    sources; of these the ones that are not shown are told first, and only edges
    whose source may be one of them are asked again.
    """
    shown = nodes.where(~F.col("type").isin(*hidden_types)) if hidden_types else nodes
    ends = cut(shown.select("cluster", "id"))
    kept = edges.where(F.col("src").isNotNull())
    if not show_derived:
        kept = kept.where(~F.col("derived"))
    if not show_observed:
        kept = kept.where("derived")
    of = lambda node: F.xxhash64("cluster", node)
    sources = cut(kept.select("cluster", "src").distinct())
    known = marked(ends, of("id"), cut(marks(sources, of("src")))).withColumnRenamed("id", "src")
    unseen = cut(sources.join(known, ["cluster", "src"], "left_anti"))
    if not unseen.isEmpty():
        table = cut(marks(unseen, of("src")))
        asked = marked(kept, of("src"), table).join(unseen, ["cluster", "src"], "left_anti")
        kept = asked.unionByName(marked(kept, of("src"), table, False))
    return shown, kept.join(ends.withColumnRenamed("id", "dst"), ["cluster", "dst"], "left_semi")


def node_degree(edges: DataFrame) -> DataFrame:
    """Derived and observed links of every node within its cluster."""
    ends = edges.select("cluster", F.explode(F.array("src", "dst")).alias("node"), "derived")
    return ends.groupBy("cluster", "node").agg(
        F.count("*").alias("degree"),
        F.count_if("derived").alias("derived_links"),
        F.count_if(~F.col("derived")).alias("observed_links"),
    )


def cluster_detail(clusters: DataFrame, member_rows: DataFrame, accounts: DataFrame, entities: DataFrame) -> DataFrame:
    """Every member of every cluster beside its account, its node and the cluster's score."""
    head = clusters.select("cluster_id", "risk_score", "confidence", "verdict", "account_count")
    owner = accounts.select(
        "entity_id", F.col("id").alias("account_id"), "customer_key", "opened_at", "tenure_days"
    )
    node = entities.select(F.col("id").alias("entity_id"), "first_seen", "last_seen", "event_count")
    return (
        member_rows.join(head, "cluster_id").join(owner, "entity_id", "left").join(node, "entity_id", "left")
    )


def timeline(cluster_accounts: DataFrame, activity: Activity) -> DataFrame:
    """Orders, returns and refunds of every cluster's accounts in time order."""
    ordered = activity.orders.select(
        F.col("placed_at").alias("at"), F.lit("ORDER").alias("kind"), "id", "account_id",
        F.concat("product_category", F.lit(" · "), money_text(F.col("amount_minor"))).alias("detail"), "amount_minor",
    )
    came_back = activity.returns.select(
        F.col("initiated_at").alias("at"), F.lit("RETURN").alias("kind"), "id", "account_id",
        F.concat("reason", F.lit(" · "), F.col("days_after_delivery").cast("string"), F.lit("d after delivery")).alias("detail"),
        F.lit(0).cast("bigint").alias("amount_minor"),
    )
    paid_back = activity.refunds.select(
        F.col("processed_at").alias("at"), F.lit("REFUND").alias("kind"), "id", "account_id",
        F.concat(money_text(F.col("amount_minor")), F.lit(" refunded")).alias("detail"), "amount_minor",
    )
    owners = cluster_accounts.select("cluster_id", "account_id")
    events = [part.join(owners, "account_id") for part in (ordered, came_back, paid_back)]
    return (
        events[0].unionByName(events[1]).unionByName(events[2])
        .select("cluster_id", "at", "kind", "id", "account_id", "detail", "amount_minor")
        .orderBy("cluster_id", "at", "kind", "id")
    )


# --- summaries -----------------------------------------------------------------
def _missing(present: str) -> Column:
    lacking = F.greatest(F.col("accounts") - F.col(present), F.lit(0))
    return F.coalesce(ratio(lacking, F.col("accounts")), F.lit(0).cast("decimal(9,4)"))


def coverage(activity: Activity, orphans: DataFrame) -> DataFrame:
    """How much of the population carries each kind of key, and how many accounts link to no one.

    Keys are first folded to one row per account, so counting needs no
    expansion over distinct values.
    """
    has = {"device": "device_key", "address": "address_key", "payment": "payment_key"}
    per_account = activity.orders.groupBy("account_id").agg(
        F.count("*").alias("orders"),
        *[F.max(F.when(F.col(key).isNotNull(), 1).otherwise(0)).alias(name) for name, key in has.items()],
    )
    orders = per_account.agg(
        F.coalesce(F.sum("orders"), F.lit(0)).cast("bigint").alias("orders"),
        *[F.coalesce(F.sum(name), F.lit(0)).cast("bigint").alias(f"with_{name}") for name in has],
    )
    accounts = activity.accounts.agg(F.count("*").alias("accounts"))
    alone = orphans.agg(F.count("*").alias("orphan_accounts"))
    return beside(accounts, orders, alone).select(
        "accounts", "with_device", "with_address", "with_payment",
        *[_missing(f"with_{name}").alias(f"missing_{name}") for name in has],
        "orders", "orphan_accounts",
    )


def beside(*one_row: DataFrame) -> DataFrame:
    """Frames of exactly one row each, side by side; stacked and folded, not joined."""
    stacked = one_row[0]
    for frame in one_row[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def long_counts(df: DataFrame, section: str, key: str | None = None) -> DataFrame:
    """(section, key, value) rows of a count, optionally per value of ``key``."""
    grouped = df.groupBy(F.lit("all").alias("key") if key is None else F.col(key).cast("string").alias("key"))
    return grouped.agg(F.count("*").cast("decimal(18,4)").alias("value")).select(
        F.lit(section).alias("section"), "key", "value"
    )


def overview(
    entities: DataFrame, edges: DataFrame, activity: Activity, orphans: DataFrame, clusters: DataFrame,
    reviews: DataFrame, runs: DataFrame, evaluations: DataFrame,
) -> DataFrame:
    """The whole dashboard as (section, key, value) rows; undefined rates are NULL.

    ``runs`` and ``evaluations`` are the stored tables; besides their counts the
    figures of the latest row of each are told, if there is one.
    """
    counted = [
        long_counts(entities, "entities_by_type", "type"),
        long_counts(edges.select(F.when(F.col("derived"), "derived").otherwise("observed").alias("class")), "edges", "class"),
        long_counts(clusters, "clusters_by_verdict", "verdict"),
        long_counts(reviews, "reviews_by_status", "status"),
    ]
    totals = beside(
        activity.accounts.agg(F.count("*").alias("accounts")),
        orphans.agg(F.count("*").alias("orphan_accounts")),
        activity.orders.agg(F.count("*").alias("orders")),
        activity.returns.agg(F.count("*").alias("returns")),
        activity.refunds.agg(F.count("*").alias("refunds")),
        clusters.agg(
            F.count("*").alias("clusters"),
            F.count_if("requires_review").alias("review_required"),
            F.count_if("capped_by_guardrail").alias("capped_by_guardrail"),
            scaled(half_up(units(F.sum("risk_score"), 2), F.count("*")), 2).alias("average_risk"),
        ),
        reviews.agg(F.count_if(F.col("status") != "PENDING").alias("reviews_decided")),
        runs.agg(F.count("*").alias("runs")),
        evaluations.agg(F.count("*").alias("evaluations")),
    ).withColumns(
        {
            "unclusterable_rate": ratio(F.col("orphan_accounts"), F.col("accounts")),
            "return_rate": ratio(F.col("returns"), F.col("orders")),
        }
    )
    flat = totals.select(*[F.col(c).cast("decimal(18,4)").alias(c) for c in totals.columns])
    rows = flat.unpivot([], flat.columns, "key", "value").select(F.lit("totals").alias("section"), "key", "value")
    newest = [
        _figures(latest(runs, "created_at"), "latest_run", "entity_count", "derived_edge_count", "cluster_count"),
        _figures(latest(evaluations, "started_at"), "latest_evaluation", "ring_count", "risk_threshold"),
    ]
    for part in counted + newest:
        rows = rows.unionByName(part)
    return rows


def _figures(row: DataFrame, section: str, *columns: str) -> DataFrame:
    flat = row.select(*[F.col(c).cast("decimal(18,4)").alias(c) for c in columns])
    return flat.unpivot([], list(columns), "key", "value").select(F.lit(section).alias("section"), "key", "value")


def latest(df: DataFrame, at: str) -> DataFrame:
    """The row with the greatest timestamp, as columns."""
    return df.agg(F.max_by(F.struct(*df.columns), F.struct(at, "id")).alias("row")).where(
        F.col("row").isNotNull()
    ).select("row.*")


def header_counts(clusters: DataFrame, reviews: DataFrame) -> DataFrame:
    return beside(
        clusters.agg(F.count("*").alias("clusters")),
        reviews.agg(F.count_if(F.col("status") == "PENDING").alias("pending_reviews")),
    )


def failure_summary(log: DataFrame, clusters: DataFrame, findings: DataFrame) -> DataFrame:
    """Failures in five named categories, silent ones included.

    Sparse clusters and flagged text are never written to the log, so these two
    are counted from the result tables.
    """
    spark = log.sparkSession
    categories = spark.createDataFrame(
        [(name, severity, text) for name, (severity, text) in FAILURE_CATEGORIES.items()],
        "category string, severity string, description string",
    )
    logged = (
        log.where(F.col("result").isin("FAILURE", "BLOCKED"))
        .groupBy(F.col("action").alias("category"))
        .agg(F.count("*").alias("n"))
        .where(~F.col("category").isin("INSUFFICIENT_DATA", "INJECTION_DETECTED"))
    )
    sparse = clusters.where(F.col("verdict") == "INSUFFICIENT_DATA").agg(
        F.lit("INSUFFICIENT_DATA").alias("category"), F.count("*").alias("n")
    )
    flagged = findings.agg(F.lit("INJECTION_DETECTED").alias("category"), F.count("*").alias("n"))
    counts = logged.unionByName(sparse).unionByName(flagged)
    return categories.join(counts, "category", "left").select(
        "category", "severity", "description", F.coalesce("n", F.lit(0)).alias("events")
    )


def evaluation_list(evaluations: DataFrame, limit: int = 20) -> DataFrame:
    return evaluations.orderBy(F.desc("started_at"), "id").limit(min(limit, 50))


def run_summary(
    run_id: str, method: str, at: Column, entities: DataFrame, edges: DataFrame, observed: DataFrame,
    clusters: DataFrame, quality: DataFrame, config: DetectConfig = DetectConfig(),
) -> DataFrame:
    """One row for the run table: sizes, data quality and the parameters used."""
    sizes = beside(
        entities.agg(F.count("*").alias("entity_count")),
        observed.agg(F.count("*").alias("edge_count")),
        edges.agg(F.count("*").alias("derived_edge_count")),
        clusters.agg(F.count("*").alias("cluster_count")),
        quality.select(F.struct("*").alias("data_quality")),
    )
    return sizes.select(
        F.lit(run_id).alias("id"),
        F.lit(method).alias("method"),
        "entity_count", "edge_count", "derived_edge_count", "cluster_count", "data_quality",
        F.struct(
            F.lit(config.risk_threshold).alias("risk_threshold"),
            F.lit(config.confidence_threshold).alias("confidence_threshold"),
            F.lit(config.min_cluster_accounts).alias("min_cluster_accounts"),
            F.lit(config.min_events_per_account).alias("min_events_per_account"),
            F.lit(config.max_accounts_per_node).alias("max_accounts_per_node"),
            F.lit(config.min_edge_weight).alias("min_edge_weight"),
        ).alias("parameters"),
        at.alias("created_at"),
    )
