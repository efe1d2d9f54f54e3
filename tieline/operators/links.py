"""Inferred account-to-account links and the guard in front of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieline.config import DetectConfig
from tieline.functions.fixed import half_up, scaled
from tieline.functions.ids import digest_id
from tieline.functions.marks import marked, marks
from tieline.vocabulary import DECAY_FLOOR, DECAY_HORIZON_DAYS, DECAY_SLOPE, LINKING

# A node can hold more than one in HOT_SHARE of all incidences in fewer than
# HOT_SHARE cases, whatever the data, so a list of such nodes may be broadcast.
HOT_SHARE = 50_000

DAY_MS = 86_400_000


def overlap_units(a_first: Column, a_last: Column, b_first: Column, b_last: Column) -> Column:
    """Temporal factor of two usage windows in ten-thousandths: 10000 down to the floor."""
    gap = F.greatest(
        F.lit(0),
        F.unix_millis(F.greatest(a_first, b_first)) - F.unix_millis(F.least(a_last, b_last)),
    )
    horizon = DECAY_HORIZON_DAYS * DAY_MS
    gap = F.least(gap, F.lit(horizon))
    remaining = F.lit(10_000 * horizon) - gap * F.lit(DECAY_SLOPE)
    return F.greatest(F.lit(DECAY_FLOOR).cast("bigint"), half_up(remaining, horizon))


def _by_kind(position: int) -> Column:
    return F.coalesce(
        *[F.when(F.col("kind") == kind, F.lit(spec[position])) for kind, spec in LINKING.items()]
    )


def link_weight(factor_units: Column) -> Column:
    """Strength of the linking kind times the temporal factor, four decimals."""
    return scaled(half_up(_by_kind(3).cast("bigint") * factor_units, 100), 4)


def fan_out(incidences: DataFrame) -> DataFrame:
    """Accounts per infrastructure node."""
    return incidences.groupBy("infra", "kind").agg(F.count("*").alias("account_count"))


def skipped_nodes(fan_outs: DataFrame, config: DetectConfig = DetectConfig()) -> DataFrame:
    """Nodes too widely shared to link anyone."""
    return fan_outs.where(F.col("account_count") > config.max_accounts_per_node)


def guarded(
    incidences: DataFrame, config: DetectConfig = DetectConfig(), counts: DataFrame | None = None
) -> DataFrame:
    """Incidences of the nodes that may link accounts: two up to the cap.

    A default value or gateway seen by a large share of all accounts would put
    its rows into one task only to be dropped there, so such nodes are removed
    by a broadcast list of provably bounded length before the shuffle.  Of the
    others most have one account only; a bitmap over hashes of the usable nodes
    drops nearly all of them before the exact semi join.
    """
    counts = fan_out(incidences) if counts is None else counts
    share = counts.agg(F.sum("account_count") / HOT_SHARE).scalar()
    hot = counts.where(
        (F.col("account_count") > config.max_accounts_per_node) & (F.col("account_count") > share)
    ).select("infra")
    usable = counts.where(F.col("account_count").between(2, config.max_accounts_per_node)).select("infra")
    h = F.xxhash64("infra")
    return (
        marked(incidences.join(F.broadcast(hot), "infra", "left_anti"), h, marks(usable, h))
        .join(usable, "infra", "left_semi")
    )


def inferred_edges(guarded_incidences: DataFrame) -> DataFrame:
    """Account pairs sharing a node, one edge per pair and kind.

    Where a pair shares several nodes of a kind the heaviest link stands, the
    smaller node id on a tie.
    """
    a = guarded_incidences.select(
        "infra", "kind",
        F.col("account").alias("src"), F.col("first_seen").alias("a_first"),
        F.col("last_seen").alias("a_last"), F.col("observations").alias("a_n"),
    )
    b = guarded_incidences.select(
        "infra",
        F.col("account").alias("dst"), F.col("first_seen").alias("b_first"),
        F.col("last_seen").alias("b_last"), F.col("observations").alias("b_n"),
    )
    factor = overlap_units(F.col("a_first"), F.col("a_last"), F.col("b_first"), F.col("b_last"))
    best = (
        a.join(b, "infra")
        .where(F.col("src") < F.col("dst"))
        .select(
            "src", "dst", "kind",
            F.struct(
                (-link_weight(factor)).alias("lightness"),
                F.col("infra").alias("via"),
                F.least("a_first", "b_first").alias("first_seen"),
                F.greatest("a_last", "b_last").alias("last_seen"),
                (F.col("a_n") + F.col("b_n")).alias("observation_count"),
            ).alias("link"),
        )
        .groupBy("src", "dst", "kind")
        .agg(F.min("link").alias("link"))
    )
    kind_text = F.lower("kind")
    return best.select(
        "src", "dst", _by_kind(2).alias("type"),
        (-F.col("link.lightness")).cast("decimal(9,4)").alias("weight"),
        F.col("link.via").alias("via"),
        F.concat(F.lit("derived: both accounts touched "), kind_text, F.lit(" "), "link.via").alias("provenance"),
        F.col("link.first_seen").alias("first_seen"),
        F.col("link.last_seen").alias("last_seen"),
        F.col("link.observation_count").alias("observation_count"),
    ).select(
        digest_id("edg", F.col("src"), F.col("dst"), F.col("type")).alias("id"),
        "src", "dst", "type", F.lit(True).alias("derived"),
        "weight", "provenance", "via", "first_seen", "last_seen", "observation_count",
    )


def spanning_links(guarded_incidences: DataFrame, config: DetectConfig = DetectConfig()) -> DataFrame:
    """Fewest links with the same connectivity as the edges at or above the minimum weight.

    With the accounts of a node ordered by first use, an account is close enough
    to some earlier one exactly if it is close enough to the earlier one that
    was used last.  One link per account therefore stands for up to all pairs.
    """
    earlier = (
        Window.partitionBy("infra").orderBy("first_seen", "account")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    nearest = F.max(F.struct("last_seen", "account")).over(earlier)
    # `earlier` started no later, so its first use does not matter to the gap
    factor = overlap_units(
        F.col("first_seen"), F.col("last_seen"), F.col("first_seen"), F.col("nearest.last_seen")
    )
    return (
        guarded_incidences.withColumn("nearest", nearest)
        .where(F.col("nearest").isNotNull())
        .where(link_weight(factor) >= F.lit(config.min_edge_weight))
        .select(
            F.least("account", "nearest.account").alias("src"),
            F.greatest("account", "nearest.account").alias("dst"),
        )
        .distinct()
    )


def heavy_edges(edges: DataFrame, config: DetectConfig = DetectConfig()) -> DataFrame:
    return edges.where(F.col("weight") >= F.lit(config.min_edge_weight))


def adjacency(edges: DataFrame) -> DataFrame:
    """Every edge from both of its ends."""
    columns = ("node", "neighbour", "type", "weight", "via")
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbour"), *columns[2:])
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("neighbour"), *columns[2:])
    return out.unionByName(back)


def orphans(accounts: DataFrame, edges: DataFrame) -> DataFrame:
    """Accounts at the end of no inferred edge."""
    ends = edges.select(F.col("src").alias("entity_id")).union(edges.select("dst"))
    return accounts.join(ends, "entity_id", "left_anti")


def link_fanout(edges: DataFrame, fan_outs: DataFrame) -> DataFrame:
    """Inferred links drawn through each node, beside the accounts on it."""
    links = edges.groupBy(F.col("via").alias("infra")).agg(F.count("*").alias("link_count"))
    return fan_outs.join(links, "infra", "left").select(
        "infra", "kind", "account_count", F.coalesce("link_count", F.lit(0)).alias("link_count")
    )
