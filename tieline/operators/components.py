"""Connected components and what describes a cluster of linked accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieline.config import DetectConfig
from tieline.functions.fixed import half_up, scaled, units
from tieline.functions.lineage import cut, keep
from tieline.operators.levels import hop_levels
from tieline.operators.links import adjacency


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) with the smallest node id naming the component.

    Randomised contraction: every node points at whichever node within two links
    hashes lowest, edges are rewritten to the nodes pointed at, and duplicates
    and loops go.  So a star ends in one round, whichever of its nodes hash
    lowest.  A fresh hash per round keeps chains short however the ids are laid
    out, so each round works on a graph a fraction of the size of the last.  The
    written maps are then composed from the smallest up.
    """
    remaining = cut(
        edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .where(F.col("src") < F.col("dst"))
        .distinct()
    )
    maps: list[DataFrame] = []
    while not remaining.isEmpty():
        # a text is no part of the generated code, so every round runs the code of the first
        turn = F.lit(f"{len(maps)}")
        order = lambda name: F.struct(F.xxhash64(turn, name).alias("hash"), F.col(name).alias("id"))
        both = remaining.union(remaining.select("dst", "src")).toDF("node", "neighbour")
        # min() combines map-side, so a hub's rows shrink before the shuffle
        lowest = F.least(order("node"), F.min(order("neighbour")))
        nearest = both.groupBy("node").agg(lowest["id"].alias("parent"))
        # a neighbour's lowest is never above a node's own: the node is a neighbour of it
        farther = both.join(nearest.toDF("neighbour", "parent"), "neighbour")
        # three readers, one step away from a written table
        jump = keep(farther.groupBy("node").agg(F.min(order("parent"))["id"].alias("target")))
        maps.append(jump)
        remaining = cut(
            remaining.join(jump.toDF("src", "s"), "src")
            .join(jump.toDF("dst", "d"), "dst")
            .where(F.col("s") != F.col("d"))
            .select(F.least("s", "d").alias("src"), F.greatest("s", "d").alias("dst"))
            .distinct()
        )
    if not maps:
        return remaining.toDF("node", "component")
    composed = maps[-1]
    for smaller in reversed(maps[:-1]):
        onward = composed.toDF("target", "onward")
        composed = smaller.join(onward, "target", "left").select(
            "node", F.coalesce("onward", "target").alias("target")
        )
    composed = cut(composed)
    for jump in maps:
        jump.unpersist()
    names = composed.groupBy("target").agg(F.min("node").alias("component"))
    return composed.join(names, "target").select("node", "component")


def clusters_of(components: DataFrame, config: DetectConfig = DetectConfig()) -> DataFrame:
    """Members (cluster, entity_id) of the components of at least the minimum size."""
    members = components.select(F.col("component").alias("cluster"), F.col("node").alias("entity_id"))
    if config.min_cluster_size <= 2:
        return members
    large = cluster_sizes(members).where(F.col("size") >= config.min_cluster_size)
    return members.join(large.select("cluster"), "cluster", "left_semi")


def cluster_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("cluster").agg(F.count("*").alias("size"))


def intra_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends in the same cluster, with that cluster."""
    at_src = members.select(F.col("entity_id").alias("src"), "cluster")
    at_dst = members.select(F.col("entity_id").alias("dst"), F.col("cluster").alias("dst_cluster"))
    return (
        edges.join(at_src, "src")
        .join(at_dst, "dst")
        .where(F.col("cluster") == F.col("dst_cluster"))
        .drop("dst_cluster")
    )


def density(inside: DataFrame, members: DataFrame) -> DataFrame:
    """Weight of all links inside a cluster over its possible pairs, at most 1.

    Links below the clustering weight and parallel links of several kinds count.
    """
    weight = inside.groupBy("cluster").agg(F.sum("weight").alias("weight"))
    size = F.col("size")
    share = half_up(units(F.coalesce("weight", F.lit(0).cast("decimal(9,4)"))) * 2, size * (size - 1) * 10_000, 4)
    return (
        cluster_sizes(members)
        .join(weight, "cluster", "left")
        .select("cluster", "size", scaled(F.coalesce(F.least(F.lit(10_000), share), F.lit(0)), 4).alias("density"))
    )


def bridging(inside: DataFrame, config: DetectConfig | None = DetectConfig()) -> DataFrame:
    """Infrastructure nodes holding each cluster together, one row each.

    Only links at or above the minimum weight count; pass None for clusters
    formed without a weight limit.
    """
    if config is not None:
        inside = inside.where(F.col("weight") >= F.lit(config.min_edge_weight))
    return inside.where(F.col("via").isNotNull()).select("cluster", "via").distinct()


def cluster_ids(members: DataFrame, method: str) -> DataFrame:
    """Stable cluster ids: a hash of the method, the size and sums over member hashes.

    Each member's SHA-256 is cut into five whole numbers that are summed per
    cluster.  Sums combine map-side and do not depend on order, so one formula
    serves clusters of any size and no member list is ever brought together.
    """
    parts = [F.conv(F.substring(F.sha2("entity_id", 256), 12 * k + 1, 12), 16, 10).cast("decimal(20,0)") for k in range(5)]
    summed = members.groupBy("cluster").agg(
        F.count("*").alias("size"), *[F.sum(p).cast("string").alias(f"s{k}") for k, p in enumerate(parts)]
    )
    told = F.concat_ws(":", F.lit(method), F.col("size").cast("string"), *[f"s{k}" for k in range(5)])
    return summed.select(
        "cluster", "size", F.concat(F.lit("clu_"), F.substring(F.sha2(told, 256), 1, 20)).alias("cluster_id")
    )


def _join_text(neighbour: Column) -> Column:
    weight = F.format_number(F.col("weight").cast("decimal(9,2)"), 2)
    return F.concat(
        F.col("type"), F.lit(" with "), F.right(neighbour, F.lit(8)), F.lit(" via "),
        F.coalesce(F.right(F.col("via"), F.lit(8)), F.lit("unknown")),
        F.lit(" (weight "), weight, F.lit(")"),
    )


def join_paths(inside: DataFrame, members: DataFrame, config: DetectConfig = DetectConfig()) -> DataFrame:
    """How each member of a component joined: breadth-first from its smallest id.

    The parent is the heaviest link from the previous level, then the smallest
    id and kind.  Levels come from ``hop_levels``; parents are then one
    aggregate over the links between neighbouring levels.
    """
    ways = cut(
        adjacency(inside.where(F.col("weight") >= F.lit(config.min_edge_weight)))
        .join(members.select(F.col("entity_id").alias("node"), "cluster"), "node")
    )
    levels = cut(hop_levels(ways, config.max_group_rows))
    at = levels.select("node", "level")
    by = F.min_by(F.struct("neighbour", "type", "weight", "via"), F.struct(-F.col("weight"), F.col("neighbour"), F.col("type")))
    parents = (
        ways.join(at, "node")
        .join(at.toDF("neighbour", "before"), "neighbour")
        .where(F.col("before") == F.col("level") - 1)
        .groupBy("node").agg(by.alias("by"))
        .select("node", "by.*")
        .select(F.col("node").alias("entity_id"), _join_text(F.col("neighbour")).alias("joined_via"))
    )
    level = F.when(F.col("entity_id") == F.col("cluster"), 0).otherwise(F.col("level")).cast("int")
    seed = F.when(F.col("entity_id") == F.col("cluster"), F.lit("seed"))
    return (
        members.join(at.withColumnRenamed("node", "entity_id"), "entity_id", "left")
        .join(parents, "entity_id", "left")
        .select("cluster", "entity_id", level.alias("level"), F.coalesce(seed, "joined_via").alias("joined_via"))
        .where(F.col("level").isNotNull())
    )


def community_join_paths(inside: DataFrame, members: DataFrame) -> DataFrame:
    """How each member belongs to its community: its smallest link inside it."""
    first = (
        adjacency(inside)
        .groupBy(F.col("node").alias("entity_id"))
        .agg(
            F.min_by(
                F.struct("neighbour", "type", "weight", "via"), F.struct("neighbour", "type")
            ).alias("by")
        )
        .select("entity_id", "by.*")
        .select("entity_id", _join_text(F.col("neighbour")).alias("joined_via"))
    )
    return members.join(first, "entity_id", "left").select(
        "cluster", "entity_id", F.coalesce("joined_via", F.lit("community assignment")).alias("joined_via")
    )
