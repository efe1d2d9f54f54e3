"""Overlap of groups of members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieline.functions.fixed import half_up, ratio, scaled, units
from tieline.functions.skew import attach


def jaccard_arrays(a: Column, b: Column) -> Column:
    """Jaccard of two member arrays, four decimals; two empty arrays are alike."""
    common = F.size(F.array_intersect(a, b)).cast("bigint")
    either = F.size(F.array_union(a, b)).cast("bigint")
    one = F.lit(1).cast("decimal(9,4)")
    return F.coalesce(ratio(common, either), one)


def overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """Jaccard of every pair of groups that share a member.

    Both sides are (group, member) relations; the result has one row per pair
    (left_group, right_group).  Pairs are found by joining on the member, so
    groups with nothing in common are never compared.
    """
    l = left.select(F.col("group").alias("left_group"), "member").distinct()
    r = right.select(F.col("group").alias("right_group"), "member").distinct()
    l_size = l.groupBy("left_group").agg(F.count("*").alias("left_size"))
    r_size = r.groupBy("right_group").agg(F.count("*").alias("right_size"))
    common = l.join(r, "member").groupBy("left_group", "right_group").agg(F.count("*").alias("common"))
    either = F.col("left_size") + F.col("right_size") - F.col("common")
    # a group that meets very many others must not gather them in one task
    return attach(attach(common, l_size, "left_group", "right_group"), r_size, "right_group", "left_group").select(
        "left_group", "right_group", "left_size", "right_size", "common",
        ratio(F.col("common"), either).alias("overlap"),
    )


def stability(members: DataFrame, runs: DataFrame, count: int) -> DataFrame:
    """Mean over ``count`` perturbed runs of each cluster's best overlap; a run without any counts 0.

    ``runs`` has (run, cluster, entity_id); the run is part of the group, so one
    join serves all of them.
    """
    groups = members.select(F.col("cluster").alias("group"), F.col("entity_id").alias("member"))
    clusters = members.select("cluster").distinct()
    if not count:
        return clusters.withColumn("stability", F.lit(1).cast("decimal(9,4)"))
    tagged = runs.select(F.struct("run", "cluster").alias("group"), F.col("entity_id").alias("member"))
    best = (
        overlaps(groups, tagged)
        .groupBy(F.col("left_group").alias("cluster"), "right_group.run")
        .agg(F.max("overlap").alias("best"))
        .groupBy("cluster")
        .agg(F.sum("best").alias("total"))
    )
    mean = scaled(half_up(units(F.coalesce("total", F.lit(0).cast("decimal(9,4)"))), count), 4)
    return clusters.join(best, "cluster", "left").select("cluster", mean.alias("stability"))
