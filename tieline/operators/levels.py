"""Distance in hops of every member of a component from its smallest id.

Whole components are packed into tasks and searched breadth-first there.  A
component with more links than a task may take is contracted first: members with
at most two neighbours are taken out, as many at a time as have no neighbour
taken out with them, and their two links become one of the summed length, so
distances among the rest stay.  Long chains and trees shrink by a constant share
a round and never cost a round per level.  Members taken out get their levels
from their neighbours, last out first in.  What still does not fit, because
everyone in it has three neighbours or more, is relaxed link by link; such
graphs are shallow for their size.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieline.functions.lineage import cut

_LEVELS = "cluster string, node string, level bigint"


def packed(rows: DataFrame, key: str, limit: int, total: int) -> DataFrame:
    """Add ``pack``: whole groups of ``key`` dealt to tasks of about a quarter of ``limit`` rows."""
    packs = max(1, -(-total // limit) * 4)
    return rows.withColumn("pack", F.pmod(F.xxhash64(key), F.lit(packs)))


def hop_levels(links: DataFrame, limit: int) -> DataFrame:
    """(cluster, node, level) from links (cluster, node, neighbour), each from both ends.

    A cluster's id is the id of the member that levels count from.
    """
    links = cut(links.select("cluster", "node", "neighbour").distinct().withColumn("hops", F.lit(1).cast("bigint")))
    sizes = links.groupBy("cluster").agg(F.count("*").alias("rows"))
    told = sizes.agg(F.max("rows").alias("most"), F.sum("rows").alias("total")).first()
    if not told["total"]:
        return links.select("cluster", "node", F.col("hops").alias("level")).limit(0)
    if told["most"] <= limit:
        return _searched(links, limit, told["total"])
    wide = sizes.where(F.col("rows") > limit).select("cluster")
    narrow = _searched(links.join(wide, "cluster", "left_anti"), limit, told["total"])
    return cut(narrow.unionByName(_contracted(cut(links.join(wide, "cluster", "left_semi")), limit)))


def _searched(links: DataFrame, limit: int, total: int) -> DataFrame:
    def search(rows: pd.DataFrame) -> pd.DataFrame:
        near: dict[str, list[tuple[str, int]]] = {}
        home: dict[str, str] = {}
        for cluster, node, neighbour, hops in zip(rows["cluster"], rows["node"], rows["neighbour"], rows["hops"]):
            near.setdefault(node, []).append((neighbour, int(hops)))
            home[node] = cluster
        level = {c: 0 for c in set(home.values())}
        queue = [(0, c) for c in sorted(level)]
        while queue:
            far, node = heapq.heappop(queue)
            if far > level[node]:
                continue
            for neighbour, hops in near.get(node, ()):
                if far + hops < level.get(neighbour, far + hops + 1):
                    level[neighbour] = far + hops
                    heapq.heappush(queue, (far + hops, neighbour))
        found = [(home.get(node, node), node, far) for node, far in level.items()]
        return pd.DataFrame(found, columns=["cluster", "node", "level"])

    return packed(links, "cluster", limit, total).groupBy("pack").applyInPandas(search, _LEVELS)


def _contracted(links: DataFrame, limit: int) -> DataFrame:
    taken: list[DataFrame] = []
    while True:
        over = links.groupBy("cluster").agg(F.count("*").alias("rows")).where(F.col("rows") > limit)
        if over.isEmpty():
            break
        turn = len(taken)
        order = lambda name: F.struct(F.xxhash64(F.lit(turn), name).alias("hash"), F.col(name).alias("id"))
        way = F.struct("neighbour", "hops")
        few = (
            links.groupBy("cluster", "node")
            .agg(F.count("*").alias("ways"), F.min(way).alias("a"), F.max(way).alias("b"))
            .where((F.col("ways") <= 2) & (F.col("node") != F.col("cluster")))
        )
        few = cut(few)
        beside = (
            links.join(few.select("node"), "node", "left_semi")
            .join(few.select(F.col("node").alias("neighbour")), "neighbour", "left_semi")
            .groupBy("node")
            .agg(F.min(order("neighbour")).alias("first"))
        )
        gone = few.join(beside, "node", "left").where(F.col("first").isNull() | (order("node") < F.col("first"))).drop("first")
        gone = cut(gone)
        if gone.isEmpty():
            break
        taken.append(gone)
        names = gone.select("node")
        left = links.join(names, "node", "left_anti").join(names.toDF("neighbour"), "neighbour", "left_anti")
        bridge = gone.where(F.col("ways") == 2).select("cluster", "a", "b", (F.col("a.hops") + F.col("b.hops")).alias("hops"))
        there = bridge.select("cluster", F.col("a.neighbour").alias("node"), F.col("b.neighbour").alias("neighbour"), "hops")
        back = there.select("cluster", F.col("neighbour").alias("node"), F.col("node").alias("neighbour"), "hops")
        links = cut(
            left.select("cluster", "node", "neighbour", "hops").union(there).union(back)
            .groupBy("cluster", "node", "neighbour").agg(F.min("hops").alias("hops"))
        )
    sizes = links.groupBy("cluster").agg(F.count("*").alias("rows"))
    fits = sizes.where(F.col("rows") <= limit).select("cluster")
    total = links.count()
    levels = _searched(links.join(fits, "cluster", "left_semi"), limit, total)
    if taken:
        # nobody but the first member may be left of a cluster
        alone = taken[0].select("cluster").distinct().join(links.select("cluster"), "cluster", "left_anti")
        levels = levels.union(alone.select("cluster", F.col("cluster").alias("node"), F.lit(0).cast("bigint").alias("level")))
    levels = cut(levels.union(_relaxed(links.join(fits, "cluster", "left_anti"))))
    for gone in reversed(taken):
        at = levels.select("node", "level")
        by = lambda side: gone.select("cluster", "node", F.col(f"{side}.neighbour").alias("by"), F.col(f"{side}.hops").alias("hops"))
        found = (
            by("a").union(by("b")).join(at.toDF("by", "level"), "by")
            .groupBy("cluster", "node").agg(F.min(F.col("level") + F.col("hops")).alias("level"))
        )
        levels = cut(levels.union(found))
    return levels


def _relaxed(links: DataFrame) -> DataFrame:
    links = cut(links)
    levels = changed = cut(links.where(F.col("node") == F.col("cluster")).select("cluster", "node", F.lit(0).cast("bigint").alias("level")).distinct())
    while not changed.isEmpty():
        reached = links.join(changed.select("node", "level"), "node").select(
            "cluster", F.col("neighbour").alias("node"), (F.col("level") + F.col("hops")).alias("level")
        )
        best = reached.groupBy("cluster", "node").agg(F.min("level").alias("level"))
        before = levels.select("node", F.col("level").alias("before"))
        changed = cut(best.join(before, "node", "left").where(F.col("before").isNull() | (F.col("level") < F.col("before"))).drop("before"))
        levels = cut(levels.union(changed.select(*levels.columns)).groupBy("cluster", "node").agg(F.min("level").alias("level")))
    return levels
