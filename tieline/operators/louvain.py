"""Louvain communities: one level of local moves in a fixed node order.

Nodes are visited by id (or by id from a given start onwards, then from the
beginning), and each joins the neighbouring community with the largest
modularity gain until nothing moves or the pass limit is reached.  Weights are
whole ten-thousandths, so gains are compared exactly.

A move depends on the total weight of the graph and otherwise only on
communities next to the node.  Components are therefore independent and are
packed into groups of bounded size for the sequential visit; a component too
large for one group is visited by joins instead, many nodes at a time, with the
same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieline.config import DetectConfig
from tieline.functions.fixed import units
from tieline.functions.lineage import cut
from tieline.functions.ranking import global_rank
from tieline.operators.components import connected_components
from tieline.operators.levels import packed
from tieline.operators.links import adjacency

_VISITED = "run int, node string, community string, converged boolean"


def rotated_starts(accounts: DataFrame, runs: int) -> list[str]:
    """First node of each of ``runs`` rotations spread evenly over the account order."""
    ranked = global_rank(accounts.select("entity_id"), "entity_id")
    total = ranked.count()
    shifts = [total * i // (runs + 1) for i in range(1, runs + 1)]
    found = {r["rank"]: r["entity_id"] for r in ranked.where(F.col("rank").isin(shifts)).collect()}
    return [found[s] for s in shifts if s in found]


def _turn(node: Column, start: str | None) -> Column:
    """Sorts before everything else when the node is visited in the first stretch."""
    return F.lit(0) if start is None else F.when(node >= F.lit(start), 0).otherwise(1)


def louvain_communities(
    edges: DataFrame, config: DetectConfig = DetectConfig(), start: str | None = None
) -> DataFrame:
    """(cluster, entity_id) of the communities of at least the minimum size.

    A community is named by its smallest member.  ``start`` rotates the order.
    """
    return louvain_runs(edges, config, [start]).select("cluster", "entity_id")


def louvain_runs(edges: DataFrame, config: DetectConfig, starts: list[str | None]) -> DataFrame:
    """(run, cluster, entity_id, converged): one run for each start, over one adjacency.

    Components and links are found and dealt once; a task visits each of its
    components once a run.  ``converged`` tells, for the component a community
    lies in, whether a pass without a move came within the pass limit.
    """
    ways = adjacency(edges).select("node", "neighbour", "type", units(F.col("weight")).alias("weight"))
    ways = cut(
        ways.join(connected_components(edges), "node").select("component", "node", "neighbour", "type", "weight")
    )
    sizes = cut(ways.groupBy("component").agg(F.count("*").alias("rows"), F.sum("weight").alias("weight")))
    totals = sizes.agg(F.sum("rows").alias("rows"), F.sum("weight").alias("weight")).first()
    if not totals["weight"]:
        none = F.lit(0).alias("run"), F.col("component").alias("cluster"), F.col("node").alias("entity_id"), F.lit(True).alias("converged")
        return ways.select(*none).limit(0)

    limit = config.max_group_rows
    small = sizes.where(F.col("rows") <= limit).select("component")
    dealt = packed(ways.join(small, "component", "left_semi"), "component", limit, totals["rows"])
    visit = _sequential(int(totals["weight"]), config.louvain_passes, starts)
    assigned = dealt.groupBy("pack").applyInPandas(visit, _VISITED)

    large = sizes.where(F.col("rows") > limit)
    if not large.isEmpty():
        wide = cut(ways.join(large.select("component"), "component", "left_semi"))
        for run, start in enumerate(starts):
            assigned = assigned.union(_by_joins(wide, int(totals["weight"]), config.louvain_passes, start, run))

    assigned = cut(assigned)
    named = assigned.groupBy("run", "community").agg(F.min("node").alias("cluster"), F.count("*").alias("size"))
    return cut(
        assigned.join(named.where(F.col("size") >= config.min_cluster_size), ["run", "community"]).select(
            "run", "cluster", F.col("node").alias("entity_id"), "converged"
        )
    )


def _sequential(two_m: int, passes: int, starts: list[str | None]):
    """The visits over one group of whole components, component by component."""

    def one(order: list[str], links: dict[str, list[tuple[str, int]]], strength: dict[str, int]) -> tuple[dict[str, str], bool]:
        community = {n: n for n in order}
        total = {n: strength[n] for n in order}
        for _ in range(passes):
            moved = False
            for node in order:
                home, own = community[node], strength[node]
                into: dict[str, int] = {}
                for neighbour, weight in links[node]:
                    c = community[neighbour]
                    into[c] = into.get(c, 0) + weight
                total[home] -= own
                best, gain = home, into.get(home, 0) * two_m - total[home] * own
                for candidate, weight in into.items():
                    g = weight * two_m - total[candidate] * own
                    if g > gain:
                        best, gain = candidate, g
                total[best] += own
                if best != home:
                    community[node] = best
                    moved = True
            if not moved:
                return community, True
        return community, False

    def visit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["node", "neighbour", "type"], kind="stable")
        links: dict[str, list[tuple[str, int]]] = {}
        inside: dict[str, list[str]] = {}
        for component, node, neighbour, weight in zip(rows["component"], rows["node"], rows["neighbour"], rows["weight"]):
            if node not in links:
                inside.setdefault(component, []).append(node)
            links.setdefault(node, []).append((neighbour, int(weight)))
        strength = {n: sum(w for _, w in near) for n, near in links.items()}
        found = []
        for run, start in enumerate(starts):
            for nodes in inside.values():
                order = nodes if start is None else sorted(nodes, key=lambda n: (n < start, n))
                community, converged = one(order, links, strength)
                found += [(run, n, community[n], converged) for n in order]
        return pd.DataFrame(found, columns=["run", "node", "community", "converged"])

    return visit


def _by_joins(ways: DataFrame, two_m: int, passes: int, start: str | None, run: int) -> DataFrame:
    """The same visit for components of any size.

    A node reads and writes only the communities it touches: its own and its
    neighbours'.  A node that comes first among the nodes still to be visited at
    every community it touches can move now, because no earlier node can alter
    them; all such nodes touch different communities and move together.
    """
    position = lambda node: F.struct(_turn(node, start).alias("turn"), node.alias("node"))
    strength = ways.groupBy("node").agg(F.sum("weight").alias("strength"))
    state = cut(strength.select("node", "strength", F.col("node").alias("community")))
    exact = lambda c: c.cast("decimal(38,0)")
    restless = None
    for _ in range(passes):
        waiting = cut(state.select("node"))
        at_start = state
        while not waiting.isEmpty():
            totals = state.groupBy("community").agg(F.sum("strength").alias("total"))
            near = (
                ways.join(waiting, "node", "left_semi")
                .join(state.select(F.col("node").alias("neighbour"), "community"), "neighbour")
                .groupBy("node", "community")
                .agg(
                    F.sum("weight").alias("into"),
                    F.min(F.struct("neighbour", "type")).alias("seen"),
                )
            )
            home = state.join(waiting, "node", "left_semi").select("node", "community")
            touched = near.select("node", "community").union(home).distinct()
            first = touched.groupBy("community").agg(F.min(position(F.col("node")))["node"].alias("first"))
            blocked = (
                touched.join(first, "community").where(F.col("first") != F.col("node")).select("node").distinct()
            )
            ready = cut(waiting.join(blocked, "node", "left_anti"))
            own = state.join(ready, "node", "left_semi").select(
                "node", "strength", F.col("community").alias("home")
            )
            options = (
                near.select("node", "community", "into", F.lit(1).alias("away"), "seen")
                .unionByName(
                    home.select("node", "community", F.lit(0).cast("bigint").alias("into"), F.lit(1).alias("away"))
                    .withColumn("seen", F.lit(None).cast("struct<neighbour:string,type:string>"))
                )
                .groupBy("node", "community")
                .agg(F.sum("into").alias("into"), F.min("seen").alias("seen"))
                .join(own, "node")
                .join(totals, "community")
            )
            is_home = F.col("community") == F.col("home")
            rest = exact(F.col("total")) - F.when(is_home, exact(F.col("strength"))).otherwise(F.lit(0))
            gain = exact(F.col("into")).cast("decimal(19,0)") * F.lit(two_m).cast("decimal(19,0)") - rest.cast(
                "decimal(19,0)"
            ) * F.col("strength").cast("decimal(19,0)")
            # largest gain; staying wins a tie, then the community met first
            chosen = options.groupBy("node").agg(
                F.min_by("community", F.struct((-gain).alias("loss"), (~is_home).alias("leaves"), "seen")).alias("to")
            )
            state = cut(
                state.join(chosen, "node", "left").select(
                    "node", "strength", F.coalesce("to", "community").alias("community")
                )
            )
            waiting = cut(waiting.join(ready, "node", "left_anti"))
        changed = state.join(at_start.select("node", F.col("community").alias("was")), "node").where(
            F.col("community") != F.col("was")
        )
        restless = cut(changed.join(ways.select("component", "node").distinct(), "node").select("component").distinct())
        if restless.isEmpty():
            break
    homes = ways.select("component", "node").distinct()
    moving = homes.join(restless.withColumn("converged", F.lit(False)), "component", "left").select("node", "converged")
    return state.join(moving, "node").select(
        F.lit(run).alias("run"), "node", "community", F.coalesce("converged", F.lit(True)).alias("converged")
    )
