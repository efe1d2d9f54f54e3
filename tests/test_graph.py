from __future__ import annotations

import hashlib
import json
import random
from datetime import datetime
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tieline.config import DetectConfig
from tieline.functions.ranking import global_rank, rotate
from tieline.operators import components, links
from tieline.operators.louvain import louvain_communities, rotated_starts
from tieline.operators.overlap import jaccard_arrays, overlaps, stability


def edges_of(spark, rows):
    return spark.createDataFrame(
        [(a, b, "SHARES_DEVICE", Decimal(str(w)), via) for a, b, w, via in rows],
        "src string, dst string, type string, weight decimal(9,4), via string",
    )


def groups(members):
    found = {}
    for row in members.collect():
        found.setdefault(row.cluster, set()).add(row.entity_id)
    return sorted(map(sorted, found.values()))


def clustered(edges, config=DetectConfig()):
    return components.clusters_of(components.connected_components(links.heavy_edges(edges, config)), config)


def random_edges(seed, nodes, count):
    rng = random.Random(seed)
    rows = {}
    for _ in range(count):
        a, b = sorted(rng.sample(range(nodes), 2))
        rows[f"n{a:03d}", f"n{b:03d}"] = round(rng.uniform(0.05, 1), 4)
    return [(a, b, w, f"v{i}") for i, ((a, b), w) in enumerate(rows.items())]


def union_find(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, *_ in rows:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    found = {}
    for node in parent:
        found.setdefault(find(node), []).append(node)
    return sorted(map(sorted, found.values()))


# --- components ------------------------------------------------------------------
def test_components_follow_chains_and_ignore_weak_links(spark):
    # 0.3 is the least weight that counts; the link between the two chains is just below
    rows = [("k", "m", 0.3, "d1"), ("m", "p", 0.95, "d2"), ("p", "t", 0.2999, "a1"), ("t", "w", 0.61, "d3")]
    assert groups(clustered(edges_of(spark, rows))) == [["k", "m", "p"], ["t", "w"]]


def test_component_is_named_by_its_smallest_member(spark):
    rows = clustered(edges_of(spark, [("m", "z", 1, "d"), ("b", "z", 1, "d")])).collect()
    assert {r.cluster for r in rows} == {"b"}


def test_components_do_not_depend_on_direction_or_order(spark):
    rows = [("g", "c", 0.8, "d1"), ("x", "h", 0.33, "d2"), ("h", "u", 0.5, "d3")]
    forward = groups(clustered(edges_of(spark, rows)))
    backward = groups(clustered(edges_of(spark, [(b, a, w, v) for a, b, w, v in reversed(rows)])))
    assert forward == backward


def test_no_edges_give_no_clusters(spark):
    assert clustered(edges_of(spark, [])).count() == 0


@pytest.mark.parametrize("shape", ["random", "path", "star", "shuffled path"])
def test_components_match_union_find(spark, shape):
    if shape == "random":
        rows = random_edges(1, 120, 110)
    else:
        names = [f"n{i:03d}" for i in range(60)]
        if shape == "shuffled path":
            random.Random(3).shuffle(names)
        rows = (
            [("n059", names[i], 1, "v") for i in range(59)] if shape == "star"
            else [(a, b, 1, "v") for a, b in zip(names, names[1:])]
        )
    assert groups(clustered(edges_of(spark, rows), DetectConfig(min_edge_weight=Decimal("0")))) == union_find(rows)


def test_minimum_size(spark):
    rows = [("a", "b", 1, "d"), ("c", "d", 1, "d"), ("d", "e", 1, "d")]
    assert groups(clustered(edges_of(spark, rows), DetectConfig(min_cluster_size=3))) == [["c", "d", "e"]]


def test_join_paths_and_bridges(spark):
    rows = [("a", "b", 0.7, "ent_dev_000dev1"), ("b", "c", 1, "ent_pay_000pay1"), ("a", "c", 0.35, "ent_adr_x"), ("c", "d", 0.4, None)]
    edges = edges_of(spark, rows)
    members = clustered(edges)
    inside = components.intra_edges(edges, members)
    paths = {r.entity_id: (r.level, r.joined_via) for r in components.join_paths(inside, members).collect()}
    assert paths["a"] == (0, "seed")
    assert paths["b"] == (1, "SHARES_DEVICE with a via 000dev1 (weight 0.70)".replace("via 000dev1", "via _000dev1"))
    assert paths["c"][0] == 1 and "with a" in paths["c"][1]
    assert paths["d"] == (2, "SHARES_DEVICE with c via unknown (weight 0.40)")
    assert {r.via for r in components.bridging(inside).collect()} == {"ent_dev_000dev1", "ent_pay_000pay1", "ent_adr_x"}


def test_cluster_id_adds_up_member_hashes(spark):
    names = ["q7", "b", "é"]
    members = clustered(edges_of(spark, [("b", "q7", 1, "d"), ("b", "é", 1, "d")]))
    digests = [hashlib.sha256(n.encode()).hexdigest() for n in names]
    sums = [sum(int(d[12 * k : 12 * k + 12], 16) for d in digests) for k in range(5)]
    text = ":".join(["shared-entity", "3", *map(str, sums)])
    for frame in (members, members.repartition(5)):
        (row,) = components.cluster_ids(frame, "shared-entity").collect()
        assert row.size == 3 and row.cluster_id == "clu_" + hashlib.sha256(text.encode()).hexdigest()[:20]


# --- density -----------------------------------------------------------------------
def density_of(spark, rows):
    edges = edges_of(spark, rows)
    members = clustered(edges)
    return [float(r.density) for r in components.density(components.intra_edges(edges, members), members).collect()]


def test_density(spark):
    mesh = [("a", "b", 1, "d"), ("b", "c", 1, "d"), ("a", "c", 1, "d")]
    assert density_of(spark, mesh) == [1.0]
    assert density_of(spark, mesh[:2]) == [0.6667]
    # parallel and weak links count, the cap holds
    assert density_of(spark, [("a", "b", 1, "d"), ("a", "b", 0.7, "e")]) == [1.0]
    assert density_of(spark, [("a", "b", 0.5, "d"), ("a", "b", 0.1, "e")]) == [0.6]


# --- links ----------------------------------------------------------------------------
def incidences(spark, rows):
    day = lambda text: datetime.fromisoformat(text)
    return spark.createDataFrame(
        [(a, i, k, n, day(f), day(l)) for a, i, k, n, f, l in rows],
        "account string, infra string, kind string, observations bigint, first_seen timestamp, last_seen timestamp",
    )


@pytest.mark.parametrize(
    "windows, expected",
    [
        # windows that share one day; 365 days apart and more; 146 days apart: 1 - 0.75 * 146 / 365
        (("2021-05-05", "2021-05-09", "2021-05-09", "2021-05-30"), 10_000),
        (("2019-02-01", "2019-02-02", "2020-02-02", "2020-02-03"), 2_500),
        (("2018-01-01", "2018-01-10", "2018-06-05", "2018-06-05"), 7_000),
    ],
)
def test_temporal_decay(spark, windows, expected):
    row = spark.createDataFrame([tuple(datetime.fromisoformat(w) for w in windows)], "a timestamp, b timestamp, c timestamp, d timestamp")
    assert row.select(links.overlap_units("a", "b", "c", "d")).first()[0] == expected


def test_decay_just_above_the_floor(spark):
    row = spark.createDataFrame(
        [(datetime(2016, 6, 1), datetime(2016, 6, 2), datetime(2017, 5, 20), datetime(2017, 5, 21))],
        "a timestamp, b timestamp, c timestamp, d timestamp",
    )
    assert 2_500 < row.select(links.overlap_units("a", "b", "c", "d")).first()[0] < 3_000


def test_guard_keeps_two_to_cap_and_reports_the_rest(spark):
    rows = [(f"a{i}", "wide", "DEVICE", 1, "2026-01-01", "2026-01-02") for i in range(6)]
    rows += [("a1", "pair", "PAYMENT", 1, "2026-01-01", "2026-01-02"), ("a2", "pair", "PAYMENT", 2, "2026-01-01", "2026-01-03")]
    rows += [("a3", "own", "DEVICE", 1, "2026-01-01", "2026-01-01")]
    config = DetectConfig(max_accounts_per_node=5)
    seen = incidences(spark, rows)
    kept = links.guarded(seen, config)
    assert {r.infra for r in kept.collect()} == {"pair"}
    assert [(r.infra, r.account_count) for r in links.skipped_nodes(links.fan_out(seen), config).collect()] == [("wide", 6)]
    (edge,) = links.inferred_edges(kept).collect()
    assert (edge.src, edge.dst, edge.type, float(edge.weight), edge.observation_count) == ("a1", "a2", "SHARES_PAYMENT", 1.0, 3)
    assert edge.via == "pair" and edge.derived and "payment pair" in edge.provenance


def test_broadcast_list_of_hot_nodes_leaves_the_result_alone(spark, monkeypatch):
    rows = [(f"a{i}", "wide", "DEVICE", 1, "2026-01-01", "2026-01-02") for i in range(60)]
    rows += [(f"a{i}", f"p{i // 2}", "PAYMENT", 1, "2026-01-01", "2026-01-02") for i in range(60)]
    seen = incidences(spark, rows)
    plain = sorted(map(tuple, links.guarded(seen).collect()))
    monkeypatch.setattr(links, "HOT_SHARE", 3)
    assert sorted(map(tuple, links.guarded(seen).collect())) == plain
    assert len(plain) == 60


def test_heaviest_link_of_a_kind_stands(spark):
    rows = [
        ("a", "v1", "DEVICE", 1, "2026-01-01", "2026-01-01"), ("b", "v1", "DEVICE", 1, "2026-07-01", "2026-07-01"),
        ("a", "v3", "DEVICE", 1, "2026-01-01", "2026-01-01"), ("b", "v3", "DEVICE", 1, "2026-01-01", "2026-01-01"),
        ("a", "v2", "DEVICE", 1, "2026-01-01", "2026-01-01"), ("b", "v2", "DEVICE", 1, "2026-01-01", "2026-01-01"),
    ]
    (edge,) = links.inferred_edges(incidences(spark, rows)).collect()
    assert (edge.via, float(edge.weight)) == ("v2", 0.7)


def test_spanning_links_connect_what_all_pairs_connect(spark):
    rng = random.Random(7)
    rows = []
    for node in range(12):
        kind = rng.choice(["DEVICE", "ADDRESS", "PAYMENT"])
        for account in rng.sample(range(60), rng.randint(2, 9)):
            first = pd.Timestamp("2020-01-01") + pd.Timedelta(days=rng.randint(0, 1500))
            last = first + pd.Timedelta(days=rng.choice([0, 0, 30, 400]))
            rows.append((f"a{account:02d}", f"v{node}", kind, 1, first.isoformat(), last.isoformat()))
    seen = incidences(spark, rows)
    by_pairs = groups(clustered(links.inferred_edges(seen)))
    spanning = links.spanning_links(seen)
    by_span = groups(components.clusters_of(components.connected_components(spanning)))
    assert by_span == by_pairs
    assert spanning.count() <= links.heavy_edges(links.inferred_edges(seen)).count()


def test_orphans_and_fanout(spark):
    accounts = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "id string, entity_id string")
    edges = edges_of(spark, [("a", "b", 1, "v")])
    assert [r.id for r in links.orphans(accounts, edges).collect()] == ["3"]
    fan = spark.createDataFrame([("v", "DEVICE", 2), ("w", "DEVICE", 1)], "infra string, kind string, account_count bigint")
    assert {(r.infra, r.link_count) for r in links.link_fanout(edges, fan).collect()} == {("v", 1), ("w", 0)}
    assert links.adjacency(edges).count() == 2


# --- Louvain ----------------------------------------------------------------------------
def sequential_louvain(rows, passes=20, start=None):
    """Plain restatement over the whole graph, for comparison."""
    near = {}
    for a, b, w, *_ in rows:
        w = round(w * 10_000)
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    order = sorted(near)
    if start is not None:
        order = [n for n in order if n >= start] + [n for n in order if n < start]
    strength = {n: sum(w for _, w in sorted(near[n])) for n in order}
    two_m = sum(strength.values())
    community, total = {n: n for n in order}, dict(strength)
    for _ in range(passes):
        moved = False
        for n in order:
            home = community[n]
            into = {}
            for other, w in sorted(near[n]):
                into[community[other]] = into.get(community[other], 0) + w
            total[home] -= strength[n]
            best, gain = home, into.get(home, 0) * two_m - total[home] * strength[n]
            for c, w in into.items():
                g = w * two_m - total[c] * strength[n]
                if g > gain:
                    best, gain = c, g
            total[best] += strength[n]
            moved |= best != home
            community[n] = best
        if not moved:
            break
    found = {}
    for n, c in community.items():
        found.setdefault(c, []).append(n)
    return sorted(sorted(m) for m in found.values() if len(m) >= 2)


BRIDGED = [
    ("a1", "a2", 1, "da"), ("a2", "a3", 1, "da"), ("a1", "a3", 1, "da"),
    ("b1", "b2", 1, "db"), ("b2", "b3", 1, "db"), ("b1", "b3", 1, "db"), ("a1", "b1", 0.05, "x"),
]


def test_louvain_cuts_a_weak_bridge(spark):
    assert groups(louvain_communities(edges_of(spark, BRIDGED))) == [["a1", "a2", "a3"], ["b1", "b2", "b3"]]


def test_louvain_without_edges(spark):
    assert louvain_communities(edges_of(spark, [])).count() == 0


@pytest.mark.parametrize("seed, start", [(1, None), (2, "n020"), (5, "n033")])
def test_louvain_packs_match_one_sequential_pass(spark, seed, start):
    rows = random_edges(seed, 45, 70)
    assert groups(louvain_communities(edges_of(spark, rows), start=start)) == sequential_louvain(rows, start=start)


def test_louvain_by_joins_matches_the_sequential_visit(spark):
    rows = random_edges(11, 14, 18)
    by_joins = DetectConfig(max_group_rows=1)
    assert groups(louvain_communities(edges_of(spark, rows), by_joins, "n005")) == sequential_louvain(rows, start="n005")


def jobs_of(spark, work):
    context = spark.sparkContext
    context.setJobGroup("counted", "counted")
    before = len(context.statusTracker().getJobIdsForGroup("counted"))
    result = work()
    context.setLocalProperty("spark.jobGroup.id", None)
    return result, len(context.statusTracker().getJobIdsForGroup("counted")) - before


def test_runs_of_one_graph_are_found_together(spark, monkeypatch):
    from tieline.operators import louvain

    rows = random_edges(3, 45, 70)
    edges = edges_of(spark, rows)
    calls = []
    real = louvain.connected_components
    monkeypatch.setattr(louvain, "connected_components", lambda e: calls.append(1) or real(e))
    starts = [None, "n011", "n020", "n033"]
    found, four = jobs_of(spark, lambda: louvain.louvain_runs(edges, DetectConfig(), starts).collect())
    _, single = jobs_of(spark, lambda: louvain.louvain_runs(edges, DetectConfig(), [None]).collect())
    assert len(calls) == 2 and four <= single + 2
    for run, start in enumerate(starts):
        got = {}
        for r in found:
            if r.run == run:
                got.setdefault(r.cluster, []).append(r.entity_id)
        assert sorted(sorted(m) for m in got.values()) == sequential_louvain(rows, start=start)
    assert all(r.converged for r in found)


@pytest.mark.parametrize("limit", [200_000, 1])
def test_a_run_out_of_passes_is_told(spark, limit):
    from tieline.operators.louvain import louvain_runs

    config = DetectConfig(louvain_passes=1, max_group_rows=limit)
    apart = [("y1", "y2", 1, "dz")]
    found = louvain_runs(edges_of(spark, BRIDGED + apart), config, [None]).collect()
    # the first pass always moves somebody, so no component can be known to be at rest
    assert {"a2", "a3", "b2", "b3", "y1", "y2"} <= {r.entity_id for r in found} and not any(r.converged for r in found)


def test_dense_component_ends(spark):
    from tieline.operators.louvain import louvain_runs

    n = 1000
    names = spark.range(n).select(F.format_string("n%04d", "id").alias("src"))
    pairs = names.join(names.select(F.col("src").alias("dst")), F.col("src") < F.col("dst")).select(
        "src", "dst", F.lit("SHARES_DEVICE").alias("type"), F.lit(1).cast("decimal(9,4)").alias("weight"), F.lit("v").alias("via")
    ).where((F.xxhash64("src", "dst") % 3) == 0)
    found = louvain_runs(pairs, DetectConfig(), [None])
    assert found.count() == n and found.where("converged is null").count() == 0


# --- join paths -----------------------------------------------------------------------
def breadth_first(rows, root):
    near = {}
    for a, b, *_ in rows:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    level, queue = {root: 0}, [root]
    for node in queue:
        for other in sorted(near[node]):
            if other not in level:
                level[other] = level[node] + 1
                queue.append(other)
    return level


def test_long_chain_needs_no_round_a_level(spark):
    rows = [(f"n{i:04d}", f"n{i + 1:04d}", 1, "v") for i in range(4_999)]
    inside = edges_of(spark, rows).withColumn("cluster", F.lit("n0000"))
    members = spark.range(5_000).select(F.lit("n0000").alias("cluster"), F.format_string("n%04d", "id").alias("entity_id"))
    found, jobs = jobs_of(spark, lambda: components.join_paths(inside, members).collect())
    assert jobs <= 30 and len(found) == 5_000
    assert all(r.level == int(r.entity_id[1:]) for r in found)


@pytest.mark.parametrize("seed", [4])
def test_contracted_components_keep_their_levels(spark, seed):
    from tieline.operators.levels import hop_levels

    rng = random.Random(seed)
    names = [f"n{i:03d}" for i in range(120)]
    rows = [(names[rng.randrange(max(0, i - 12), i)], names[i]) for i in range(1, 90)]
    rows += [(names[i], names[i + 1]) for i in range(89, 119)]
    rows += [tuple(sorted(rng.sample(names[:90], 2))) for _ in range(12)]
    core = [("n000", f"x{i}") for i in range(6)] + [(f"x{i}", f"x{j}") for i in range(6) for j in range(i)]
    links = spark.createDataFrame(
        [("n000", a, b) for a, b in rows + core] + [("n000", b, a) for a, b in rows + core], "cluster string, node string, neighbour string"
    )
    want = breadth_first(rows + core, "n000")
    for limit in (60, 100_000):
        got = hop_levels(links, limit).collect()
        assert len(got) == len(want) and {r.node: r.level for r in got} == want


def test_community_join_paths(spark):
    edges = edges_of(spark, BRIDGED)
    members = louvain_communities(edges)
    paths = components.community_join_paths(components.intra_edges(edges, members), members)
    assert all(r.joined_via.startswith("SHARES_DEVICE with ") for r in paths.collect())


# --- overlap ------------------------------------------------------------------------------
def test_jaccard(spark):
    frame = spark.createDataFrame(
        [(["a", "b"], ["b", "a"]), (["a"], ["b"]), (["a", "b", "c"], ["b", "c", "d"]), ([], [])],
        "a array<string>, b array<string>",
    )
    assert [float(r[0]) for r in frame.select(jaccard_arrays(F.col("a"), F.col("b"))).collect()] == [1, 0, 0.5, 1]


def members_of(spark, found):
    return spark.createDataFrame(
        [(c, m) for c, group in found.items() for m in group], "cluster string, entity_id string"
    )


def test_stability(spark):
    pair = members_of(spark, {"a": ["a", "b"]})

    def mean(*runs):
        tagged = [(n, c, m) for n, run in enumerate(runs) for c, group in run.items() for m in group]
        frame = spark.createDataFrame(tagged, "run int, cluster string, entity_id string")
        return float(stability(pair, frame, len(runs)).first().stability)

    same, split, elsewhere = {"a": ["a", "b"]}, {"a": ["a"]}, {"x": ["x", "y"]}
    assert [mean(same, same), mean(split), mean(same, elsewhere), mean()] == [1, 0.5, 0.5, 1]


def test_overlaps_only_compare_groups_that_meet(spark):
    left = spark.createDataFrame([("r", "a"), ("r", "b"), ("s", "z")], "group string, member string")
    right = spark.createDataFrame([("c", "b"), ("c", "d"), ("e", "q")], "group string, member string")
    (row,) = overlaps(left, right).collect()
    assert (row.left_group, row.right_group, float(row.overlap)) == ("r", "c", 0.3333)


# --- order ----------------------------------------------------------------------------------
def test_global_rank_and_rotation(spark):
    names = [f"n{i:03d}" for i in range(200)]
    shuffled = names[:]
    random.Random(1).shuffle(shuffled)
    frame = spark.createDataFrame([(n,) for n in shuffled], "entity_id string").repartition(7)
    ranked = global_rank(frame, "entity_id")
    assert {r.entity_id: r["rank"] for r in ranked.collect()} == {n: i for i, n in enumerate(names)}
    turned = ranked.withColumn("turned", rotate(F.col("rank"), F.lit(50), F.lit(200)))
    assert [r.entity_id for r in turned.orderBy("turned").collect()] == names[50:] + names[:50]
    assert rotated_starts(frame, 3) == ["n050", "n100", "n150"]
