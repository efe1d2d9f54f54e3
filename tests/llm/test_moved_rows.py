"""Which rows move, and what is made once: results beside plain restatements."""

from __future__ import annotations

from itertools import product

import numpy as np
import pytest

from tieline.functions.lineage import application_dir, cut, cut_by, scratch
from tieline.llm import exact_dedup, mixing, ngram_join
from tieline.llm.text import told_apart


def test_told_apart_moves_no_row(spark):
    rows = spark.createDataFrame([(k if k % 7 else None, "t" * k) for k in range(300)], "id bigint, text string")
    wanted = spark.createDataFrame([(k,) for k in (3, 5, 250, 999)] + [(None,)], "id bigint")
    some, rest = told_apart(rows, "id", wanted)
    assert some.columns == rest.columns == rows.columns
    assert sorted(map(str, some.union(rest).collect())) == sorted(map(str, rows.collect()))
    left = {r["id"] for r in rest.select("id").collect()}
    assert not left & {3, 5, 250, None} and len(left) > 200
    assert "hashpartitioning" not in rest._jdf.queryExecution().executedPlan().toString()


def test_texts_without_copies_stay_in_place(spark):
    rows = [(k, f"text {k}") for k in range(40)] + [(k, "twice") for k in range(40, 50)] + [(7, "text 7")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = exact_dedup.drop_exact_copies(docs, keep="largest")
        plan = kept._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(tuple, kept.collect())) == sorted([*rows[:40], (49, "twice")])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Union" in plan  # rows that no dropped id names are not joined


def test_trees_meet_every_asking_pair_once(spark):
    held = [(cell, 10 * cell + k, 20 + k) for cell in (1, 2) for k in range(6)] + [(3, 10 * k + 1, 5) for k in (1, 2)]
    groups = [(10, 10), (11, 10), (12, 10), *((20 + k, 20) for k in range(6))]
    frame = lambda data, schema: spark.createDataFrame(data, schema)
    shapes = frame([(d, n, bytes([n])) for _, d, n in held if d >= 10], "doc bigint, n bigint, counts binary").dropDuplicates(["doc"])
    made = ngram_join._split(frame(held, "cell bigint, doc bigint, n bigint"), frame(groups, "node bigint, component bigint"), shapes, 2)
    rows = made.collect()
    met = [
        (a["cell"], a["doc"], b["doc"]) for a, b in product(rows, rows)
        if a["side"] == 0 and b["side"] == 1 and (a["cell"], a["i"], a["j"]) == (b["cell"], b["i"], b["j"])
    ]
    # cell 2 is of one component, cell 3 has two members
    assert sorted(met) == sorted((1, a, b) for a in (13, 14, 15) for b in range(10, 16))
    assert {(r["doc"], bytes(r["counts"])) for r in rows} == {(d, bytes([n])) for c, d, n in held if c == 1}


def test_wide_cells_are_told_once(spark):
    rows = [(1, k, 9, place) for place, k in enumerate((5, 6, 7, 7, 8))] + [(2, k, 9, place) for place, k in enumerate((5, 6, 7))]
    members = spark.createDataFrame(rows, "cell bigint, doc bigint, n bigint, place bigint")
    assert sorted(map(tuple, ngram_join._wide_cells(members).collect())) == [(1, k, 9) for k in (5, 6, 7, 8)]


def test_cells_keep_members_that_may_link(spark):
    """Cells of few members are told as by comparing all; larger ones pass whole, over batches of any size."""
    random = np.random.default_rng(3)
    entries, cells = [], {}
    for cell, size in enumerate([1, 2, 3, 5, 8, 40, 64, 65, 200, 2, 2] * 6):
        for doc in random.choice(10_000, size, replace=False).tolist():
            n = int(random.integers(5, 400))
            entries.append((cell, doc, n, int(random.integers(0, n // 4 + 1))))
            cells.setdefault(cell, []).append(entries[-1][1:])
    # the first shingle in common is the p-th of both, so this many can be in common at most; p is told in 256ths
    left = lambda a: a[1] - -(-(a[2] * 256 // a[1]) * a[1] // 256)
    may = lambda a, b: 175 * min(left(a), left(b)) >= 75 * (a[1] + b[1])
    able = lambda rows: [a for a in rows if len(rows) > ngram_join.LARGE or any(may(a, b) for b in rows if a != b)]
    want = {c: {a[0]: a for a in able(rows)} for c, rows in cells.items()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in ("7", "1000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            found = ngram_join.cell_members(spark.createDataFrame(entries, "cell bigint, doc bigint, n bigint, p int")).collect()
            assert sorted((r["cell"], r["doc"]) for r in found) == sorted((c, d) for c, rows in want.items() for d in rows if len(rows) > 1)
            assert len(found) < len(entries)
            at = {(r["cell"], r["place"]): r["doc"] for r in found}
            for r in found:
                rows = want[r["cell"]]
                assert r["first"] == at[r["cell"], 0] and r["before"] == at[r["cell"], max(r["place"] - 1, 0)]
                for other in ("before", "first"):
                    if r["place"]:
                        assert r[f"fits_{other}"] == may(rows[r["doc"]], rows[r[other]])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_only_points_with_more_candidates_ask_again(spark):
    frame = lambda data, schema: spark.createDataFrame(data, schema)
    held = frame([(cell, 10 * cell + k, 20 + k) for cell in (1, 2) for k in range(6)], "cell bigint, doc bigint, n bigint")
    found = frame([(None, 10, 11), (1, 12, None), (1, 15, None)], "cell bigint, a bigint, b bigint")
    again = ngram_join._again(held, found)
    assert sorted(map(tuple, again.collect())) == [(1, 10 + k, 20 + k, k in (2, 5)) for k in range(6)]
    shapes = frame([(10 + k, 20 + k, bytes([k])) for k in range(6)], "doc bigint, n bigint, counts binary")
    groups = frame([(10, 10), (11, 10), (12, 10)], "node bigint, component bigint")
    rows = ngram_join._split(again, groups, shapes, 2).collect()
    # also the largest component's, as it may have grown since
    assert {r["doc"] for r in rows if r["side"] == 0} == {12, 15}
    met = {(a["doc"], b["doc"]) for a, b in product(rows, rows) if (a["side"], b["side"]) == (0, 1) and (a["i"], a["j"]) == (b["i"], b["j"])}
    assert met == set(product((12, 15), range(10, 16)))


def test_tables_of_the_way_go_when_the_result_is_written(spark):
    folder = spark._jvm.java.io.File(spark._jvm.org.apache.hadoop.fs.Path(application_dir(spark)).toUri().getPath())
    held = lambda: set(folder.list() or ())
    docs = spark.createDataFrame([(k, f"w{k // 2} b c d e f g h i j k l", "s") for k in range(40)], "doc_id long, text string, source string")
    before = held()
    groups = ngram_join.near_groups(docs)
    assert len(held() - before) == 2  # members and components
    assert len(groups.collect()) == 40
    before = held()
    mix = mixing.mixed_documents(docs)
    assert len(held() - before) == 2  # rows and plan
    assert mix.count() >= 40
    with pytest.raises(ValueError), scratch(spark) as kept:
        outer = kept(cut(docs))
        cut_by(docs, "doc_id")
        raise ValueError
    assert outer.count() == 40 and not any(t.name.count("_") > 2 for t in spark.catalog.listTables(pattern="tieline_by_*"))
