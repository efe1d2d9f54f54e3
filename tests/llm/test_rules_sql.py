"""The SQL of the quality rules asks what the operator asks, in cases that the given tables lack."""

from __future__ import annotations

import random

import duckdb

from tieline.llm import quality_rules, registry, sql


def test_rules_and_sql_agree_on_languages_and_odd_texts(spark, tmp_path):
    bare = " ".join(f"wort{i}" for i in range(60))
    rows = [
        (1, bare, "xx"), (2, bare, "en"), (3, bare, None), (4, "the " + bare, "de"), (5, None, "en"), (6, "", None),
        (7, " ".join(f"w{i} the" for i in range(1200)), "en"), (8, "one two three four five " * 6, "fr"), (9, "a\n" * 30 + bare, "zz"),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    made = registry.op4(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    told = con.execute(f"SELECT {', '.join(made.columns)} FROM ({sql.ORACLES['op4_quality_rules']})").fetchall()
    assert sorted(map(tuple, made.collect())) == sorted(told)
    assert {r["doc_id"] for r in made.where("kept").collect()} == {1, 3, 4, 7}


def test_windows_are_sorted_by_hash_and_only_recurring_ones_by_words(spark):
    draw = random.Random(5)
    texts = [" ".join(draw.choice("abc") for _ in range(draw.randrange(40))) for _ in range(60)] + ["", None, "x " * 30]

    def brute(text):
        w = (text or "").split()
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        return len({i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(5)})

    told = quality_rules.measures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: r["n_repeat_words"] for r in told.collect()} == {i: brute(t) for i, t in enumerate(texts)}
    # a sort that asks an expression for each pair took most of the operator's time
    assert "array_sort(" not in told._jdf.queryExecution().optimizedPlan().toString()
