"""Operators of built-in functions only, against plain restatements on odd tables."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tieline.functions.lineage import cut
from tieline.llm import exact_dedup, mixing, quality_rules, registry, sharding, sql

QUERIES = registry.queries()


@pytest.fixture(scope="module")
def docs(spark):
    return brute.odd_documents(spark).cache()


def test_quality_counts(docs):
    found = {}
    for r in quality_rules.judge(docs).collect():
        found[r["doc_id"]] = r
    for i, text, _ in brute.rows_of(docs):
        w, r = brute.WORD.findall(text), found[i]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), brute.repeated_lines(text), brute.repeated_words(w))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, i
        base = len(w) < 10 or 100 * want[4] > 20 * len(w)
        assert r["base_failed"] == base
        assert r["kept"] == (not r["failed_rules"] and not base)
        assert r["n_stop_words"] == sum(x.translate(brute.LOWER) in quality_rules.STOP_WORDS for x in w)


def test_a_failing_hash_still_counts_right(spark):
    """Windows are compared by their words, not by the hash that only picks texts."""
    docs = spark.createDataFrame([(1, "a b c d e f g a b c d e z")], "id int, t string")
    w = F.split("t", " ")
    same = F.transform(F.sequence(F.lit(1), F.size(w) - 4), lambda _: F.lit(7).cast("bigint"))
    assert docs.select(quality_rules.repeat_words(w, same)).first()[0] == 10


def test_quality_filter_keeps_columns(docs):
    kept = quality_rules.drop_poor(docs)
    assert kept.columns == docs.columns
    want = Counter(r["doc_id"] for r in quality_rules.judge(docs).where("kept").collect())
    assert Counter(r["doc_id"] for r in kept.select("doc_id").collect()) == want


def test_quality_counts_leave_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "some words here", "a", "b", "c")], "doc_id long, text string, _w string, _lines string, _h string")
    row = quality_rules.judge(docs).first()
    assert (row["_w"], row["_lines"], row["_h"], row["n_words"]) == ("a", "b", "c", 3)
    assert quality_rules.judge(docs).columns[:5] == docs.columns


def test_clean_texts_in_other_languages(spark):
    other = " ".join(f"kissa{i} istuu{i * 3} puussa{i * 5}" for i in range(30))
    rows = [(2, "fi", other), (3, None, other), (4, "en", other)]
    frame = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    kept = quality_rules.drop_poor(frame, lang="lang").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in kept) == [2, 3]
    failed = {r["doc_id"]: r["failed_rules"] for r in quality_rules.judge(frame).select("doc_id", "failed_rules").collect()}
    assert failed == {i: ["stop words per word"] for i in (2, 3, 4)}


def test_no_text_is_too_long(spark):
    (rule,) = [r for r in quality_rules.RULES if r.name == "length"]
    counts = spark.createDataFrame([(9,), (10,), (1_000_001,), (1 << 40,)], "n_words bigint")
    passes = rule.value({"n_words": F.col("n_words")}).between(rule.low, rule.high)
    assert [r["n_words"] for r in counts.where(passes).collect()] == [10, 1_000_001, 1 << 40]


def test_exact_groups(docs):
    texts = defaultdict(list)
    for i, text, _ in brute.rows_of(docs):
        texts[text].append(i)
    for keep, choose in (("largest", max), ("smallest", min)):
        rows = exact_dedup.exact_groups(docs, keep=keep).collect()
        assert len(rows) == sum(map(len, texts.values()))
        by = {x.encode(): v for x, v in texts.items()}
        digest = {hashlib.sha256(x).hexdigest(): v for x, v in by.items()}
        for r in rows:
            ids = digest[r["text_sha256"]]
            assert r["keep_id"] == choose(ids) and r["group_size"] == len(ids) and r["kept"] == (r["doc_id"] == choose(ids))


def test_collisions_do_not_join_texts(docs):
    """With a hash of four values nearly all texts collide; bytes decide all the same."""
    bad = lambda t: F.pmod(F.crc32(t), F.lit(4))
    want = Counter(exact_dedup.exact_groups(docs).collect())
    assert Counter(exact_dedup.exact_groups(docs, hashed=bad).collect()) == want


def test_drop_exact_copies(docs):
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    texts = [r["text"] or "" for r in kept.select("text", "doc_id").collect()]
    assert set(texts) == {t for _, t, _ in brute.rows_of(docs)}
    assert max(Counter(texts).values()) == 1


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_rows_that_repeat_id_and_text_leave_one(spark, keep):
    rows = [(1, "x", "b"), (1, "x", "a"), (None, "z", "n"), (None, "z", "m"), (None, "y", "o"), (4, "y", "p"), (5, "x", "q"), (1, "w", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string")
    want = {"x": (1, "a") if keep == "smallest" else (5, "q"), "z": (None, "m"), "y": (4, "p"), "w": (1, "r")}
    left = exact_dedup.drop_exact_copies(docs, keep=keep).collect()
    assert len(left) == 4 and {r["text"]: (r["doc_id"], r["_id"]) for r in left} == want


def test_groups_of_null_ids_keep_all(spark):
    docs = spark.createDataFrame([(None, "z"), (None, "z"), (None, None), (3, "")], "doc_id long, text string")
    rows = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(docs).collect())
    assert rows == Counter({(None, None, 2, True): 2, (None, 3, 2, False): 1, (3, 3, 2, True): 1})


def test_least_loaded():
    placed = sharding.least_loaded([(7, "a"), (6, "b"), (5, "c"), (4, "d"), (3, "e")], 2)
    assert placed == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 0}


def test_shards(docs):
    rows = sharding.assign_shards(docs, 40).collect()
    want = Counter((i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t, _ in brute.rows_of(docs))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    loads, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        homes[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())
    assert set(loads) <= set(range(40))


def test_shards_are_nearly_equal(spark):
    rows = registry.queries()["op8_sharding"](spark, "/root/testdata/sf0.01").groupBy("shard").agg(F.sum("size").alias("s")).collect()
    sizes = [r["s"] for r in rows]
    assert len(sizes) == 40 and max(sizes) < 1.02 * min(sizes)


def test_targets_and_taken(docs):
    rows = mixing.mixed_sizes(docs).collect()
    size, source_of = Counter(), {}
    total = Counter()
    for i, text, source in brute.rows_of(docs):
        total[source] += len(brute.WORD.findall(text))
        size[i] += 1
    want = brute.level_targets(dict(total))
    taken = Counter()
    assert Counter(r["doc_id"] for r in rows) == size
    for r in rows:
        assert r["source_size"] == total[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for source, words in taken.items():
        assert abs(words - want[source]) <= 4 * mixing.BLOCK, source
    assert rows and Counter(rows) == Counter(mixing.mixed_sizes(docs.repartition(7)).collect())


def test_permutation_is_one(spark):
    for n in (1, 2, 17, 1000):
        rows = spark.range(n).withColumn("of", F.lit(n).cast("bigint"))
        found = [r["id"] for r in mixing.permuted(rows, "id", "of", F.lit(3)).collect()]
        assert sorted(found) == list(range(n))
    assert found != sorted(found)


def test_sources_stay_off_the_driver(spark, monkeypatch):
    rows = [(i, f"source {i % 300}", " ".join(f"w{i}x{k}" for k in range(100 + i % 7))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    seen, plain = [], type(docs).collect

    def collect(self):
        found = plain(self)
        seen.extend(found)
        return found

    with monkeypatch.context() as m:
        m.setattr(type(docs), "collect", collect)
        made = mixing.mixture(docs)
    assert len(seen) < 10 and not any(isinstance(v, list) for r in seen for v in r)
    slots = made["slots"].collect()
    assert sorted(r["slot"] for r in slots) == list(range(len(slots)))
    words = sum(len(t.split()) for _, _, t in rows)
    assert len({r["rank"] for r in slots}) == 300 and abs(len(slots) * mixing.BLOCK - words) < 300 * mixing.BLOCK


def test_inverse_permutation(spark):
    for n in (1, 17, 1000):
        rows = spark.range(n).withColumns({"of": F.lit(n).cast("bigint"), "to": F.col("id")})
        there = cut(mixing.permuted(rows, "to", "of", F.lit(3)))
        back = mixing.permuted(there, "to", "of", F.lit(3), inverse=True).collect()
        assert len(back) == n and all(r["id"] == r["to"] for r in back)


def test_mixed_documents_hold_what_is_taken(docs):
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got, want = Counter(), Counter()
    words_of = {i: Counter(brute.WORD.findall(t)) for i, t, _ in brute.rows_of(docs)}
    for i, text, _ in brute.rows_of(mixed):
        w = brute.WORD.findall(text)
        got[i] += len(w)
        assert not Counter(w) - words_of[i]
    for r in mixing.mixed_sizes(docs).collect():
        want[r["doc_id"]] += r["taken"]
    assert got == +want


def test_mixed_rows_that_repeat_one_document(spark):
    """Rows of equal id, source and text are rows of their own, with their other columns."""
    rows = [(1, "one two three four", "a", n) for n in range(5)] + [(None, "five six", None, 9), (2, None, "a", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    mixed = mixing.mixed_documents(docs, block=2).collect()
    got, want = Counter(), Counter()
    for r in mixed:
        got[r["doc_id"], r["n"] if r["doc_id"] is None else 0] += len(r["text"].split())
        assert r["n"] in range(5) if r["doc_id"] == 1 else r["n"] == 9
    for r in mixing.mixed_sizes(docs, block=2).collect():
        want[r["doc_id"], 9 if r["doc_id"] is None else 0] += r["taken"]
    assert got == +want


def test_shard_counts_vary_around_their_shares(docs):
    made = mixing.mixture(docs, shard=256)
    counts = made["counts"].collect()
    draws = Counter()
    for r in counts:
        draws[r["rank"]] += r["n"]
    whole = sum(draws.values()) // 256
    assert made["slots"].count() == sum(draws.values())
    per_shard = Counter()
    for r in counts:
        per_shard[r["shard"]] += r["n"]
    assert all(per_shard[s] == 256 for s in range(whole))


@pytest.mark.parametrize("operator", [
    lambda d: quality_rules.judge(d), lambda d: quality_rules.drop_poor(d), lambda d: exact_dedup.exact_groups(d),
    lambda d: exact_dedup.drop_exact_copies(d), lambda d: sharding.assign_shards(d), lambda d: mixing.mixed_sizes(d), lambda d: mixing.mixed_documents(d),
])
def test_no_rows(spark, operator):
    assert operator(brute.no_documents(spark)).collect() == []


@pytest.mark.parametrize("name", ["op4_quality_rules", "op8_sharding", "op9_mixing", "op10_exact_dedup"])
def test_native_plans(spark, name):
    plan = QUERIES[name](spark, brute.FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_sql(spark, name):
    from tests.check_oracle import compare, connect, type_problem

    con = connect(brute.FOLDER)
    frame = QUERIES[name](spark, brute.FOLDER)
    assert compare(frame.toPandas(), con.execute(sql.ORACLES[name]).df()) is None
    assert type_problem(frame, con, sql.ORACLES[name]) is None
