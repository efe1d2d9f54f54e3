"""Learned scores, the near-copy join and the pipeline."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tieline.llm import context_tree, ngram_join, pair_ranking, registry

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return brute.odd_documents(spark).cache()


# -- pairwise ranking


def test_ranking_orders_held_out_labels(spark):
    rows = registry.queries()["op1_quality_ranking"](spark, SMALL).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    held = [(labels[r["doc_id"]], r["score"], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    good, bad = ([s for y, s, _ in held if y == want] for want in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.98
    assert np.mean([y == p for y, _, p in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_pairs_fit_the_preference():
    rng = np.random.default_rng(3)
    good, bad = rng.normal(1, 1, (40, 2)), rng.normal(0, 1, (25, 2))
    w = pair_ranking.fit_pairs(good, bad, pairs=25)
    # the gradient of the penalised loss vanishes there: nudging any weight loses
    stride = lambda n, m: (np.repeat(np.arange(n), 25) * 7919 + np.tile(np.arange(25), n) * 104729) % m
    x = np.concatenate([np.repeat(good, 25, 0), good[stride(25, 40)]]) - np.concatenate([bad[stride(40, 25)], np.repeat(bad, 25, 0)])
    loss = lambda v: np.logaddexp(0, -x @ v).mean() + pair_ranking.RIDGE * v @ v / 2
    assert all(loss(w + d) > loss(w) for d in ((1e-3, 0), (-1e-3, 0), (0, 1e-3), (0, -1e-3)))


def test_scores_cover_odd_rows(docs, spark):
    labels = spark.read.parquet(f"{brute.FOLDER}/labels.parquet")
    ranking = pair_ranking.fit(docs, labels)
    assert ranking == pair_ranking.fit(docs.repartition(5), labels.repartition(3))
    rows = pair_ranking.score(docs, ranking)
    assert set(rows.columns) == {*docs.columns, "predicted"} and rows.count() == docs.count()
    assert all(0 <= r["score"] <= 1 for r in rows.select("score").collect())


def test_one_class_gives_its_share(docs, spark):
    only = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    both = spark.createDataFrame([(1, 1), (1, 0), (None, 0)], "doc_id long, quality int")
    assert pair_ranking.fit(docs, only).prior == 1.0
    assert pair_ranking.fit(docs, both).prior == 0.5
    assert pair_ranking.fit(brute.no_documents(spark), only).prior == 0.5
    assert pair_ranking.score(brute.no_documents(spark), pair_ranking.fit(docs, only)).collect() == []


# -- context trees


def weighted(sequences: list[bytes], texts: list[bytes], depth: int) -> list[float]:
    """Natural log probabilities by the definition, node by node."""
    counts = defaultdict(lambda: [0, 0])

    def steps(seq):
        past = b"\n" * depth
        for byte in seq:
            node = 1
            for k in range(7, -1, -1):
                bit = byte >> k & 1
                yield past[-depth:], node, bit
                node = node << 1 | bit
            past += bytes([byte])

    for seq in sequences:
        for past, node, bit in steps(seq):
            for d in range(depth + 1):
                counts[past[depth - d :], node][bit] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    children = defaultdict(set)
    for context, node in counts:
        if context:
            children[context[1:], node].add(context)
    memo = {}

    def code(context, node):
        if (context, node) not in memo:
            own = kt(*counts[context, node]) if (context, node) in counts else 0.0
            if len(context) < depth:
                rest = sum(code(c, node) for c in children[context, node])
                own = np.logaddexp(own, rest) - math.log(2)
            memo[context, node] = own
        return memo[context, node]

    def predict(past, node, d=0):
        context = past[depth - d :] if d else b""
        a, b = counts[context, node] if (context, node) in counts else (0, 0)
        one = (b + 0.5) / (a + b + 1)
        if d == depth:
            return one
        share = math.exp(kt(a, b) - math.log(2) - code(context, node)) if a + b else 0.5
        return share * one + (1 - share) * predict(past, node, d + 1)

    out = []
    for text in texts:
        total = 0.0
        for past, node, bit in steps(text):
            p = predict(past, node)
            total += math.log(p if bit else 1 - p)
        out.append(total)
    return out


def tokens_of(text: str) -> bytes:
    return " ".join(brute.WORD.findall(text.translate(brute.LOWER))).encode() + b"\n"


def test_scores_by_definition(spark):
    texts = ["Abra cadabra abra", "abra  abra\tcad", None, "", "Zebra über alles", "cad abra", "abracadabra zz"]
    held = [False, False, False, True, True, True, None]
    rows = [(i, t, h) for i, (t, h) in enumerate(zip(texts, held))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, out boolean")
    seqs = [tokens_of(t or "") for t in texts]
    train = [s for s, h in zip(seqs, held) if not h]
    words = Counter(w for s in train for w in (*s[:-1].split(), b"\n"))
    n, v = sum(words.values()), len(words)
    want = weighted(train, seqs, context_tree.DEPTH)
    for limits in ({}, {"hot_grams": 5, "hot_words": 2}, {"hot_grams": 0, "hot_words": 0}):
        found = context_tree.score_texts(docs, F.col("out"), **limits).collect()
        assert len(found) == len(rows)
        for r in found:
            seq = (*seqs[r["doc_id"]][:-1].split(), b"\n")
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(seq), sum(w in words for w in seq), n)
            assert r["base_score"] == pytest.approx(sum(math.log10((words[w] + 1) / (n + v + 1)) for w in seq))
            assert r["score"] == pytest.approx(want[r["doc_id"]] / math.log(10), rel=1e-9)


def test_predictions_sum_to_one():
    """Probabilities of all next bytes in a seen, a partly seen and an unseen context."""
    probabilities = []
    for past in (b"ab", b"zb", b"zz"):
        got = weighted([b"abcabd\n"], [past + bytes([x]) for x in range(256)], 2)
        alone = weighted([b"abcabd\n"], [past], 2)[0]
        probabilities.append(sum(math.exp(g - alone) for g in got))
    assert probabilities == pytest.approx([1, 1, 1])


def test_odd_rows_are_scored(docs, spark):
    rows = context_tree.score_texts(docs, F.col("doc_id") % 5 == 0).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _, _ in brute.rows_of(docs))
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert context_tree.score_texts(brute.no_documents(spark), F.lit(False)).collect() == []
    untrained = context_tree.score_texts(docs.where("doc_id IN (9002, 9004)"), F.lit(True)).collect()
    assert all(r["bits_per_byte"] == pytest.approx(8) and r["train_tokens"] == 0 for r in untrained)


# -- near copies


@pytest.mark.parametrize("slice_size", [2048, 2])
def test_near_groups(docs, slice_size):
    want = brute.near_components({i: t for i, t, _ in brute.rows_of(docs)})
    rows = ngram_join.near_groups(docs, slice_size=slice_size).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _, _ in brute.rows_of(docs))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want


def chain(spark):
    """Windows of a long text that overlap so that only neighbours link, copies, and a crowd below the threshold."""
    w = [f"w{i}" for i in range(600)]
    texts = {i: " ".join(w[8 * i : 8 * i + 80]) for i in range(60)}
    texts |= {100 + i: texts[i] for i in range(30)}
    stem = [f"s{i}" for i in range(40)]
    texts |= {200 + i: " ".join([*stem, *[f"own{i}x{k}" for k in range(12 + i % 3)]]) for i in range(40)}
    return spark.createDataFrame([(i, t, "s") for i, t in texts.items()], "doc_id long, text string, source string")


@pytest.mark.parametrize("slice_size", [2048, 3])
def test_chains_and_crowds(spark, slice_size):
    docs = chain(spark)
    want = brute.near_components({i: t for i, t, _ in brute.rows_of(docs)})
    rows = ngram_join.near_groups(docs, slice_size=slice_size).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want


def test_drop_near_copies(docs):
    kept = ngram_join.drop_near_copies(docs)
    assert kept.columns == docs.columns
    want = {c for _, c in brute.near_components({i: t for i, t, _ in brute.rows_of(docs)}).values()}
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == want


def test_null_ids_stay_apart(spark):
    text = "the same words in three rows of which one has no id"
    docs = spark.createDataFrame([(None, text), (5, text), (3, text)], "doc_id long, text string")
    rows = {r["doc_id"]: r["component_id"] for r in ngram_join.near_groups(docs).collect()}
    assert rows == {None: None, 5: 3, 3: 3}


@pytest.mark.parametrize("swapped", [False, True])
def test_one_id_with_two_texts_links_both(spark, swapped):
    left, right = ([f"{c}{k}" for k in range(40)] for c in "ab")
    texts = [" ".join(left), " ".join(right)]
    rows = [(1, texts[swapped]), (1, texts[not swapped]), (2, " ".join([*left, "x"])), (3, " ".join([*right, "y"])), (4, "c d e f g h"), (5, texts[0])]
    rows += [(3, ""), (6, None), (6, "p q r s t"), (None, texts[0])]
    for order in (rows, rows[::-1]):
        found = ngram_join.near_groups(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert len(found) == len(rows)
        assert {(r["doc_id"], r["component_id"]) for r in found} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 1), (6, 6), (None, None)}


@pytest.mark.parametrize("asked", [1, 2])
def test_rounds_of_few_candidates_find_all_links(spark, monkeypatch, asked):
    """Long texts whose bound passes far below the threshold, so that first candidates are refused."""
    monkeypatch.setattr(ngram_join, "ASKED", 2)
    monkeypatch.setattr(ngram_join, "ORDERS", 1)
    monkeypatch.setattr(ngram_join, "EARLY", asked)
    random = np.random.default_rng(asked)
    stem, texts = [f"s{i}" for i in range(1500)], {}
    for i in range(24):
        own = list(stem)
        for k in random.choice(1500, 24 + 2 * (i % 8), replace=False):
            own[k] = f"own{i}x{k}"
        texts[i] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = ngram_join.near_groups(docs, slice_size=7).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute.near_components(texts)


def test_no_near_rows(spark):
    assert ngram_join.near_groups(brute.no_documents(spark)).collect() == []
    assert ngram_join.drop_near_copies(brute.no_documents(spark)).collect() == []


# -- pipeline


def test_pipeline_stages(spark):
    """Every stage against a plain restatement on its own input."""
    from tieline.functions.lineage import cut

    docs = spark.read.parquet(f"{brute.FOLDER}/documents.parquet")
    columns, held = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        held.append(cut(stage(spark, held[-1], brute.FOLDER)))
    texts = lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    first, quality, exact, near, mixed, packed = held
    assert all(df.columns == columns for df in held[:-1])
    kept = dict(texts(quality))
    for i, t in texts(first):
        w = brute.WORD.findall(t)
        if len(w) < 10 or 100 * brute.repeated_words(w) > 20 * len(w):
            assert i not in kept
    last = {t: max(i for i, u in kept.items() if u == t) for t in kept.values()}
    assert dict(texts(exact)) == {i: t for t, i in last.items()}
    groups = brute.near_components(dict(texts(exact)))
    assert {i for i, _ in texts(near)} == {c for _, c in groups.values()}
    words = lambda df: sum(len(brute.WORD.findall(t)) for _, t in texts(df))
    assert abs(words(mixed) - words(near)) <= 40 * 32
    assert Counter(r["doc_id"] for r in packed.where("piece = 0").collect()) == Counter(i for i, _ in texts(mixed))
    assert corpus_pipeline.run(spark, brute.FOLDER).count() == packed.count()
