"""Periodic runs, whitening and toxicity against their definitions."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tieline.llm import periodic_runs, registry, toxicity, whitening


@pytest.fixture(scope="module")
def docs(spark):
    return brute.odd_documents(spark).cache()


# -- periodic runs


def plain_runs(word, least=24, times=3):
    """Every maximal stretch of every period, by comparing places."""
    found = []
    for p in range(1, len(word) // times + 1):
        i = 0
        while i + p < len(word):
            j = i
            while j + p < len(word) and word[j] == word[j + p]:
                j += 1
            length = j + p - i
            smaller = lambda q: all(word[i + k] == word[i + k + q] for k in range(length - q))
            if j > i and length >= max(least, times * p) and not any(map(smaller, range(1, p))):
                found.append((i, length, p))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least, times", [(24, 3), (4, 2), (6, 3)])
def test_runs_are_those_of_the_definition(least, times):
    rng = random.Random(least)
    for _ in range(250):
        size, letters = rng.randint(1, 70), rng.choice([1, 2, 3, 5])
        word = [rng.randrange(letters) for _ in range(size)]
        if rng.random() < 0.6:
            pieces = [[rng.randrange(letters) for _ in range(rng.randint(1, 7))] * rng.randint(1, 6) for _ in range(8)]
            word = list(itertools.chain(*pieces))[:size]
        got = periodic_runs.text_runs([b"%d" % w for w in word], least, times).tolist()
        assert list(map(tuple, got)) == plain_runs(word, least, times)


def test_common_extensions_by_the_suffix_tree():
    rng = random.Random(5)
    word = [rng.randint(1, 3) for _ in range(80)]
    tree = periodic_runs.SuffixTree(word)
    a, b = map(np.array, zip(*itertools.combinations(range(len(word) + 1), 2)))
    want = [next((k for k in range(81) if j + k >= 80 or word[i + k] != word[j + k])) for i, j in zip(a.tolist(), b.tolist())]
    assert tree.extension(a, b).tolist() == want
    assert np.argsort(tree.rank).tolist() == sorted(range(81), key=lambda i: word[i:])


def test_registered_runs(spark, docs):
    rows = {}
    table = docs.select("doc_id", periodic_runs.repeated_text().alias("text"))
    for r in periodic_runs.periodic_runs(table).collect():
        rows.setdefault(r["doc_id"], r)
    assert len(rows) == docs.select("doc_id").distinct().count()
    seen = 0
    for doc, text, _ in brute.rows_of(docs):
        w, h = brute.WORD.findall(text), zlib.crc32(str(doc).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        if n > 600:
            continue
        want = plain_runs(w)
        drop = {i for s, length, p in want for i in range(s + p, s + length)}
        assert [tuple(x) for x in rows[doc]["runs"]] == want
        assert rows[doc]["collapsed"] == " ".join(x for i, x in enumerate(w) if i not in drop)
        seen += bool(want)
    assert seen > 5
    first = registry.op11(spark, brute.FOLDER).where("n_runs > 0").first()
    runs = [tuple(x) for x in rows[first["doc_id"]]["runs"]]
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
    assert (first["start"], first["length"], first["period"], first["exponent_milli"]) == (*best, 1000 * best[1] // best[2])
    assert first["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()


def test_runs_of_no_rows_and_no_words(spark):
    assert periodic_runs.periodic_runs(brute.no_documents(spark)).count() == 0
    frame = spark.createDataFrame([(1, None), (2, ""), (None, "a " * 30)], "doc_id long, text string")
    got = {r["doc_id"]: (r["runs"], r["collapsed"]) for r in periodic_runs.periodic_runs(frame).collect()}
    assert got[1] == got[2] == ([], "") and got[None] == ([(0, 30, 1)], "a")
    assert frame.select(periodic_runs.strongest(F.array().cast("array<struct<start:bigint,length:bigint,period:bigint>>"))).first()[0] is None


# -- whitening


@pytest.mark.parametrize("d, n, odd", [(5, 40, None), (8, 90, "flat"), (16, 9, None), (6, 60, "same")])
def test_spectra_by_rows_and_by_parts(d, n, odd):
    x = np.floor(np.random.default_rng(d).normal(0, 200, (n, d))) + 100_000
    if odd == "flat":
        x[:, 2], x[:, 5] = x[:, 1], 100_000
    if odd == "same":
        x[:30] = x[0]

    def spectrum(rows):
        s = whitening._empty(d)
        for r in rows:
            s = whitening.with_row(s, r)
        return s

    c = x - x.mean(0)
    for s in (spectrum(x), whitening.merged(spectrum(x[: n // 3]), spectrum(x[n // 3 :]))):
        assert s.n == n and np.allclose(s.mean, x.mean(0), rtol=0, atol=1e-8)
        assert np.abs(s.vectors * s.values @ s.vectors.T - c.T @ c).max() < 1e-11 * np.abs(c.T @ c).max()
        assert np.abs(s.vectors.T @ s.vectors - np.eye(d)).max() < 1e-12


def test_whitened_components(spark):
    rng = np.random.default_rng(2)
    good = rng.normal(0, [1, 0.7, 0.5, 0.3, 0.2], (400, 5)).astype(np.float32)
    rows = [(i, v.tolist(), "clash", 3) for i, v in enumerate(good)] + [(7, good[7].tolist(), "clash", 3)]
    odd = [(900, None), (901, []), (902, [1.0, None, 1.0, 1.0, 1.0]), (903, [float("nan")] * 5), (904, [float("inf")] * 5), (905, [1.0, 2.0])]
    frame = spark.createDataFrame(rows + [(*o, "clash", 3) for o in odd], "vec_id long, embedding array<float>, component string, n int")
    got = whitening.whiten(frame.repartition(40)).collect()
    kept = np.vstack([good, good[7:8]]).astype(float)
    x = np.floor(1024 * kept).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    want = np.abs((x - sums / n) @ vectors / np.sqrt(values))
    assert len(got) == 5 * n and {r["n"] for r in got} == {n} and got[0]["identity_error"] < 1e-9
    for r in got:
        i, k = r["vec_id"], r["component"] - 1
        assert r["deviation"] == int(((n * x[i] - sums) ** 2).sum())
        assert abs(abs(r["whitened"]) - want[i, k]) < 1e-9 and abs(r["explained"] / (values[k] / values.sum()) - 1) < 1e-9


def test_whitening_without_spread_or_rows(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "vec_id long, embedding array<double>")
    got = whitening.whiten(same).collect()
    assert len(got) == 8 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 for r in got)
    none = whitening.whiten(same.where("vec_id < 0"))
    assert none.count() == 0 and none.columns == whitening.whiten(same).columns


# -- toxicity


def plain_kernel(a, b):
    """All pairs of letter triples, weighed by what lies between their first and last."""
    told = lambda s: [c if c.isalpha() or c in toxicity.BEGIN + toxicity.END else None for c in s]
    decay = lambda s, at: np.prod([1.0] + [
        (toxicity.LETTER_DECAY if s[i].isalpha() else toxicity.OTHER_DECAY) for i in range(at[0], at[-1]) if i not in at
    ])
    total = 0.0
    a, b = toxicity.marked(a), toxicity.marked(b)
    for x in itertools.combinations(range(len(a)), toxicity.ORDER):
        for y in itertools.combinations(range(len(b)), toxicity.ORDER):
            left, right = [told(a)[i] for i in x], [told(b)[i] for i in y]
            if None not in left and left == right:
                total += decay(a, x) * decay(b, y)
    return total


def test_kernel_is_the_sum_over_common_subsequences():
    marks = [toxicity.Landmark(z) for z in ("idiot", "scum")]
    units = ["idiot", "id.io-t", "schum", "iditiot", "scu"]
    got = toxicity.kernels(units, marks)
    for u, row in zip(units, got):
        for z, value in zip(("idiot", "scum"), row):
            want = (plain_kernel(u, z) / np.sqrt(plain_kernel(u, u) * plain_kernel(z, z))) ** toxicity.POWER
            assert value == pytest.approx(want, rel=1e-3) or value == 0 and want < toxicity.FLOOR


def test_units_and_sentences():
    import pyarrow as pa

    u = toxicity.units_of(pa.array(["one two. three\nfour", "", "s c u m now", "w " * 2 + "x" * 100]))
    words = [u.words[i] for i in u.at if u.words[i]]  # an empty text has one unit without letters
    assert words == ["one", "two.", "three", "four", "s c u m", "now", "w", "w", "x" * 100]
    assert np.diff(u.text_start).tolist() == [3, 1, 1, 1] and u.sentence_start[-1] == len(u.at)
    assert [sum(len(u.words[i]) for i in u.at[a:b]) for a, b in zip(u.sentence_start, u.sentence_start[1:])][3] == 0


@pytest.fixture(scope="module")
def trained(spark):
    rng = random.Random(8)
    syllables = ["ta", "ren", "mo", "lis", "and", "ker", "vo", "sil"]
    clean = lambda: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(40))
    rows, labels = [], []
    for i in range(240):
        text = clean().split()
        if i % 4 == 0:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["grobblit", "Zanfurk", "plooty"]))
        rows.append((i, " ".join(w + "." * (k % 8 == 7) for k, w in enumerate(text))))
        labels.append((i, int(i % 4 == 0)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    return toxicity.fit(docs, known.where("doc_id < 160")), docs, dict(labels)


def test_held_out_documents_and_altered_insults(spark, trained):
    machine, docs, labels = trained
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs.where("doc_id >= 160"), machine).collect()}
    # none is missed; of so few documents some clean word is only found in toxic ones by chance
    assert len(got) == 80 and all(p for i, p in got.items() if labels[i]) and sum(labels[i] == p for i, p in got.items()) >= 76
    texts = [("ta g-robb.lit ren", 1), ("p l o o t y", 1), ("mo zan*furk!", 1), ("PLOOTY", 1), ("lis and ker", 0), ("", 0), (None, 0), ("plot zan", 0)]
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    rows = toxicity.score(frame, machine).orderBy("doc_id").collect()
    assert [r["predicted"] for r in rows] == [y for _, y in texts]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_toxicity_of_odd_rows(spark, docs, trained):
    rows = toxicity.score(docs, trained[0])
    assert rows.columns == ["doc_id", "score", "predicted"] and rows.count() == docs.count()
    assert rows.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(brute.no_documents(spark), trained[0]).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.5}
