"""Operators on tokens against the library, and round trips."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm import brute
from tieline.llm import encoding, huffman, packing, pretokens, token_counts

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXT = st.text(st.sampled_from("abstmdrevl ' \n\t1٣é!_- 　中İßÀ<|>endoftext"), max_size=60)


def ids(path: str, text: str) -> list[int]:
    library = Tokenizer.from_file(path)
    return library.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def libraries():
    return {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}


@pytest.fixture(scope="module")
def counter():
    return token_counts.TextCounter(BYTES, pretokens.character_classes())


@pytest.fixture(scope="module")
def docs(spark):
    return brute.odd_documents(spark).cache()


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_counts_agree_with_the_library(libraries, counter, texts):
    want = [len(libraries[BYTES].encode(t, add_special_tokens=False).ids) for t in texts]
    assert counter.count(texts).tolist() == want


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_ids_agree_with_the_library(libraries, texts):
    for path in (BYTES, WORDS):
        found = encoding.encoder(path).encode(texts)
        assert [x.tolist() for x in found] == [libraries[path].encode(t, add_special_tokens=False).ids for t in texts]


def test_every_simple_character(libraries):
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}'{chr(c)}" for c in range(1, 0x240)]
    for path in (BYTES, WORDS):
        assert [x.tolist() for x in encoding.encoder(path).encode(texts)] == [libraries[path].encode(t, add_special_tokens=False).ids for t in texts]


def test_chunks_of_any_size_cut_alike():
    rng = random.Random(5)
    kinds = np.array([rng.randrange(pretokens.CLASSES) for _ in range(5000)], np.uint8)
    want = pretokens.starts(kinds, 5000)
    for chunk in (1, 7, 64):
        assert (pretokens.starts(kinds, chunk) == want).all()


def test_forgetting_changes_nothing(libraries):
    small = token_counts.TextCounter(BYTES, pretokens.character_classes(), most=50)
    small.pieces.most = 40
    encoder = encoding.Encoder(WORDS, most=50)
    texts = [t for _, t in [(i, f"some words number {i} withlongerpieces{i * 7919}") for i in range(200)]]
    for k in range(0, 200, 20):
        part = texts[k : k + 20]
        assert small.count(part).tolist() == [len(libraries[BYTES].encode(t).ids) for t in part]
        assert [x.tolist() for x in encoder.encode(part)] == [libraries[WORDS].encode(t, add_special_tokens=False).ids for t in part]


def test_long_texts_in_parts(libraries):
    text = "some words  and\n\nlines, " * 500
    parts = list(token_counts.parts_of(text, 100))
    assert len(parts) > 10 and "".join(parts) == text
    assert sum(len(libraries[BYTES].encode(p).ids) for p in parts) == len(libraries[BYTES].encode(text).ids)


def test_token_counts(docs, libraries):
    rows = {r["doc_id"]: r for r in token_counts.token_counts(docs, BYTES).collect()}
    for i, text, _ in brute.rows_of(docs):
        n = len(libraries[BYTES].encode(text, add_special_tokens=False).ids)
        assert (rows[i]["n_bytes"], rows[i]["n_tokens"], rows[i]["over_limit"]) == (len(text.encode()), n, n > 512)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=700), st.integers(6, 12))
def test_codes_round_trip(values, longest):
    found = np.array(values, np.uint32)
    lengths = huffman.code_lengths(np.bincount(found, minlength=1) ** 3, longest)
    payload, points = huffman.pack_bits(found, huffman.canonical(lengths), lengths)
    table = huffman.decode_table(lengths, longest)
    assert huffman.unpack_bits(payload, np.frombuffer(points.tobytes(), "<u8"), len(found), table, longest).tolist() == values
    assert lengths.max(initial=0) <= longest


def test_code_lengths_are_best():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21])
    assert huffman.code_lengths(counts, 20).tolist() == [7, 7, 6, 5, 4, 3, 2, 1]
    limited = huffman.code_lengths(counts, 4)
    # the best tree of at most four levels: sums of 2 ** -length are 1, cost by exhaustion
    best = min(
        sum(c * x for c, x in zip(counts, shape))
        for shape in __import__("itertools").product(range(1, 5), repeat=8) if sum(16 >> x for x in shape) == 16 and list(shape) == sorted(shape, reverse=True)
    )
    assert sum(0.5 ** int(x) for x in limited) == 1 and int((counts * limited).sum()) == best


def test_files_give_back_all_ids(docs, libraries):
    rows = huffman.through_files(docs, BYTES).collect()
    want = [(i, libraries[BYTES].encode(t, add_special_tokens=False).ids + [2]) for i, t, _ in brute.rows_of(docs)]
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in rows) == Counter((i, np.array(x, "<u4").tobytes()) for i, x in want)
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ordered = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
    assert ordered == sorted(ordered)


def test_bins_fit_best_and_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert [bins.put(n) for n in (6, 5, 4, 3, 9, 2)] == [(0, 0), (1, 0), (0, 6), (1, 5), (2, 0), (1, 8)]


def test_packing(docs, libraries):
    rows = packing.pack_documents(docs, WORDS, open_bins=4, group=50).collect()
    want = Counter()
    for i, t, _ in brute.rows_of(docs):
        x = np.array(libraries[WORDS].encode(t, add_special_tokens=False).ids + [0], "<u4")
        for p in range(0, len(x), 2048):
            want[i, p // 2048, p, len(x[p : p + 2048]), zlib.crc32(x[p : p + 2048].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    held: dict[int, list] = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_few_sequences(spark):
    from tieline.llm import registry

    rows = registry.queries()["op5_packing"](spark, "/root/testdata/sf0.01").collect()
    assert len({r["sequence_id"] for r in rows}) <= 1.01 * sum(r["length"] for r in rows) / 2048 + 1


def test_few_sequences_of_a_full_packer(spark):
    rng = np.random.default_rng(3)
    sizes = np.concatenate([rng.integers(1100, 1900, 5000), rng.integers(50, 700, 9000)])
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(sizes.tolist())], "doc_id bigint, length bigint")
    made = packing.packed(rows).collect()
    assert len(made) == len(sizes)
    assert len({r["sequence_id"] for r in made}) <= 1.01 * max(sizes.sum() / 2048, 5000) + 1


def test_few_sequences_at_a_larger_size(spark):
    from tieline.llm import registry

    rows = registry.queries()["op5_packing"](spark, "/root/testdata/sf0.1").collect()
    assert len({r["sequence_id"] for r in rows}) <= 1.01 * sum(r["length"] for r in rows) / 2048 + 1


def test_sequences_hold_their_ids(docs, libraries):
    made = packing.sequences(docs, WORDS).collect()
    total = sum(len(libraries[WORDS].encode(t, add_special_tokens=False).ids) + 1 for _, t, _ in brute.rows_of(docs))
    assert sum(r["n"] for r in made) == total and all(len(r["ids"]) == 4 * r["n"] <= 4 * 2048 for r in made)


@pytest.mark.parametrize("operator", [
    lambda d: token_counts.token_counts(d, BYTES), lambda d: packing.pack_documents(d, WORDS), lambda d: packing.sequences(d, WORDS),
    lambda d: huffman.through_files(d, BYTES),
])
def test_no_rows(spark, operator):
    assert operator(brute.no_documents(spark)).collect() == []
