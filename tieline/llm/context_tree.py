"""Language-model scores by context-tree weighting over bytes, beside a unigram base.

A text is modelled as its tokens: words in lower case joined by one space, then
an end byte, so a probability of these bytes is one of the token sequence.  Each
byte is eight binary decisions; each of the 255 decision nodes has its own tree
of contexts of 0 to DEPTH preceding bytes.  A node of the tree mixes its
Krichevsky-Trofimov estimate and the product of its children half and half, so a
decision is predicted by all depths, weighted by how well each coded the
training text.

The corpus is reduced to counts of (context, byte) grams and of words.  Grams are
dealt out by their two most recent context bytes, a subtree each; only the two
top levels, at most 65,280 nodes, are added up on the driver.  Scoring looks up
the most frequent grams and words, tables of fixed size, in the task that reads
the text; all others are joined by key, so no part of the model has to fit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieline.functions.lineage import cut
from tieline.llm.pretokens import Spans
from tieline.llm.text import small_batches, whole

DEPTH = 5
HOT_GRAMS = 1 << 21  # 16 bytes each
HOT_WORDS = 1 << 19
STREAM = 1 << 18  # bytes looked at together
END = 10

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


class Layout:
    """Some texts as one byte stream: DEPTH end bytes, then each text's tokens and DEPTH end bytes.

    The first end byte after a text belongs to it, the others are context of the next.
    """

    def __init__(self, texts: list[bytes], spans: Spans, depth: int = DEPTH):
        pad = b"\n" * depth
        raw = LOWER[np.frombuffer(pad + b"".join(t + pad for t in texts), np.uint8)]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes + depth)
        word = ~BLANK[raw]
        begin = np.flatnonzero(word[1:] & ~word[:-1]) + 1
        stop = np.flatnonzero(word[:-1] & ~word[1:]) + 1
        self.word_doc = np.searchsorted(ends, begin)
        self.word_key = spans.hashes(raw, begin, stop)[0].view(np.int64)
        keep = word
        between = begin[1:][self.word_doc[1:] == self.word_doc[:-1]] - 1
        keep[between] = True
        raw[between] = 32
        keep[:depth] = True
        for k in range(depth):
            keep[ends + k] = True
        stream = raw[keep]
        end_at = (np.cumsum(keep) - 1)[ends]
        real = np.ones(len(stream), bool)
        real[:depth] = False
        for k in range(1, depth):
            real[end_at + k] = False
        code = np.zeros(len(stream), np.int64)
        for k in range(depth + 1):
            code[k:] |= stream[: len(stream) - k].astype(np.int64) << (8 * k)
        at = np.flatnonzero(real)
        self.gram = code[at]
        self.gram_doc = np.searchsorted(end_at, at)


def batches_of(texts: list[bytes]) -> Iterator[slice]:
    first, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= STREAM or k + 1 == len(texts):
            yield slice(first, k + 1)
            first, size = k + 1, 0


class Tally:
    """Sums by key, compacted now and then."""

    def __init__(self):
        self.keys, self.sums, self.size, self.least = [], [], 0, 0

    def add(self, keys: np.ndarray, sums: np.ndarray) -> None:
        self.keys.append(keys)
        self.sums.append(sums)
        self.size += len(keys)
        if self.size > 1 << 20 and self.size > 2 * self.least:
            keys, sums = self.total()
            self.keys, self.sums, self.size = [keys], [sums], len(keys)
            self.least = len(keys)

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        return keys, np.bincount(at, np.concatenate(self.sums), len(keys)).astype(np.int64)


WORDS, GRAMS = 0, 1


def corpus_counts(rows: DataFrame) -> DataFrame:
    """(kind, key, n) from (text binary, held_out): training counts of words and grams.

    Grams that only held-out rows have are there too, with 0.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies, spans = (Tally(), Tally()), Spans()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            trains = ~np.array(batch.column("held_out").to_pylist(), bool)
            for part in batches_of(texts):
                laid, train = Layout(texts[part], spans), trains[part]
                grams, at = np.unique(laid.gram, return_inverse=True)
                tallies[GRAMS].add(grams, np.bincount(at, train[laid.gram_doc], len(grams)).astype(np.int64))
                words, n = np.unique(laid.word_key[train[laid.word_doc]], return_counts=True)
                tallies[WORDS].add(words, n)
        for kind, tally in enumerate(tallies):
            keys, n = tally.total()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(n)], ["kind", "key", "n"])

    counted = rows.select("text", "held_out").mapInArrow(count, "kind int, key bigint, n bigint")
    return counted.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series eight steps up."""
    z, low = x + 8, np.ones_like(x)
    for k in range(8):
        low = low * (x + k)
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series - np.log(low)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    half = lambda n: log_gamma(n + 0.5)
    return half(zeros) + half(ones) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


LN2 = np.log(2.0)


class Level:
    """Nodes of one depth for one bit position: counts, weighted log probability, parent."""

    def __init__(self, keys: np.ndarray, at: np.ndarray, zeros, ones, below):
        self.keys, self.at = keys, at  # at: this level's node of each row of the level below
        self.zeros = np.bincount(at, zeros, len(keys))
        self.ones = np.bincount(at, ones, len(keys))
        estimate = log_kt(self.zeros, self.ones)
        if below is None:
            self.weighted, self.own = estimate, np.ones(len(keys))
        else:
            split = np.bincount(at, below, len(keys))
            self.weighted = np.logaddexp(estimate, split) - LN2
            self.own = np.exp(estimate - LN2 - self.weighted)

    def predicted(self, base: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of a one so far and what is left for deeper nodes, from the parent's."""
        one = (self.ones + 0.5) / (self.zeros + self.ones + 1)
        return base + rest * self.own * one, rest * (1 - self.own)


def subtree(gram: np.ndarray, n: np.ndarray, bit: int, depth: int = DEPTH) -> list[Level]:
    """Levels from ``depth`` up to 2 for one bit position of distinct grams."""
    byte = gram & 255
    node = (1 << bit) | (byte >> (8 - bit))
    value = (byte >> (7 - bit)) & 1
    keys, at = np.unique((gram >> 8 << 8) | node, return_inverse=True)
    levels = [Level(keys, at, n * (1 - value), n * value, None)]
    for d in range(depth - 1, 1, -1):
        last = levels[-1]
        short = ((last.keys >> 8) & ((1 << 8 * d) - 1)) << 8 | (last.keys & 255)
        keys, at = np.unique(short, return_inverse=True)
        levels.append(Level(keys, at, last.zeros, last.ones, last.weighted))
    return levels


def _partition(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    found = [(b.column("key").to_numpy(), b.column("n").to_numpy()) for b in batches]
    gram, n = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2
    order = np.argsort(gram)
    return gram[order], n[order].astype(np.float64)


def gram_scores(grams: DataFrame) -> DataFrame:
    """(key, n, score): natural log probability of the gram's last byte after the others."""
    # all rows of a subtree in one task; its size is bounded by the depth, not by the corpus
    dealt = cut(grams.select("key", "n").repartition(F.shiftright("key", 8).bitwiseAND(0xFFFF)).withColumn("part", F.spark_partition_id()))
    placed = dealt.repartition("part")

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, n = _partition(batches)
        for bit in range(8):
            if len(gram):
                last = subtree(gram, n, bit)[-1]
                keys, at = np.unique(last.keys & 0xFFFF, return_inverse=True)
                sums = [np.bincount(at, x, len(keys)) for x in (last.zeros, last.ones, last.weighted)]
                yield pa.RecordBatch.from_arrays([pa.array(keys), *map(pa.array, sums)], ["node", "zeros", "ones", "below"])

    added = placed.mapInArrow(tops, "node bigint, zeros double, ones double, below double").groupBy("node")
    # bounded: 256 contexts of one byte times 255 decision nodes
    found = added.agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below"))).orderBy("node").collect()
    node = np.array([r["node"] for r in found], np.int64)
    each = lambda c: np.array([r[c] for r in found], np.float64)
    one = Level(node, np.arange(len(node)), each("zeros"), each("ones"), each("below"))
    keys, at = np.unique(node & 255, return_inverse=True)
    zero = Level(keys, at, one.zeros, one.ones, one.weighted)
    base, rest = zero.predicted(np.zeros(len(keys)), np.ones(len(keys)))
    base, rest = one.predicted(base[at], rest[at])
    sent = grams.sparkSession.sparkContext.broadcast((node, base, rest))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, n = _partition(batches)
        total = np.zeros(len(gram))
        node, top_base, top_rest = sent.value
        for bit in range(8):
            if not len(gram):
                break
            levels = subtree(gram, n, bit)
            at = np.searchsorted(node, levels[-1].keys & 0xFFFF)
            base, rest = top_base[at], top_rest[at]
            for k in range(len(levels) - 1, -1, -1):
                base, rest = levels[k].predicted(base, rest)
                if k:  # from each node to the nodes below it
                    base, rest = base[levels[k].at], rest[levels[k].at]
            one = base[levels[0].at]
            value = (gram >> (7 - bit)) & 1
            total += np.log(np.where(value == 1, one, 1 - one))
        yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n.astype(np.int64)), pa.array(total)], ["key", "n", "score"])

    return placed.mapInArrow(scores, "key bigint, n bigint, score double")


def hottest(table: DataFrame, value: str, most: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """The most frequent keys, at most ``most``, sorted, with their values, and whether that is all of them.

    Frequencies fall into a few thousand classes; the classes that fit are taken,
    from the most frequent down, so nothing is sorted and what is taken is bounded.
    """
    classed = table.withColumn("class", F.floor(F.log2(F.col("n") + 1) * 64).cast("int"))
    sizes = {r["class"]: r["count"] for r in classed.groupBy("class").count().collect()}
    held, lowest = 0, 1 << 30
    for c in sorted(sizes, reverse=True):
        if held + sizes[c] > most:
            break
        held, lowest = held + sizes[c], c
    found = classed.where(F.col("class") >= lowest).select("key", F.col(value).cast("double").alias("v")).toArrow()
    keys, values = found.column("key").to_numpy(), found.column("v").to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order], held == sum(sizes.values())


def _looked_up(keys: np.ndarray, table: tuple[np.ndarray, np.ndarray, bool]) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 where the table has none) and which keys have to be joined."""
    names, values, complete = table
    if not len(names):
        return np.zeros(len(keys)), np.full(len(keys), not complete)
    at = np.searchsorted(names, keys)
    at[at == len(names)] = 0
    hit = names[at] == keys
    return np.where(hit, values[at], 0.0), ~hit & (not complete)


def score_texts(
    docs: DataFrame, held_out, *, doc_id: str = "doc_id", text: str = "text", hot_grams: int = HOT_GRAMS, hot_words: int = HOT_WORDS,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) per row.

    ``held_out`` is a column: rows where it is not true train the model, and null
    trains.  Null and empty texts are the end alone.  Without training rows every
    estimate is the prior: each decision costs one bit, the base spreads over one
    token.  Repeated rows count and are scored each; no rows give no rows; other
    columns are not read.  Words and their counts go by a 64-bit hash.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), whole(text).cast("binary").alias("text")
    )
    with small_batches(docs.sparkSession):
        counts = cut(corpus_counts(rows))
    words = counts.where(f"kind = {WORDS}")
    model = cut(gram_scores(counts.where(f"kind = {GRAMS}")))
    trained = rows.where(~F.col("held_out")).count()
    sums = words.agg(F.sum("n"), F.count("*")).first()
    tokens, distinct = (sums[0] or 0) + trained, sums[1] + (trained > 0)
    floor = float(np.log10(tokens + distinct + 1))
    sent = docs.sparkSession.sparkContext.broadcast((hottest(words, "n", hot_words), hottest(model, "score", hot_grams)))
    names = ["row", "kind", "doc_id", "held_out", "key", "n", "n_known", "base", "score", "bytes"]
    key_kind = rows.schema["doc_id"].dataType.simpleString()
    TEXT = 2

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, spans = TaskContext.get().partitionId() << 40, Spans()
        hot_word, hot_gram = sent.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in batches_of(texts):
                laid, m = Layout(texts[part], spans), part.stop - part.start
                keys, at = np.unique(laid.word_key, return_inverse=True)
                seen, later = _looked_up(keys, hot_word)
                per_word = np.where(later, 0.0, np.log10(seen + 1) - floor)
                base = np.bincount(laid.word_doc, per_word[at], m) + np.log10(trained + 1) - floor
                known = np.bincount(laid.word_doc, (seen > 0)[at], m).astype(np.int64) + (trained > 0)
                n_tokens = np.bincount(laid.word_doc, minlength=m) + 1
                grams, gram_at = np.unique(laid.gram, return_inverse=True)
                value, gram_later = _looked_up(grams, hot_gram)
                total = np.bincount(laid.gram_doc, value[gram_at], m)
                size = np.bincount(laid.gram_doc, minlength=m)
                doc_ids = batch.column("doc_id").slice(part.start, m)
                zeros = np.zeros(m, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(m)), pa.array(np.full(m, TEXT, np.int32)), doc_ids, batch.column("held_out").slice(part.start, m),
                     pa.array(zeros), pa.array(n_tokens), pa.array(known), pa.array(base), pa.array(total), pa.array(size)], names)
                for kind, owner, key, pending in ((WORDS, laid.word_doc, keys[at], later[at]), (GRAMS, laid.gram_doc, grams[gram_at], gram_later[gram_at])):
                    if pending.any():
                        pair, n = np.unique(np.stack([owner[pending], key[pending]]), axis=1, return_counts=True)
                        size_ = len(n)
                        none = [pa.nulls(size_, batch.column("doc_id").type), pa.nulls(size_, pa.bool_())]
                        blank = [pa.nulls(size_, t) for t in (pa.int64(), pa.float64(), pa.float64(), pa.int64())]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(row + pair[0]), pa.array(np.full(size_, kind, np.int32)), *none, pa.array(pair[1]), pa.array(n), *blank], names)
                row += m

    schema = f"row bigint, kind int, doc_id {key_kind}, held_out boolean, key bigint, n bigint, n_known bigint, base double, score double, bytes bigint"
    with small_batches(docs.sparkSession):
        told = cut(rows.mapInArrow(score, schema))
    sent.destroy()  # frees the tables in the workers; what they were for is written
    ask = lambda kind: told.where(f"kind = {kind}").select("row", "key", F.col("n").alias("times"))
    of_words = ask(WORDS).join(words.select("key", "n"), "key", "left").select(
        "row", F.when(F.col("n") > 0, F.col("times")).otherwise(0).alias("n_known"),
        (F.col("times") * (F.log10(F.coalesce("n", F.lit(0)) + 1) - floor)).alias("base"), F.lit(0.0).alias("score"),
    )
    of_grams = ask(GRAMS).join(model.select("key", "score"), "key").select(
        "row", F.lit(0).cast("bigint").alias("n_known"), F.lit(0.0).alias("base"), (F.col("times") * F.col("score")).alias("score")
    )
    direct = told.where(f"kind = {TEXT}")
    parts = direct.select("row", "n_known", "base", "score").unionByName(of_words).unionByName(of_grams)
    added = parts.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("n_known", "base", "score")))
    log10 = F.col("score") / float(np.log(10))
    return direct.select("row", "doc_id", "held_out", F.col("n").alias("n_tokens"), "bytes").join(added, "row").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"),
        F.col("base").alias("base_score"), log10.alias("score"), (-F.col("score") / LN2 / F.col("bytes")).alias("bits_per_byte"),
    )
