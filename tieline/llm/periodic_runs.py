"""Periodic runs of words, found by suffix trees.

A run is a stretch of words that repeats its first ``period`` words at least
``times`` over and cannot be extended to either side.  By the runs theorem every
run has, under one of the two orders of the words, a Lyndon word of its period
inside it that is the longest Lyndon word at its place.  So each place gives two
candidates, one an order, and each candidate is extended as far as it goes: to
the right by the longest common extension of two suffixes, to the left by that
of two suffixes of the reversal.  Both come from suffix trees built by
Ukkonen's method, as depths of lowest common ancestors, which an Euler tour and
a sparse table of its minima give in constant time.  Ranks of suffixes, which
give the Lyndon words, are the order of the leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieline.llm.text import whole, words

LEAST, TIMES = 24, 3  # shortest run in words, and in periods
SLICE = 500  # texts in a batch that goes back to Spark
_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class SuffixTree:
    """Suffix tree of whole numbers above 0; 0 is added as the end."""

    def __init__(self, word: list[int]):
        self.text = [*word, 0]
        self.wide = max(self.text) + 1
        self._grow()
        rank, low = self._tour(descending=False)
        self.rank = rank
        self._minima(low)

    def _grow(self) -> None:
        text, wide = self.text, self.wide
        n = len(text)
        begin, end, link, child = [0], [0], [0], {}
        node = edge = depth = waiting = 0  # the active point, and how many suffixes are not in yet
        for i, c in enumerate(text):
            waiting += 1
            fresh = 0
            while waiting:
                if not depth:
                    edge = i
                key = node * wide + text[edge]
                to = child.get(key)
                if to is None:
                    child[key] = len(begin)
                    begin.append(i)
                    end.append(n)
                    link.append(0)
                    if fresh:
                        link[fresh] = node
                        fresh = 0
                else:
                    span = end[to] - begin[to]
                    if depth >= span:
                        edge += span
                        depth -= span
                        node = to
                        continue
                    at = begin[to] + depth
                    if text[at] == c:
                        if fresh:
                            link[fresh] = node
                        depth += 1
                        break
                    middle = len(begin)
                    child[key] = middle
                    begin += (begin[to], i)
                    end += (at, n)
                    link += (0, 0)
                    child[middle * wide + text[at]] = to
                    child[middle * wide + c] = middle + 1
                    begin[to] = at
                    if fresh:
                        link[fresh] = middle
                    fresh = middle
                waiting -= 1
                if node:
                    node = link[node]
                elif depth:
                    depth -= 1
                    edge = i - waiting + 1
        self.length = [e - b for b, e in zip(begin, end)]
        keys = np.fromiter(child.keys(), np.int64, len(child))
        self._keys, self._to = keys, np.fromiter(child.values(), np.int64, len(child))

    def _tour(self, descending: bool) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each suffix in the order of the leaves, and the least depth on the tour between two leaves.

        The end comes first in either order of the words.
        """
        parent, symbol = self._keys // self.wide, self._keys % self.wide
        symbol = np.where(symbol > 0, self.wide - symbol, 0) if descending else symbol
        order = np.lexsort((-symbol, parent))  # the last on the stack is visited first
        children = self._to[order].tolist()
        first = np.searchsorted(parent[order], np.arange(len(self.length) + 1)).tolist()
        n, length = len(self.text), self.length
        stack, above = [0], [0]
        leaves, low = [], []
        after_leaf = False
        while stack:
            node, up = stack.pop(), above.pop()
            if after_leaf:
                low.append(up)
                after_leaf = False
            here = up + length[node]
            a, b = first[node], first[node + 1]
            if a == b:
                leaves.append(n - here)
                after_leaf = True
            else:
                stack += children[a:b]
                above += [here] * (b - a)
        rank = np.empty(n, np.int64)
        rank[leaves] = np.arange(n)
        return rank, np.array(low, np.int32)

    def _minima(self, low: np.ndarray) -> None:
        self.table = [low]
        step = 1
        while 2 * step <= len(low):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of what the suffixes at ``a`` and ``b`` (never equal) begin with in common."""
        x, y = self.rank[a], self.rank[b]
        left, right = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp(right - left)[1] - 1
        out = np.empty(len(left), np.int64)
        for k in np.unique(level).tolist():
            at = level == k
            out[at] = np.minimum(self.table[k][left[at]], self.table[k][right[at] - (1 << k)])
        return out

    def opposite_rank(self) -> np.ndarray:
        """Ranks under the reversed order of the words."""
        return self._tour(descending=True)[0]


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """The next place of smaller rank, for every place but the last, which has the smallest."""
    out, stack = [0] * len(rank), []
    for i, r in enumerate(rank.tolist()):
        while stack and stack[-1][0] > r:
            out[stack.pop()[1]] = i
        stack.append((r, i))
    return np.array(out[:-1], np.int64)


def runs_of(word: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """(start, length, period) rows of all runs in whole numbers above 0, by start and period."""
    n = len(word)
    if n < max(least, 2):
        return np.zeros((0, 3), np.int64)
    ahead, back = SuffixTree(word.tolist()), SuffixTree(word[::-1].tolist())
    here = np.arange(n)
    found = []
    for rank in (ahead.rank, ahead.opposite_rank()):
        after = next_smaller(rank)  # the longest Lyndon word at a place ends before it
        period = after - here
        right = after + ahead.extension(here, after)
        # the word before a place is that many words from the end of the reversal
        start = here - back.extension(n - here, n - after)
        length = right - start
        long = length >= np.maximum(least, times * period)
        found.append(np.stack([start[long], length[long], period[long]], 1))
    together = {(s, p): n for s, n, p in np.concatenate(found).tolist()}
    return np.array([(s, n, p) for (s, p), n in sorted(together.items())], np.int64).reshape(-1, 3)


def stretches(word: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """Where runs can be: stretches covered by windows that occur more than once.

    Every word of a run is in a window of ``least // times`` words of the run
    that the run repeats one period before or after.  Windows are told apart by
    a hash, so that equal hashes of unequal ones only lengthen a stretch.
    """
    wide = max(1, least // times)
    n = len(word)
    if n < least:
        return []
    with np.errstate(over="ignore"):
        mixed = word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        h = np.zeros(n - wide + 1, np.uint64)
        for k in range(wide):
            h = h * np.uint64(0xD6E8FEB86659FD93) + mixed[k : n - wide + 1 + k]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    if not twice.any():
        return []
    change = np.zeros(n + 1, np.int64)
    change[: len(h)] += twice
    change[wide : wide + len(h)] -= twice
    covered = np.concatenate([[0], (np.cumsum(change[:-1]) > 0).astype(np.int8), [0]])
    turns = np.flatnonzero(np.diff(covered))
    return [(a, b) for a, b in zip(turns[::2].tolist(), turns[1::2].tolist()) if b - a >= least]


def text_runs(found: list[bytes], least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """All runs of a text's words, by start and period."""
    if len(found) < least:
        return np.zeros((0, 3), np.int64)
    known: dict[bytes, int] = {}
    word = np.array([known.setdefault(w, len(known) + 1) for w in found], np.int64)
    rows = []
    for a, b in stretches(word, least, times):
        part = np.unique(word[a:b], return_inverse=True)[1] + 1
        rows.append(runs_of(part, least, times) + np.array([a, 0, 0]))
    return np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)


def collapsed(found: list[bytes], runs: np.ndarray) -> bytes:
    """The words without those that a run repeats, joined by one space."""
    if not len(runs):
        return b" ".join(found)
    change = np.zeros(len(found) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    repeated = np.cumsum(change) > 0
    return b" ".join([w for w, drop in zip(found, repeated.tolist()) if not drop])


def periodic_runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, runs, collapsed) per row: all runs of the whole text, and the text without what they repeat.

    ``runs`` are ordered by start, then period; words count from 0 and are split
    at ASCII white space.  ``collapsed`` keeps each run's first period.  Null and
    empty texts have no runs and collapse to an empty text; repeated rows give
    repeated rows; no rows give none; other columns are not read.  A text is one
    task's work and takes about half a kilobyte of memory for each word that
    stands in a stretch of windows occurring twice.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                runs, left = [], []
                for value in part.column("text"):
                    found = value.as_buffer().to_pybytes().split()
                    rows = text_runs(found, least, times)
                    runs.append([{"start": s, "length": n, "period": p} for s, n, p in rows.tolist()])
                    left.append(collapsed(found, rows).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(runs, kind), pa.array(left, pa.string())], ["doc_id", "runs", "collapsed"])

    number = pa.int64()
    kind = pa.list_(pa.struct([("start", number), ("length", number), ("period", number)]))
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))
    name = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(read, f"doc_id {name}, runs {_RUNS}, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the largest length over period, the first of equals; null without runs."""
    better = lambda best, x: F.when(x["length"] * best["period"] > best["length"] * x["period"], x).otherwise(best)
    return F.when(F.size(runs) > 0, F.reduce(runs, F.get(runs, F.lit(0)), better))


def repeated_text(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The text with a tail made periodic in one document of ten, by a rule on its id.

    With h = crc32(id), g = h div 10 and n words, h mod 10 = 0 and n > 0: from
    word a = g mod n on, words repeat with period 1 + (n - a) div (3 + g mod 8).
    """
    h = F.crc32(F.col(doc_id).cast("string"))
    g = F.floor(h / 10)

    def again(found: Column) -> Column:
        n = F.size(found)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (3 + g % 8))).cast("int")
        times = F.ceil((n - a) / p).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(found, a + 1, p), times))
        return F.array_join(F.slice(F.concat(F.slice(found, F.lit(1), a), tail), F.lit(1), n), " ")

    # a variable of transform() holds the words, so that they are split once
    made = F.get(F.transform(F.array(words(whole(text))), lambda w: F.when(F.size(w) > 0, again(w))), F.lit(0))
    return F.when(h % 10 == 0, F.coalesce(made, whole(text))).otherwise(whole(text))
