"""Token counts of byte-level BPE by finite-state transducers, without making tokens.

Two transducers are compiled from the tokenizer's file.  The first cuts the text
into pre-tokens (``pretokens``).  The second reads a pre-token byte by byte: its
state is what can still change, namely the vocabulary prefixes that end at this
byte, each with the last token of the encoding before it, and the token count
there; its transitions carry by how many tokens the encoding of the prefix read
so far changes.  It is deterministic because a sequence of BPE tokens is the
encoding of its bytes exactly when each two neighbours are the encoding of
theirs, so one last token fits each prefix.  Transitions are compiled when first
met, and forgotten together when there are too many.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieline.llm import pretokens as pt
from tieline.llm.text import whole

ROOT, NONE = 0, -1


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in the files of byte-level tokenizers."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens as bytes, merge ranks and special strings of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"]:
            raise ValueError("only byte-level BPE without normalizer or prefix space is compiled")
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.tokens = {as_bytes(s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.ranks = {(as_bytes(a), as_bytes(b)): r for r, (a, b) in enumerate(merges)}

    def encode(self, word: bytes) -> list[bytes]:
        """Tokens of a short piece, merging the lowest rank first."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(p, len(self.ranks)), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == len(self.ranks):
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts


class PieceCounter:
    """The second transducer."""

    def __init__(self, vocabulary: Vocabulary, most: int = 600_000):
        self.vocabulary, self.most = vocabulary, most
        self.child: dict[int, int] = {}
        self.token = [NONE]
        self.grows = [True]
        self.bytes = {i: t for t, i in vocabulary.tokens.items()}
        for word, i in vocabulary.tokens.items():
            node = ROOT
            for b in word:
                self.grows[node] = True
                to = self.child.get(node << 8 | b)
                if to is None:
                    to = self.child[node << 8 | b] = len(self.token)
                    self.token.append(NONE)
                    self.grows.append(False)
                node = to
            self.token[node] = i
        self.forget()

    def forget(self) -> None:
        self.table: dict[int, int] = {}
        self.states = [((ROOT, NONE, 0),)]
        self.names = {self.states[0]: 0}
        self.fits: dict[tuple[int, int], bool] = {}

    def neighbours(self, a: int, b: int) -> bool:
        fit = self.fits.get((a, b))
        if fit is None:
            left, right = self.bytes[a], self.bytes[b]
            fit = self.fits[a, b] = self.vocabulary.encode(left + right) == [left, right]
        return fit

    def compile(self, state: int, byte: int) -> int:
        open_, last = [], None
        for node, before, ahead in self.states[state]:
            to = self.child.get(node << 8 | byte)
            if to is None:
                continue
            token = self.token[to]
            if last is None and token != NONE and (before == NONE or self.neighbours(before, token)):
                last = token, ahead + 1
            if self.grows[to]:
                open_.append((to, before, ahead))
        token, more = last
        reached = (*((n, b, a - more) for n, b, a in open_), (ROOT, token, 0))
        name = self.names.get(reached)
        if name is None:
            name = self.names[reached] = len(self.states)
            self.states.append(reached)
        value = self.table[state << 8 | byte] = name << 16 | (more + 0x8000)
        return value

    def count(self, piece: bytes) -> int:
        if len(self.table) > self.most:
            self.forget()
        get, state, n = self.table.get, 0, 0
        for byte in piece:
            value = get(state << 8 | byte)
            if value is None:
                value = self.compile(state, byte)
            state = value >> 16
            n += (value & 0xFFFF) - 0x8000
        return n


def parts_of(text: str, size: int = pt.STREAM) -> Iterator[str]:
    """A long text in parts, cut where a blank follows a visible character: there every state is left."""
    at = 0
    while len(text) - at > 2 * size:
        cut = text.find(" ", at + size)
        while cut > 0 and text[cut - 1].isspace():
            cut = text.find(" ", cut + 1)
        if cut <= 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


class TextCounter:
    """Token counts of whole texts; keeps what it has compiled from batch to batch."""

    def __init__(self, path: str, kinds: np.ndarray, most: int = 2_000_000):
        self.vocabulary = Vocabulary(path)
        self.pieces = PieceCounter(self.vocabulary)
        self.kinds, self.spans, self.memo = kinds, pt.Spans(), pt.Memo(most)

    def segments(self, text: str) -> tuple[list[str], int]:
        """The text between special strings, and how many of those there are."""
        found, count = [text], 0
        for s in self.vocabulary.special:
            if s in text:
                found = [p for part in found for p in part.split(s)]
                count = len(found) - 1
        return [p for part in found for p in parts_of(part)], count

    def count(self, texts: list[str]) -> np.ndarray:
        owner, pieces = [], []
        totals = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            parts, totals[k] = self.segments(text)
            owner.extend([k] * len(parts))
            pieces.extend(parts)
        owners = np.array(owner, np.intp)
        for a, b in pt.streams(pieces):
            np.add.at(totals, owners[a:b], self._stream(pieces[a:b]))
        return totals

    def _stream(self, parts: list[str]) -> np.ndarray:
        joined = "\0".join(parts) + "\0"
        points = pt.code_points(joined)
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        kinds = self.kinds[points]
        kinds[ends] = pt.END
        begin = np.flatnonzero(pt.starts(kinds))
        end = np.append(begin[1:], len(points))
        real = kinds[begin] != pt.END
        begin, end = begin[real], end[real]
        key, check = self.spans.hashes(points, begin, end)
        known, first, at = np.unique(key, return_index=True, return_inverse=True)
        if not np.array_equal(check[first][at], check):  # two spans with one hash: count each by itself
            each = np.array([self.pieces.count(joined[b:e].encode("utf-8", "surrogatepass")) for b, e in zip(begin, end)], np.int64)
        else:
            value = self.memo.get(known, check[first])
            new = np.flatnonzero(value < 0)
            count = self.pieces.count
            value[new] = [count(joined[b:e].encode("utf-8", "surrogatepass")) for b, e in zip(begin[first[new]].tolist(), end[first[new]].tolist())]
            self.memo.put(known[new], check[first][new], value[new])
            each = value[at]
        return np.bincount(np.searchsorted(ends, begin), each, len(parts)).astype(np.int64)


_COUNTERS: dict[str, TextCounter] = {}


def token_counts(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row, whole texts, as the tokenizer of the file counts them.

    Special strings in a text are one token each.  Null and empty texts have no
    tokens; long texts are read in parts; repeated rows are counted each; no rows
    give no rows; other columns are not read.  The character classes, a table of
    1.1 MB whatever the input, are asked of the library once and sent along.
    """
    kinds = docs.sparkSession.sparkContext.broadcast(pt.character_classes().tobytes())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _COUNTERS:
            _COUNTERS[path] = TextCounter(path, np.frombuffer(kinds.value, np.uint8))
        for batch in batches:
            n = _COUNTERS[path].count(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
