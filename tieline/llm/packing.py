"""Packing token pieces into sequences: bounded-space online best-fit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieline.functions.lineage import cut
from tieline.llm.encoding import encoder
from tieline.llm.text import small_batches, whole

LENGTH = 2048
GROUP = 16_384  # pieces for a packer, about, and its open bins


def pieces(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids) with ids as little-endian unsigned 32-bit bytes.

    The ids of a document are the tokenizer's, then ``end``.  Only documents of
    more than ``length`` ids are cut, into pieces of ``length``; the last may be
    shorter.  A null or empty text is the single id ``end``.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owner, piece, start, size, ids = batch.column("doc_id"), [], [], [], [], []
            texts = batch.column("text").to_pylist()
            for k, found in enumerate(encoder(path).encode(texts)):
                whole_ids = np.append(found, np.uint32(end)).astype("<u4")
                for p, s in enumerate(range(0, len(whole_ids), length)):
                    part = whole_ids[s : s + length]
                    owner.append(k)
                    piece.append(p)
                    start.append(s)
                    size.append(len(part))
                    ids.append(part.tobytes())
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(size, pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "piece", "start", "length", "ids"],
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(encode, f"doc_id {kind}, piece int, start bigint, length bigint, ids binary")


class OpenBins:
    """A fixed number of open bins, found by free space through the bits of one integer.

    Bit f is set while a bin with f free places is open.  The best fit for a
    piece of n is the lowest set bit at n or above.  When all bins are open and
    none fits, the fullest, at the lowest bit, closes first.
    """

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits, self.open, self.made = 0, 0, 0
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        name = self.at[free].pop()
        if not self.at[free]:
            self.bits ^= 1 << free
        return name

    def put(self, n: int) -> tuple[int, int]:
        """(bin, offset) for a piece of ``n`` places."""
        fitting = self.bits >> n
        if fitting:
            free = n + (fitting & -fitting).bit_length() - 1
            name = self._take(free)
        else:
            if self.open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.open -= 1
            free, name = self.capacity, self.made
            self.made += 1
            self.open += 1
        left = free - n
        if left:
            self.at[left].append(name)
            self.bits |= 1 << left
        else:
            self.open -= 1
        return name, self.capacity - free


def packed(rows: DataFrame, *, length: int = LENGTH, open_bins: int | None = None, group: int = GROUP) -> DataFrame:
    """``rows``, which have their ``length``, with ``sequence_id`` and ``offset``.

    Pieces are dealt by hash to packers of about ``group`` pieces each, so their
    number grows with the data and none grows without bound.  A packer takes its
    pieces as a stream, longest first, ties by the other columns in turn.  Unless
    ``open_bins`` says otherwise, as many bins stay open as a packer has pieces,
    about: the pieces over half a sequence come first, and each bin they open must
    still be open when the short pieces come.  Only these rows are shuffled, so
    they should be narrow.  Numbers of packer and bin together make the sequence id.
    """
    most = group if open_bins is None else open_bins
    packers = max(1, -(-rows.count() // group))
    names = [c for c in rows.columns if c != "length"]
    dealt = rows.withColumn("_packer", F.pmod(F.xxhash64(*rows.columns), F.lit(packers)).cast("bigint"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), *((c, "ascending") for c in names)])
        bins = OpenBins(length, most)
        put = np.array([bins.put(n) for n in table.column("length").to_pylist()], np.int64).reshape(-1, 2)
        first = table.column("_packer").to_numpy() << 32
        table = table.drop_columns("_packer")
        return table.append_column("sequence_id", pa.array(first + put[:, 0])).append_column("offset", pa.array(put[:, 1]))

    kinds = ", ".join(f"`{n}` {k}" for n, k in rows.dtypes)
    return dealt.groupBy("_packer").applyInArrow(pack, f"{kinds}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = 0, **how) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    Every row is packed; repeated rows are pieces of their own; no rows give no
    rows; other columns are not read.
    """
    made = pieces(docs, path, doc_id=doc_id, text=text, length=length, end=end)
    with small_batches(docs.sparkSession):
        narrow = cut(made.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return packed(narrow, length=length, **how)


def sequences(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = 0, **how) -> DataFrame:
    """(sequence_id, n, ids): the packed sequences themselves, ids as unsigned 32-bit bytes."""
    made = cut(pieces(docs, path, doc_id=doc_id, text=text, length=length, end=end).withColumn("row", F.expr("uuid()")), "zstd")
    placed = packed(made.select("row", "piece", "length"), length=length, **how).select("row", "sequence_id", "offset")
    held = made.join(placed, "row").groupBy("sequence_id").agg(
        F.sum("length").alias("n"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    )
    # at most ``length`` ids in a sequence
    return held.select("sequence_id", "n", F.concat_ws("", F.transform("parts", lambda p: F.hex(p["ids"]))).alias("h")).select(
        "sequence_id", "n", F.unhex("h").alias("ids")
    )
