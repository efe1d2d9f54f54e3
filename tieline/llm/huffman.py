"""Token ids in files of canonical, length-limited Huffman codes, read back by table."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tieline.functions.lineage import checkpoint_dir, cut
from tieline.llm.encoding import encoder
from tieline.llm.text import small_batches, whole

LONGEST = 20  # bits of a code
BLOCK = 1 << 16  # ids in a block, unless one document has more
STEP = 256  # ids between two checkpoints


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Best code lengths up to ``longest`` by package-merge; 0 for symbols that do not occur.

    Each level holds the single symbols and the pairs of the level below, by
    weight.  Of the last level as many items are taken as a full tree needs; the
    symbols among them are the lightest, the pairs ask for twice as many items a
    level below.  A symbol's length is the number of levels that took it.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << longest:
        raise ValueError("too many symbols for the longest code")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    levels, pairs = [], np.empty(0)
    for _ in range(longest):
        merged = np.concatenate([weights, pairs])
        by = np.argsort(merged, kind="stable")
        levels.append(by < len(weights))
        merged = merged[by]
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    take = 2 * len(used) - 2
    for single in reversed(levels):
        n = int(single[:take].sum())
        lengths[order[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then symbol."""
    codes = np.zeros(len(lengths), np.uint32)
    code, last = 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for s in order[lengths[order] > 0]:
        code <<= int(lengths[s]) - last
        last = int(lengths[s])
        codes[s] = code
        code += 1
    return codes


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes of ``ids`` one after another, and the bit at which every STEP-th begins."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    at = end - size
    value = codes[ids].astype(np.int64) << (32 - size - (at & 7))  # at most 27 bits from a byte's first
    total = int(end[-1]) if len(end) else 0
    room = (total + 7) // 8 + 4
    out = np.zeros(room)
    for k in range(4):  # bits of different codes never meet, so sums are unions
        out += np.bincount((at >> 3) + k, (value >> (24 - 8 * k)) & 255, room)
    return out.astype(np.uint8)[: (total + 7) // 8].tobytes(), at[::STEP].astype("<u8")


def decode_table(lengths: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, length) for every pattern of the next ``longest`` bits."""
    symbol, size = np.zeros(1 << longest, np.uint32), np.ones(1 << longest, np.uint8)
    codes = canonical(lengths)
    for s in np.flatnonzero(lengths):
        n = int(lengths[s])
        a = int(codes[s]) << (longest - n)
        symbol[a : a + (1 << (longest - n))] = s
        size[a : a + (1 << (longest - n))] = n
    return symbol, size


def unpack_bits(payload: bytes, points: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray], longest: int) -> np.ndarray:
    """The ids of a block: all its checkpoints advance together, one id a step."""
    symbol, size = table
    data = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
    window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    bit = points.astype(np.int64)
    out = np.zeros((STEP, len(bit)), np.uint32)
    last = len(window) - 1
    for t in range(min(STEP, n)):
        at = ((window[np.minimum(bit >> 3, last)] << (bit & 7).astype(np.uint32)) >> np.uint32(32 - longest)).astype(np.int64)
        out[t] = symbol[at]
        bit += size[at]
    return out.T.ravel()[:n]


def token_ids(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", end: int = 2) -> DataFrame:
    """(doc_id, n, ids): ids of the whole text and ``end``, unsigned 16 or 32 bit by size of the vocabulary."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = id_type(path)
        for batch in batches:
            ids = [np.append(x, np.uint32(end)).astype(kind) for x in encoder(path).encode(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                ["doc_id", "n", "ids"],
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))
    return rows.mapInArrow(encode, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n bigint, ids binary")


def id_type(path: str) -> str:
    return "<u2" if encoder(path).library.get_vocab_size() <= 1 << 16 else "<u4"


def id_counts(tokens: DataFrame, path: str) -> DataFrame:
    """(id, n) over all rows; each task adds up its own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = id_type(path)
        total = np.zeros(0, np.int64)
        for batch in batches:
            ids = np.concatenate([np.frombuffer(x, kind) for x in batch.column("ids").to_pylist()] or [np.empty(0, kind)])
            found = np.bincount(ids, minlength=len(total))
            found[: len(total)] += total
            total = found
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    return tokens.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(tokens: DataFrame, path: str, folder: str) -> None:
    """Write (doc_id, n, ids) rows as blocks of codes in ascending order of doc_id.

    ``folder/codes`` has the code length of each id that occurs; ``folder/blocks``
    one row per block: its part and place, the ids and documents before it in the
    part, its documents' ids and sizes, the checkpoints and the codes.  A block
    holds whole documents and decodes by itself.  Parts are ranges of doc_id,
    nulls first; files of a part that is written again replace nothing, as
    Spark's commit keeps one attempt.
    """
    spark = tokens.sparkSession
    # bounded by the vocabulary
    found = id_counts(tokens, path).collect()
    counts = np.zeros(max((r["id"] for r in found), default=0) + 1, np.int64)
    for r in found:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    rows = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(rows, "id bigint, bits int").coalesce(1).write.parquet(f"{folder}/codes")
    sent = spark.sparkContext.broadcast((canonical(lengths), lengths))
    key = tokens.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sizes = sent.value
        part, kind = TaskContext.get().partitionId(), id_type(path)
        block, before, docs_before = 0, 0, 0
        keys, held, n = [], [], 0

        def closed():
            ids = np.concatenate(held)
            payload, points = pack_bits(ids, codes, sizes)
            each = np.array([len(x) for x in held], "<u4")
            values = [[part], [block], [before], [docs_before], [len(ids)], [each.tobytes()], [points.tobytes()], [payload]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            names = ["part", "block", "before", "docs_before", "n", "sizes", "points", "payload"]
            arrays = [pa.array(v, k) for v, k in zip(values, kinds)] + [pa.ListArray.from_arrays([0, len(keys)], pa.array(keys, keys_type))]
            return pa.RecordBatch.from_arrays(arrays, [*names, "doc_ids"])

        keys_type = pa.int64()
        for batch in batches:
            keys_type = batch.column("doc_id").type
            for k, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                ids = np.frombuffer(ids, kind)
                if held and n + len(ids) > BLOCK:
                    yield closed()
                    block, before, docs_before = block + 1, before + n, docs_before + len(held)
                    keys, held, n = [], [], 0
                keys.append(k)
                held.append(ids)
                n += len(ids)
        if held:
            yield closed()

    schema = (
        "part int, block int, before bigint, docs_before bigint, n bigint, sizes binary, points binary, payload binary, "
        f"doc_ids array<{key}>"
    )
    ordered = tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("ids"))
    # codes do not compress any further
    ordered.mapInArrow(encode, schema).write.option("compression", "none").parquet(f"{folder}/blocks")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files; ids as unsigned 32-bit bytes.

    ``start`` is the number of ids of all documents before it.
    """
    blocks = spark.read.parquet(f"{folder}/blocks")
    # bounded by the vocabulary
    table = spark.read.parquet(f"{folder}/codes").collect()
    lengths = np.zeros(max((r["id"] for r in table), default=0) + 1, np.uint8)
    for r in table:
        lengths[r["id"]] = r["bits"]
    sent = spark.sparkContext.broadcast(lengths)
    parts = blocks.groupBy("part").agg(F.sum("n").alias("n"))
    # one row per part of the files
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = cut(parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift")))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = int(sent.value.max(initial=1))
        table = decode_table(sent.value, longest)
        for batch in batches:
            for row in range(batch.num_rows):
                cell = {c: batch.column(c)[row] for c in batch.schema.names}
                sizes = np.frombuffer(cell["sizes"].as_py(), "<u4").astype(np.int64)
                ids = unpack_bits(cell["payload"].as_py(), np.frombuffer(cell["points"].as_py(), "<u8"), cell["n"].as_py(), table, longest)
                ends = np.cumsum(sizes)
                data = ids.astype("<u4").tobytes()
                begin = cell["before"].as_py() + cell["shift"].as_py() + ends - sizes
                yield pa.RecordBatch.from_arrays(
                    [cell["doc_ids"].values, pa.array(begin), pa.array(sizes),
                     pa.array([data[4 * a : 4 * b] for a, b in zip((ends - sizes).tolist(), ends.tolist())], pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    key = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    return blocks.join(F.broadcast(shifts), "part").mapInArrow(decode, f"doc_id {key}, start bigint, n_tokens bigint, ids binary")


def through_files(docs: DataFrame, path: str, *, folder: str | None = None, **how) -> DataFrame:
    """Encode ``docs``, write the ids to ``folder`` and read them back.

    Null and empty texts are the end id alone; repeated rows are written each,
    ordered by their ids; no rows give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/{spark.sparkContext.applicationId}/ids-{uuid.uuid4().hex}"
    with small_batches(spark):
        write_ids(cut(token_ids(docs, path, **how), "zstd"), path, folder)
    return read_ids(spark, folder)
