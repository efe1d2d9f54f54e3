"""Shards of nearly equal size by longest-processing-time scheduling of text groups."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tieline.functions.lineage import cut
from tieline.llm.text import content_hash, whole

OVERHEAD = 16  # bytes counted for a document besides its text
FINE = 256  # groups above 1/FINE of a shard are scheduled one by one
BUNDLES = 1024  # bundles of smaller groups for each shard


def least_loaded(items: list[tuple[int, object]], shards: int) -> dict[object, int]:
    """Item -> shard: items by falling size, each to the shard with the least so far."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for size, item in sorted(items, key=lambda x: (-x[0], str(x[1]))):
        load, shard = heap[0]
        placed[item] = shard
        heapq.heapreplace(heap, (load + size, shard))
    return placed


def assign_shards(docs: DataFrame, shards: int = 40, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) per row; law is ``bytes``.

    Rows of equal text stay together.  Groups larger than 1/256 of a shard, of
    which there can be at most 256 per shard, are scheduled one by one; all
    smaller ones are first hashed into 1,024 bundles per shard, which are then
    scheduled like groups.  The heap so sees a number of items that depends on
    the shard count alone, and shards differ by a bundle at most, unless one
    group alone exceeds a shard.  Nulls count as empty texts; null ids come
    first in a shard; repeated rows take a slot each; no rows give no rows.
    """
    t = whole(text)
    rows = cut(
        docs.select(
            F.col(doc_id).alias("doc_id"), (F.octet_length(t) + OVERHEAD).cast("bigint").alias("size"),
            F.crc32(t).alias("text_crc32"), content_hash(t).alias("h"),
        )
    )
    bundle = F.pmod(F.xxhash64("h"), F.lit(shards * BUNDLES)).cast("int")
    groups = cut(rows.groupBy("h").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    total = groups.agg(F.sum("bytes"), F.sum("n")).first()
    bytes_in, rows_in = total[0] or 0, total[1] or 0
    large = F.col("bytes") * (shards * FINE) > bytes_in
    # bounded: at most shards * FINE groups, and shards * BUNDLES bundles
    single = groups.where(large).select("h", "bytes", "n").collect()
    small = groups.where(~large).groupBy(bundle.alias("b")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).collect()
    items = [(r["bytes"], bytes(r["h"])) for r in single] + [(r["bytes"], r["b"]) for r in small]
    placed = least_loaded(items, shards)
    counts = [0] * shards
    for r in single:
        counts[placed[bytes(r["h"])]] += r["n"]
    for r in small:
        counts[placed[r["b"]]] += r["n"]

    spark = docs.sparkSession
    by_hash = spark.createDataFrame([(bytearray(k), s) for k, s in placed.items() if isinstance(k, bytes)], "h binary, own int")
    by_bundle = spark.createDataFrame([(k, s) for k, s in placed.items() if not isinstance(k, bytes)], "b int, shared int")
    # rows of a shard are numbered in parts of equal size, however many it has
    part = max(1, min(100_000, rows_in // 512))
    parts = spark.createDataFrame([(s, -(-n // part) or 1) for s, n in enumerate(counts)], "shard int, parts int")
    here = (
        rows.join(F.broadcast(by_hash), "h", "left")
        .withColumn("b", bundle)
        .join(F.broadcast(by_bundle), "b", "left")
        .withColumn("shard", F.coalesce("own", "shared"))
        .join(F.broadcast(parts), "shard")
        .withColumn("part", F.pmod(F.xxhash64("doc_id", "h"), F.col("parts")).cast("int"))
        .select("doc_id", "size", "text_crc32", "h", "shard", "part")
    )
    sizes = here.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(sizes.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "h")
    return (
        here.withColumn("k", F.row_number().over(inside))
        .join(starts, ["shard", "part"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("start") + F.col("k") - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
