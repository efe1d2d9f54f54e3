"""Mixing sources to target weights from fixed-length blocks of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieline.functions.lineage import cut, scratch
from tieline.llm.text import WORD, running_sums, whole, words

BLOCK = 32  # words
SHARD = 4096  # blocks drawn for an output shard
SLICE = 4096  # draws of a source made into rows together
ROUNDS = 12
WEIGHTS = (5, 2, 1)
MOST = 3  # times a source may be used


def permuted(rows: DataFrame, index: str, size: str, seed: Column, rounds: int = ROUNDS, inverse: bool = False) -> DataFrame:
    """Replace ``index`` in 0..size-1 by its image under a pseudorandom permutation, or the inverse of it.

    The swap-or-not shuffle: each round pairs x with (key - x) mod size and
    exchanges the two or not by one hash bit of the larger, so every round and
    all of them together map the range onto itself, whatever its size.  A round
    undoes itself, so the inverse takes them in turn from the last.
    """
    for r in reversed(range(rounds)) if inverse else range(rounds):
        key = F.pmod(F.xxhash64(seed, F.lit(r)), F.col(size))
        rows = rows.withColumn("_other", F.pmod(key - F.col(index), F.col(size)))
        swap = F.xxhash64(seed, F.lit(r), F.greatest(index, "_other")).bitwiseAND(1) == 1
        rows = rows.withColumn(index, F.when(swap, F.col("_other")).otherwise(F.col(index)))
    return rows.drop("_other")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, rank, target) from (source, source_size), one row per source.

    Sources in code point order, null last, have the weights in turn.  Each gets
    its weight's share of all words, at most ``most`` times its own; what is cut
    off goes to the others by weight.  With sources sorted by cap over weight,
    those before the first that is under its cap are cut, so one pass of running
    sums finds the common level instead of a loop.
    """
    # one row per source: the only windows here that see all rows at once
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1).withColumn(
        "weight", F.element_at(turn, F.col("rank") % len(weights) + 1)
    ).withColumn("cap", most * F.col("source_size"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = lambda whole_, part: F.sum(whole_).over(everything) - F.coalesce(F.sum(part).over(before), F.lit(0))
    ranked = ranked.withColumn("level", left("source_size", "cap") / left("weight", "weight"))
    level = F.max("level").over(everything)
    return ranked.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * level)).select(
        "source", "source_size", "rank", "target"
    )


def mixture(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, shard: int = SHARD, seed: int = 7, name: str | None = None,
) -> dict[str, DataFrame]:
    """What is drawn from where.

    ``documents`` (doc_id, source, tie, rank, size, source_size, target, start):
    one row per input row, with a hash of its text and its place among the words
    of its source; (rank, start) names a row that has words.  ``name``, a column of
    ``docs`` with one number a row, comes along where it is given.
    ``counts`` (shard, rank, n): blocks of each source in each output shard.
    ``slots`` (slot, shard, rank, block): the drawn block for each output slot.
    ``fragments`` (rank, start, block, skip, length, uses): which words of a row a
    block holds and how often the block is drawn.

    The words of a source, rows in order of id, form one sequence cut into
    blocks.  Source counts of the output shards are a multinomial draw without
    replacement: a pseudorandom permutation deals the wanted number of blocks of
    each source over all slots, so the counts of a shard vary like multinomial
    ones while their sums meet the targets within a block.  The k-th draw from a
    source maps through that source's own permutation of its blocks; after the
    last block the next round begins, so no block is used more than ``most``
    times.  Nothing depends on partitioning, so reruns agree.

    Null and empty texts have size 0 and are drawn from never; a null source is a
    source; repeated rows are rows of their own; no rows give no rows.
    """
    t = whole(text)
    sized = cut(
        docs.select(
            F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
            F.regexp_count(t, F.lit(WORD)).cast("bigint").alias("size"), F.xxhash64(t).alias("tie"),
            *([F.col(name).alias("name")] if name else []),
        )
    )
    shares = cut(
        targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
        .withColumn("blocks", F.ceil(F.col("source_size") / block).cast("bigint"))
        .withColumn("draws", F.least(F.round(F.col("target") / block).cast("bigint"), most * F.col("blocks")))
        .withColumn("upto", F.sum("draws").over(Window.orderBy("rank")))
    )
    placed = running_sums(sized, ["source"], ["doc_id", "tie"], "size", "start")
    attach = placed["source"].eqNullSafe(shares["source"])
    documents = cut(
        placed.join(shares, attach)
        .select("doc_id", placed["source"], "tie", "rank", "size", "source_size", "target", "start", *(["name"] if name else []))
    )
    total = shares.agg(F.max("upto")).first()[0] or 0
    spark = docs.sparkSession
    # each draw of a source becomes a row, in slices so that a large source is not one task's; the
    # inverse permutation tells its slot
    drawn = shares.where("draws > 0").select(
        "rank", "blocks", "draws", (F.col("upto") - F.col("draws")).alias("low"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(draws - 1) div {SLICE}"))).alias("part"),
    )
    tasks = max(spark.sparkContext.defaultParallelism, total >> 20)
    until = F.least((F.col("part") + 1) * SLICE, "draws") - 1
    slots = drawn.repartition(tasks, "rank", "part").select(
        "rank", "blocks", "low", F.explode(F.sequence(F.col("part") * SLICE, until)).alias("k")
    )
    slots = slots.withColumn("slot", F.col("low") + F.col("k")).withColumn("of", F.lit(max(total, 1)).cast("bigint"))
    slots = permuted(slots, "slot", "of", F.lit(seed), inverse=True).withColumn("block", F.pmod("k", "blocks"))
    slots = permuted(slots, "block", "blocks", F.xxhash64(F.lit(seed), "rank"))
    # written, because filters pushed through the rounds would double with each of them
    slots = cut(slots.select("slot", F.floor(F.col("slot") / shard).alias("shard"), "rank", "block"))
    uses = slots.groupBy("rank", "block").agg(F.count("*").alias("uses"))
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    pieces = documents.where("size > 0").select(
        "rank", "start", "size", F.explode(F.sequence(first, last)).alias("block")
    )
    begin = F.greatest(F.col("block") * block, "start")
    pieces = pieces.select(
        "rank", "start", "block", (begin - F.col("start")).alias("skip"),
        (F.least((F.col("block") + 1) * block, F.col("start") + F.col("size")) - begin).alias("length"),
    )
    return {
        "documents": documents,
        "counts": slots.groupBy("shard", "rank").agg(F.count("*").alias("n")),
        "slots": slots,
        "fragments": pieces.join(uses, ["rank", "block"]),
    }


def mixed_sizes(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) per row; ``taken`` counts repeats."""
    made = mixture(docs, **how)
    taken = made["fragments"].groupBy("rank", "start").agg(F.sum(F.col("length") * F.col("uses")).alias("words"))
    rows = made["documents"]
    # rows without words share their start with the next row of the source
    joined = rows.where("size > 0").join(taken, ["rank", "start"], "left")
    empty = rows.where("size = 0").withColumn("words", F.lit(None).cast("bigint"))
    return joined.unionByName(empty).select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("words", F.lit(0)).alias("taken")
    )


def mixed_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix as documents with all their columns: one row for each time a row is used.

    The k-th row of a document holds its words that are drawn at least k times,
    so all rows together hold every word as often as it was taken.  A row used
    whole keeps its text, another has its words joined by spaces, and ``n_chars``
    follows.  Rows that nothing is drawn from are not in the mix.

    Rows are numbered once, in a written table, and meet their draws by that
    number, so texts move once and only those that are drawn from.
    """
    rows = cut(docs.select(F.struct(*docs.columns).alias("_row"), F.monotonically_increasing_id().alias("_name")), "zstd")
    given = lambda c: F.col("_row")[c].alias(f"_{c}")
    keys = rows.select("_name", given(doc_id), given(text), given(source))
    # of what is written to find the draws only the plan stays
    with scratch(docs.sparkSession) as kept:
        made = mixture(keys, doc_id=f"_{doc_id}", text=f"_{text}", source=f"_{source}", name="_name", **how)
        drawn = made["fragments"].groupBy("rank", "start").agg(
            F.array_sort(F.collect_list(F.struct("skip", "length", "uses"))).alias("parts"), F.max("uses").alias("times")
        )
        plan = kept(
            made["documents"].where("size > 0").join(drawn, ["rank", "start"])
            .select(F.col("name").alias("_name"), "size", "parts", "times")
        )
    used = rows.join(plan, "_name").select("_row", "size", "parts", F.explode(F.sequence(F.lit(1).cast("bigint"), "times")).alias("k"))
    used = used.withColumn("parts", F.filter("parts", lambda p: p["uses"] >= F.col("k")))
    used = used.withColumn("held", F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, p: a + p["length"]))
    body = F.col("_row")[text]
    used = used.withColumn("words", F.when(F.col("held") < F.col("size"), words(body)))
    taken = F.flatten(F.transform("parts", lambda p: F.slice("words", (p["skip"] + 1).cast("int"), p["length"].cast("int"))))
    used = used.withColumn("mixed", F.when(F.col("held") < F.col("size"), F.array_join(taken, " ")).otherwise(body))
    new = {text: F.col("mixed"), "n_chars": F.length("mixed").cast("bigint")}
    return used.select(*(new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))
