"""Exact duplicates: group by a 128-bit content hash, compare bytes, keep one id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieline.functions.lineage import cut
from tieline.llm.text import content_hash, told_apart, whole


def exact_groups(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", keep: str = "smallest",
    hashed: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per input row.

    Texts are equal when their bytes are; null counts as empty.  The row with
    the ``keep`` ("smallest" or "largest") id of its group stays.  A null id
    never stays while its group has another id; a group of null ids only keeps
    all of them.  Rows that repeat both the id and the text share one decision.
    No rows in give no rows out.  Other columns are not read.

    Hashes are counted first; only texts whose hash may be a repeated one, by a bit
    table of fixed size, move.  They are grouped by hash and bytes together, which
    combines map-side, so a group of any size leaves one row per task.  What returns
    to the rows is one narrow line per repeated hash.  Rows of a hash that stands
    for several texts are grouped again by their bytes.
    """
    choose = {"smallest": F.min, "largest": F.max}[keep]
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("t"))
    marked = rows.withColumn("h", hashed(F.col("t")))
    often = cut(marked.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    texts = told_apart(marked, "h", often)[0].groupBy("h", "t").agg(F.count("*").alias("n"), choose("doc_id").alias("keep_id"))
    repeated = cut(
        texts.groupBy("h")
        .agg(F.count("*").alias("variants"), F.sum("n").alias("n"), choose("keep_id").alias("keep_id"))
        .where("n > 1")
    )
    narrow = lambda df: df.select("doc_id", "h", F.unhex(F.sha2("t", 256)).alias("sha"))
    clashes = repeated.where("variants > 1").select("h")
    if clashes.isEmpty():
        found = narrow(marked).join(repeated.drop("variants"), "h", "left")
    else:
        clear = narrow(marked.join(clashes, "h", "left_anti")).join(repeated.drop("variants"), "h", "left")
        mixed = marked.join(clashes, "h", "left_semi")
        apart = mixed.groupBy("h", "t").agg(F.count("*").alias("n"), choose("doc_id").alias("keep_id"))
        told = narrow(mixed).join(
            apart.select("h", F.unhex(F.sha2("t", 256)).alias("sha"), "n", "keep_id"), ["h", "sha"]
        )
        found = clear.unionByName(told)
    keep_id = F.coalesce("keep_id", "doc_id")
    return found.select(
        "doc_id", keep_id.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, **how) -> DataFrame:
    """One row of each text, with all its columns.

    It is the row that ``exact_groups`` keeps.  Of rows that repeat both its id
    and its text, null ids included, the one that is smallest as JSON stays.
    """
    doc_id, text = how.get("doc_id", "doc_id"), how.get("text", "text")
    sha = lambda df: F.sha2(whole(df[text]), 256)
    same = lambda df, ids: df[doc_id].eqNullSafe(ids["_id"]) & (sha(df) == ids["_sha"])
    told = cut(exact_groups(docs, **how).where("group_size > 1").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), "kept"))

    def without(df: DataFrame, ids: DataFrame) -> DataFrame:
        # only rows whose id may be one of these are compared with them
        some, rest = told_apart(df, doc_id, ids.select(F.col("_id").alias(doc_id)))
        return rest.union(some.join(ids, same(some, ids), "left_anti"))

    gone = cut(told.where(~F.col("kept")).select("_id", "_sha").distinct())
    again = cut(told.where("kept").groupBy("_id", "_sha").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    left = without(docs, gone)
    if again.isEmpty():
        return left
    row = F.struct(*docs.columns)
    held = docs.join(again, same(docs, again), "left_semi").select(docs[doc_id].alias("_id"), sha(docs).alias("_sha"), row.alias("_row"))
    first = held.groupBy("_id", "_sha").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
    return without(left, again).unionByName(first.select("_row.*"))
