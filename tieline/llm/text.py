"""Text expressions and running sums shared by the operators, all built-in functions."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieline.functions.lineage import cut

SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@contextmanager
def small_batches(spark, rows: int = 1000) -> Iterator[None]:
    """Jobs that run inside send whole texts to Python a few megabytes at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def read_documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole(text: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def lowered(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def content_hash(text: Column) -> Column:
    """128 bits of SHA-256 as 16 bytes."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def running_sums(rows: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the group that come before.

    Rows are range-partitioned by group and order, so one hot group spreads over
    many tasks.  Only one sum per range and group is added up across ranges.
    ``rows`` is read more than once and should be a written table.
    """
    placed = cut(rows.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()))
    totals = placed.groupBy("_range", *group).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select("_range", *group, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_shift"))
    shifts = cut(shifts)
    inside = Window.partitionBy("_range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = placed.withColumn("_before", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = [here["_range"] == shifts["_range"], *(here[g].eqNullSafe(shifts[g]) for g in group)]
    return here.join(shifts, same).select(*(here[c] for c in rows.columns), (F.col("_shift") + F.col("_before")).alias(name))


BITS = 1 << 24


def place(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITS))


def bit_table(rows: DataFrame, key: str = "doc") -> DataFrame:
    """(w, bits) with a bit for the place of every ``key``: BITS / 32 rows at most, whatever the input."""
    placed = rows.select(place(key).alias("p"))
    return placed.groupBy(F.shiftright("p", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 31 AS int)))").alias("bits"))


def told_apart(rows: DataFrame, key: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``key`` may be among those of ``wanted``, which are all that are and few others, and the rest; no row moves."""
    table = F.broadcast(cut(bit_table(wanted, key).toDF("_w", "_bits")))
    marked = rows.withColumn("_p", place(key)).withColumn("_w", F.shiftright("_p", 5)).join(table, "_w", "left")
    may = F.coalesce(F.expr("shiftright(_bits, cast(_p & 31 AS int)) & 1") == 1, F.lit(False))
    return tuple(marked.where(c).drop("_p", "_w", "_bits") for c in (may, ~may))
