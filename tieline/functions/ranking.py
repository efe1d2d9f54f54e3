"""A global row number without pulling all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieline.functions.lineage import cut


def global_rank(df: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """Add ``name`` = 0, 1, 2, ... in the order of the (together unique) columns.

    Rows are range-partitioned and numbered inside their partition; only one
    count per partition is added up in a single place.
    """
    placed = cut(
        df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    )
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row per partition: its size is the partition count, not the data's
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy(*order)
    return (
        placed.withColumn("_row", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_row") - 1)
        .drop("_part", "_row", "_offset")
    )


def rotate(rank: Column, shift: Column, n: Column) -> Column:
    """Position after moving the first ``shift`` of ``n`` positions to the end."""
    return F.pmod(rank - shift, n)
