"""Joins that stay even when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieline.functions.lineage import cut

SPREAD = 32
TRACKED = 4_096  # counters that each task keeps for the sketch


def heavy_keys(rows: DataFrame, *key: str, spread: int = SPREAD) -> dict[int, int]:
    """Number of tasks that each hot key's rows should be dealt to, by hash of the key.

    A key is hot with more than a 2 * ``spread``-th of all rows; so at most that
    many are named.  They are found by a frequent-items sketch: every task keeps
    ``TRACKED`` counters and sketches are merged, so no key is shuffled.  Counts
    of the sketch are never too small by more than a ``TRACKED``-th of the rows.
    """
    most = 2 * spread
    told = rows.select(F.xxhash64(*key).alias("h")).agg(
        F.expr(f"approx_top_k(h, {most}, {TRACKED})").alias("top"), F.count("*").alias("n")
    ).first()
    return {r["item"]: -(-most * r["count"] // told["n"]) for r in told["top"] or () if r["count"] * most > told["n"]}


def attach(rows: DataFrame, facts: DataFrame, key: str, by: str, how: str = "inner", spread: int = SPREAD) -> DataFrame:
    """Join ``facts``, at most one row per key, onto many rows per key.

    Rows of a hot key are spread over tasks in proportion to its share, by a
    hash of ``by``, and its fact is repeated once per task; all other keys are
    joined plainly.  Meant for joins whose result is grouped by the same key
    again, or whose facts are narrow and rows many: there the planner will not
    split a skewed partition without another shuffle.  The rows are written
    once, because the sketch reads them before the join does.
    """
    rows = cut(rows)
    hot = heavy_keys(rows, key, spread=spread)
    if not hot:
        return rows.join(facts, key, how)
    # at most 2 * spread literals
    salts = F.coalesce(F.create_map(*[F.lit(v) for pair in hot.items() for v in pair])[F.xxhash64(key)], F.lit(1))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), salts).cast("int"))
    repeated = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts.cast("int") - 1)))
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")
