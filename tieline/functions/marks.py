"""Bitmaps over hashes of values, small enough to be broadcast whatever the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Values are marked in SLOTS bitmaps of 32,768 bits, 16 MB in all however many
# there are, so the table may be broadcast.
SLOTS = 4_096


def _at(h: Column) -> tuple[Column, Column]:
    """Bitmap and bit that stand for a hash; several values may share them."""
    return F.pmod(h, F.lit(SLOTS)), F.pmod(F.call_function("div", h, F.lit(SLOTS)), F.lit(32_768))


def marks(rows: DataFrame, h: Column) -> DataFrame:
    """(_slot, _words) with a bit for the hash ``h`` of each row."""
    slot, bit = _at(h)
    bits = rows.select(slot.alias("_slot"), bit.alias("_bit")).groupBy("_slot").agg(
        F.bitmap_construct_agg("_bit").alias("_bits")
    )
    # as whole numbers once, so that asking for a bit makes no text
    word = lambda i: F.conv(F.hex(F.substring("_bits", i * 8 + 1, F.lit(8))), 16, -10).cast("bigint")
    return bits.select("_slot", F.transform(F.sequence(F.lit(0), F.lit(511)), word).alias("_words"))


def marked(rows: DataFrame, h: Column, table: DataFrame, is_marked: bool = True) -> DataFrame:
    """Rows whose hash is marked, or those whose hash is not; no row moves.

    All that were marked are among the former, and a few others.
    """
    slot, bit = _at(h)
    at = F.get(F.col("_words"), F.call_function("div", bit, F.lit(64)).cast("int"))
    # bytes lie from the first up, bits in them from the lowest
    place = F.lit(56) - (F.call_function("div", bit, F.lit(8)) % 8 * 8).cast("int") + (bit % 8).cast("int")
    told = F.call_function("shiftright", at, place).bitwiseAND(F.lit(1).cast("bigint")) == 1
    return rows.join(F.broadcast(table), (slot == F.col("_slot")) & told, "left_semi" if is_marked else "left_anti")
