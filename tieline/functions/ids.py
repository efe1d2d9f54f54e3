"""Identifiers, hashes and money as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entity_id(node_type: Column, key: Column) -> Column:
    """Node id from type and whole key; distinct keys can never share an id."""
    return F.concat(F.lit("ent_"), F.lower(F.substring(node_type, 1, 3)), F.lit("_"), key)


def digest_id(prefix: str, *fields: Column) -> Column:
    """``prefix_`` + 20 hex digits over all fields as a JSON list, so neither nulls nor separators clash."""
    return F.concat(
        F.lit(f"{prefix}_"), F.substring(F.sha2(F.to_json(F.array(*[f.cast("string") for f in fields])), 256), 1, 20)
    )


def payload_hash(**fields: Column) -> Column:
    """SHA-256 of the JSON object with its keys in sorted order and nulls left out."""
    ordered = [fields[name].alias(name) for name in sorted(fields)]
    return F.sha2(F.to_json(F.struct(*ordered)), 256)


def anonymised_key(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(value, 256), 1, 16))


def slug_id(prefix: str, value: Column) -> Column:
    """Readable id: lower-case words joined by '-', at most 56 characters."""
    words = F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-")
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.regexp_replace(words, "^-+|-+$", ""), 1, 56))


def node_label(node_type: Column, key: Column) -> Column:
    return F.concat(F.substring(node_type, 1, 3), F.lit("·"), F.right(key, F.lit(8)))


def to_minor(major: Column) -> Column:
    """Major to minor currency units, half up on the exact decimal value."""
    return F.floor(major.cast("decimal(28,6)") * 100 + F.lit("0.5").cast("decimal(2,1)")).cast("bigint")


def to_major(minor: Column) -> Column:
    return minor.cast("decimal(28,0)") / F.lit(100)


def money_text(minor: Column) -> Column:
    """Major units with thousands separators; two decimals only where needed."""
    whole = F.pmod(minor, F.lit(100)) == 0
    major = to_major(minor)
    return F.when(whole, F.format_number(major, 0)).otherwise(F.format_number(major, 2))


def line_total(unit_minor: Column, quantity: Column) -> Column:
    """Unit price times quantity; fails the job on a fractional or negative input."""
    bad_price = unit_minor != F.floor(unit_minor)
    bad_quantity = (quantity != F.floor(quantity)) | (quantity < 0)
    return (
        F.when(bad_price, F.raise_error(F.lit("unit price must be whole minor units")))
        .when(bad_quantity, F.raise_error(F.lit("quantity must be a whole number, not negative")))
        .otherwise(unit_minor.cast("bigint") * quantity.cast("bigint"))
    )
