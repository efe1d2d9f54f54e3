"""Screening of free text and masking of personal data, as jobs over columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tieline.functions.patterns import java
from tieline.vocabulary import (
    CARD_NUMBER,
    EVASION_RULES,
    EXCERPT_CHARS,
    INJECTION_RULES,
    MASK,
    NESTING_LIMIT,
    PERSONAL_KEYS,
)

REFUSAL = (
    "Questions about why accounts look connected are answered; guidance on avoiding detection, "
    "breaking links, running several accounts unnoticed or disguising activity is not."
)
IN_SCOPE = "The question is within the scope of this analysis."


def _findings(text: Column, rules: Mapping[str, str]) -> Column:
    """First match of each rule that fires, over the whole text."""
    found = []
    for rule, pattern in rules.items():
        match = F.regexp_extract(text, java(pattern), 0)
        found.append(
            F.when(
                match != "",
                F.struct(F.lit(rule).alias("rule"), F.substring(match, 1, EXCERPT_CHARS).alias("excerpt")),
            )
        )
    return F.array_compact(F.array(*found))


def text_scan(df: DataFrame, text: str, rules: Mapping[str, str], *keep: str) -> DataFrame:
    """One row per text and rule that fires: kept columns, rule, excerpt."""
    return df.select(*keep, F.explode(_findings(F.col(text), rules)).alias("finding")).select(*keep, "finding.*")


def injection_scan(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """Text addressed to the analysis instead of describing events."""
    return text_scan(df, text, INJECTION_RULES, *keep)


def rule_counts(scanned: DataFrame, rules: Mapping[str, str] = INJECTION_RULES) -> DataFrame:
    """Hits of every rule, silent ones included."""
    spark = scanned.sparkSession
    names = spark.createDataFrame([(r,) for r in rules], "rule string")
    hits = scanned.groupBy("rule").agg(F.count("*").alias("hits"))
    # one row per rule on either side
    return names.join(hits, "rule", "left").select("rule", F.coalesce("hits", F.lit(0)).alias("hits"))


def evasion_check(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """Whether each question asks for help against the detector, with the first rule."""
    findings = _findings(F.coalesce(F.col(text), F.lit("")), EVASION_RULES)
    return df.select(*keep, findings.alias("found")).select(
        *keep,
        (F.size("found") > 0).alias("refused"),
        F.get("found", F.lit(0))["rule"].alias("rule"),
        F.when(F.size("found") > 0, REFUSAL).otherwise(IN_SCOPE).alias("message"),
    )


# --- nested values -----------------------------------------------------------
def _leaves(df: DataFrame, value: str, root: str) -> DataFrame:
    """(all columns, path, leaf, is_text) for a JSON text column, to the nesting limit.

    Objects and arrays are opened level by level; a value that is neither passes
    through.  Text that is no JSON gives no rows.
    """
    spark = df.sparkSession
    plain = lambda v: ~F.schema_of_variant(v).rlike("^(OBJECT|ARRAY|VOID)")
    opened = df.withColumns({"_value": F.try_parse_json(value), "_path": F.lit(root)}).where(
        F.col("_value").isNotNull()
    )
    names = opened.columns
    for _ in range(NESTING_LIMIT):
        parts = spark.tvf.variant_explode_outer(F.col("_value").outer())
        step = (
            F.when(F.col("value").isNull(), F.lit(""))
            .when(F.col("key").isNotNull(), F.concat(F.lit("."), "key"))
            .otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        )
        opened = (
            opened.withColumnsRenamed({"key": "_key", "pos": "_pos", "value": "_val"})
            if {"key", "pos", "value"} & set(names)
            else opened
        )
        opened = (
            opened.lateralJoin(parts)
            .withColumn("_path", F.concat("_path", step))
            .withColumn("_value", F.coalesce("value", "_value"))
            .drop("key", "pos", "value")
        )
    return opened.where(plain("_value")).select(
        *df.columns,
        F.col("_path").alias("path"),
        F.col("_value").cast("string").alias("leaf"),
        (F.schema_of_variant("_value") == "STRING").alias("is_text"),
    )


def metadata_scan(df: DataFrame, value: str, *keep: str, root: str = "metadata") -> DataFrame:
    """Injection rules over every text leaf of a JSON column, with the leaf's path."""
    leaves = _leaves(df.select(*keep, value), value, root)
    return injection_scan(leaves.where("is_text"), "leaf", *keep, "path")


def personal_data(df: DataFrame, value: str, *keep: str) -> DataFrame:
    """Paths of a JSON column that hold raw personal data: by key, or card-like digits.

    Keys are told where an object is opened, whatever their value, down to
    objects at the nesting limit; text is looked at down to the same depth.  A
    personal key is reported once and not looked into.
    """
    state = df.select(
        F.struct(F.lit(0), *keep).alias("kept"), F.try_parse_json(value).alias("held"), F.lit("$").alias("path"),
        F.lit(None).cast("string").alias("found"),
    )
    tvf = df.sparkSession.tvf
    for depth in range(NESTING_LIMIT + 1):
        entries = tvf.variant_explode_outer(F.col("held").outer())
        entry = F.col("pos").isNotNull()
        name = F.concat("path", F.when(F.col("key").isNotNull(), F.concat(F.lit("."), "key")).otherwise(
            F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))
        ))
        personal = F.coalesce(F.lower("key").isin(*PERSONAL_KEYS), F.lit(False))
        within = F.col("value") if depth < NESTING_LIMIT else F.lit(None).cast("variant")
        state = state.lateralJoin(entries).select(
            "kept", F.when(~entry, F.col("held")).when(~personal, within).alias("held"),
            F.when(entry, name).otherwise(F.col("path")).alias("path"),
            F.coalesce("found", F.when(personal, name)).alias("found"),
        )
    card = (F.schema_of_variant("held") == "STRING") & F.col("held").cast("string").rlike(java(CARD_NUMBER))
    told = F.coalesce("found", F.when(card, F.concat("path", F.lit(" (card number)"))))
    named = [F.col("kept")[k].alias(k) for k in keep]
    return state.select(*named, told.alias("path")).where(F.col("path").isNotNull()).distinct()


# --- masking -------------------------------------------------------------------
# The card pattern with its last four digits as groups.
_CARD_TAIL = r"\b(?:\d[ -]?){9,15}(\d)[ -]?(\d)[ -]?(\d)[ -]?(\d)[ -]?\b"


def mask_text(text: Column) -> Column:
    """Card-like digit runs shortened to their last four digits."""
    return F.regexp_replace(text, java(_CARD_TAIL), "card ending $1$2$3$4")


def _mask_value(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return mask_text(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: _mask_value(v, kind.elementType))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        personal = lambda k: F.lower(k).isin(*PERSONAL_KEYS)
        if isinstance(kind.valueType, T.StringType):
            return F.transform_values(value, lambda k, v: F.when(personal(k), MASK).otherwise(mask_text(v)))
        return F.transform_values(
            value, lambda k, v: F.when(~personal(k), _mask_value(v, kind.valueType))
        )
    if isinstance(kind, T.StructType):
        fields = [
            (
                F.lit(MASK) if f.name.lower() in PERSONAL_KEYS else _mask_value(value[f.name], f.dataType)
            ).alias(f.name)
            for f in kind.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def mask_columns(df: DataFrame) -> DataFrame:
    """Mask personal columns by name and card-like digits in every text, at any depth.

    The walk is over the schema when the plan is built, not over rows.
    """
    return df.select(
        *[
            (
                F.lit(MASK) if f.name.lower() in PERSONAL_KEYS else _mask_value(F.col(f.name), f.dataType)
            ).alias(f.name)
            for f in df.schema.fields
        ]
    )


def personal_columns(df: DataFrame, *text_columns: str) -> DataFrame:
    """Rows with card-like digits per text column."""
    return df.agg(
        *[F.count_if(F.col(c).rlike(java(CARD_NUMBER))).alias(c) for c in text_columns]
    ).unpivot([], list(text_columns), "column", "rows_with_card_numbers")
