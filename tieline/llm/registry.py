"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
import corpus_pipeline
from tieline.llm import (
    context_tree, exact_dedup, huffman, mixing, ngram_join, packing, pair_ranking, periodic_runs, quality_rules, sharding,
    sql, token_counts, toxicity, whitening,
)
from tieline.llm.text import read_documents

Query = Callable[[SparkSession, str], DataFrame]


def fold(of: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(of))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(4) != 2)
    ranked = pair_ranking.score(docs, pair_ranking.fit(docs, labels))
    return ranked.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score_texts(read_documents(spark, sf_dir), fold(7) == 2)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_groups(read_documents(spark, sf_dir))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text", "lang")
    return quality_rules.judge(docs, lang="lang", reasons=False).drop("text", "lang")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = huffman.through_files(read_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read_documents(spark, sf_dir), 40)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(read_documents(spark, sf_dir)).drop("source")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read_documents(spark, sf_dir), keep="largest")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", periodic_runs.repeated_text().alias("text"))
    found = periodic_runs.periodic_runs(docs).withColumn("best", periodic_runs.strongest(F.col("runs")))
    told = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = [F.col("best")[name].alias(name) for name in ("start", "length", "period")]
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), *best,
        F.floor(1000 * F.col("best")["length"] / F.col("best")["period"]).alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(told, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(3) != 1)
    found = toxicity.score(docs, toxicity.fit(docs, labels))
    return found.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def queries() -> dict[str, Query]:
    return {
        "op1_quality_ranking": op1,
        "op2_context_tree": op2,
        "op3_ngram_join": op3,
        "op4_quality_rules": op4,
        "op5_packing": op5,
        "op6_token_counts": op6,
        "op7_token_files": op7,
        "op8_sharding": op8,
        "op9_mixing": op9,
        "op10_exact_dedup": op10,
        "op11_periodic_runs": op11,
        "op12_whitening": op12,
        "op13_toxicity": op13,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
