"""One key with most of the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tieline.functions.skew import attach, heavy_keys


def test_attach_is_a_plain_join_spread_out(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    facts = rows.groupBy("k").agg(F.count("*").alias("n")).where("k <> '9'")
    for how in ("inner", "left"):
        plain = sorted(map(tuple, rows.join(facts, "k", how).collect()), key=str)
        assert sorted(map(tuple, attach(rows, facts, "k", "id", how).collect()), key=str) == plain
    # the hot key reaches the join in more than one partition
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging, "false")
    try:
        placed = attach(rows, facts.hint("merge"), "k", "id").select("k", F.spark_partition_id().alias("p"))
        assert placed.where("k = 'hot'").distinct().count() > 1
    finally:
        spark.conf.set(merging, "true")


def test_only_hot_keys_are_named_and_repeated(spark):
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 10 == 1, "warm").otherwise(F.col("id").cast("string"))
    rows = spark.range(0, 60_000, 1, 8).select(key.alias("k"), "id")
    hot = heavy_keys(rows, "k")
    hashed = {r.k: r.h for r in rows.select("k", F.xxhash64("k").alias("h")).where("k in ('hot', 'warm', '2')").distinct().collect()}
    assert set(hot) == {hashed["hot"], hashed["warm"]}
    assert 21 <= hot[hashed["hot"]] <= 24 and 4 <= hot[hashed["warm"]] <= 7
    assert heavy_keys(rows.where("id < 0"), "k") == {}
    # only facts of hot keys are copied
    facts = rows.groupBy("k").agg(F.count("*").alias("n"))
    copies = attach(facts.withColumn("one", F.lit(1)), facts, "k", "one")
    assert copies.count() == facts.count()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = attach(rows, facts.hint("merge"), "k", "id").select("k", F.spark_partition_id().alias("p"))
        tasks = {r.k: r["count"] for r in placed.where("k in ('hot', '2')").distinct().groupBy("k").count().collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert tasks["hot"] > 3 and tasks["2"] == 1


def test_adaptive_execution_splits_a_hot_key_unless_it_is_grouped_by_again(spark, tmp_path):
    """Why some joins are left to the planner and others are salted."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k) for k in settings}
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string"))
    spark.range(0, 90_000, 1, 8).select(
        key.alias("account_id"), F.sha2(F.col("id").cast("string"), 256).alias("infra")
    ).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    rows.select("account_id").distinct().withColumn("account", F.concat(F.lit("ent_"), "account_id")).write.parquet(
        str(tmp_path / "owners")
    )
    joined = rows.join(spark.read.parquet(str(tmp_path / "owners")), "account_id")
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        split = {}
        for by in ("infra", "account_id"):
            grouped = joined.groupBy(by).agg(F.max("account").alias("account"), F.count("infra").alias("n"))
            grouped.collect()
            split[by] = "skew=true" in grouped._jdf.queryExecution().executedPlan().toString()
        assert split == {"infra": True, "account_id": False}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
