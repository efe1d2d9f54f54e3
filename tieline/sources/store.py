"""Parquet sinks with the write semantics the tables need."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tieline.functions.lineage import cut

BUCKET, BUCKETS = "key_bucket", 64
FILTER_BITS, HASHES = 2**22, 3  # of each bucket: half a megabyte, for some 500,000 keys


def _write_half(edges: DataFrame, path: str, derived: bool) -> None:
    # the folder of the half is replaced as a whole, so an empty frame leaves an empty half
    edges.drop("derived").write.mode("overwrite").parquet(f"{path}/derived={str(derived).lower()}")


def replace_inferred(edges: DataFrame, path: str) -> None:
    """Replace the inferred half of an edge table and leave the observed half alone."""
    _write_half(edges, path, True)


def write_observed(edges: DataFrame, path: str) -> None:
    """Replace the observed half and leave the inferred half alone."""
    _write_half(edges, path, False)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    # a folder name only tells the text, not the boolean
    return spark.read.parquet(path).withColumn("derived", F.col("derived").cast("boolean"))


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _bucket(key: tuple[str, ...]) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _marks(rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """One row for each bit that a key sets: the key, and the place of the bit."""
    places = [F.col(BUCKET) * F.lit(FILTER_BITS) + F.pmod(F.xxhash64(F.lit(k), *key), F.lit(FILTER_BITS)) for k in range(HASHES)]
    place = rows.select(*key, F.explode(F.array(*[p.cast("bigint") for p in places])).alias("place"))
    return place.select(*key, F.bitmap_bucket_number("place").alias("slot"), F.bitmap_bit_position("place").alias("bit"))


def possible_repeats(rows: DataFrame, path: str, *key: str) -> DataFrame:
    """Keys of ``rows`` all of whose bits are set in the stored filter; no other key can be stored."""
    done = _generations(rows.sparkSession, f"{path}/filter")
    marked = _marks(rows, key)
    if not done:
        return rows.select(*key).limit(0)
    stored = rows.sparkSession.read.parquet(f"{path}/filter/generation={done[-1]:06d}")
    byte = F.conv(F.hex(F.substring("bits", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(F.expr("shiftright(byte, cast(bit % 8 as int))").bitwiseAND(1) == 1, F.lit(False))
    hits = marked.join(stored, "slot", "left").withColumn("byte", byte).select(*key, is_set.alias("hit"))
    return hits.groupBy(*key).agg(F.every("hit").alias("all")).where("all").select(*key)


def insert_new(rows: DataFrame, path: str, *key: str) -> None:
    """Insert the rows whose key is not stored yet; running it twice changes nothing.

    The table lies in ``BUCKETS`` folders by hash of the key, with a Bloom filter
    of ``FILTER_BITS`` bits a bucket beside it.  Only keys that the filter can't
    exclude meet stored ones, and only in their buckets.  The filter is written
    before the rows: after a crash between the two it knows too many keys, which
    costs a look and loses nothing.  Of new rows with one key the first in the
    order of all columns is taken.
    """
    spark = rows.sparkSession
    first = Window.partitionBy(*key).orderBy(*rows.columns)
    fresh = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").withColumn(BUCKET, _bucket(key))
    fresh = cut(fresh)
    repeats = cut(possible_repeats(fresh, path, *key).withColumn(BUCKET, _bucket(key)))
    within = [r[0] for r in repeats.select(BUCKET).distinct().collect()]  # at most BUCKETS numbers
    if within and _exists(spark, f"{path}/rows"):
        stored = spark.read.parquet(f"{path}/rows").where(F.col(BUCKET).isin(within)).select(*key)
        fresh = cut(fresh.join(stored.join(repeats, list(key), "left_semi"), list(key), "left_anti"))
    bits = _marks(fresh, key).groupBy("slot").agg(F.bitmap_construct_agg("bit").alias("bits"))
    done = _generations(spark, f"{path}/filter")
    if done:
        bits = bits.union(spark.read.parquet(f"{path}/filter/generation={done[-1]:06d}"))
    number = done[-1] + 1 if done else 1
    bits.groupBy("slot").agg(F.bitmap_or_agg("bits").alias("bits")).write.mode("overwrite").parquet(f"{path}/filter/generation={number:06d}")
    fresh.write.mode("append").partitionBy(BUCKET).parquet(f"{path}/rows")
    for old in done:
        _delete(spark, f"{path}/filter/generation={old:06d}")


def read_inserted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").drop(BUCKET)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def merged(stored: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """Both, with the row of the latest version per key; incoming wins a tie.

    The row is an aggregate, so versions of one key combine map-side.
    """
    both = stored.withColumn("_new", F.lit(0)).unionByName(
        incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True
    )
    columns = [c for c in both.columns if c != "_new"]
    latest = F.max_by(F.struct(*columns), F.struct(version, "_new"))
    return both.groupBy(F.col(key).alias("_key")).agg(latest.alias("_row")).select("_row.*")


def _generations(spark: SparkSession, path: str, prefix: str = "generation=") -> list[int]:
    """Numbers of the complete folders ``prefix`` + number."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    done = []
    for entry in fs.listStatus(root):
        place = entry.getPath()
        if place.getName().startswith(prefix) and fs.exists(
            spark._jvm.org.apache.hadoop.fs.Path(place, "_SUCCESS")
        ):
            done.append(int(place.getName().split("=")[1]))
    return sorted(done)


def manifest(spark: SparkSession, path: str) -> dict[int, str]:
    """Folder of each bucket in the newest complete manifest; at most ``BUCKETS`` entries."""
    done = _generations(spark, path, "manifest=")
    rows = spark.read.parquet(f"{path}/manifest={done[-1]:06d}").collect() if done else []
    return {r["bucket"]: r["folder"] for r in rows}


def read_latest(spark: SparkSession, path: str) -> DataFrame | None:
    """An upserted table as its newest manifest names it; None where none was written."""
    folders = manifest(spark, path)
    return _read_folders(spark, path, sorted(folders.values())) if folders else None


def _read_folders(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(*[f"{path}/{f}" for f in folders])


def upsert(incoming: DataFrame, path: str, key: str, version: str) -> None:
    """Insert or update by key, the latest version winning.

    The table lies in ``BUCKETS`` parts by hash of the key.  Only parts that the
    incoming rows touch are read and written anew, beside the old ones; a new
    manifest then names the current part of every bucket, and what it replaces
    is deleted.  A failed write leaves the old manifest and so the old table.
    """
    spark = incoming.sparkSession
    incoming = cut(incoming.withColumn(BUCKET, _bucket((key,))))
    touched = [r[0] for r in incoming.select(BUCKET).distinct().collect()]  # at most BUCKETS numbers
    if not touched:
        return
    current = manifest(spark, path)
    before = [current[b] for b in touched if b in current]
    stored = _read_folders(spark, path, before) if before else incoming.drop(BUCKET).limit(0)
    result = merged(stored, incoming.drop(BUCKET), key, version).withColumn(BUCKET, _bucket((key,)))
    name = f"part-{uuid.uuid4().hex}"
    result.write.partitionBy(BUCKET).parquet(f"{path}/{name}")
    done = _generations(spark, path, "manifest=")
    number = done[-1] + 1 if done else 1
    named = sorted((current | {b: f"{name}/{BUCKET}={b}" for b in touched}).items())
    spark.createDataFrame(named, "bucket int, folder string").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest={number:06d}")
    for folder in before:
        _delete(spark, f"{path}/{folder}")
    for old in done:
        _delete(spark, f"{path}/manifest={old:06d}")
