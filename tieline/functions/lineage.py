"""Materialising intermediate frames so that a lost executor costs little."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


BUCKETED = "tieline_by_"

# folders that tables are written to, the last one first; the application's own where there is none
_SCRATCH: ContextVar[tuple[str, ...]] = ContextVar("scratch", default=())


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's reliable checkpoint folder.

    The cluster names it in ``spark.checkpoint.dir``.  Where that is unset, a
    folder in the session's warehouse stands in for it, which every executor
    sees as well.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{warehouse}/checkpoints")
    return context._jsc.sc().getCheckpointDir().get()


def application_dir(spark: SparkSession) -> str:
    """The folder of this application's written tables."""
    return f"{checkpoint_dir(spark)}/{spark.sparkContext.applicationId}"


def written_to(spark: SparkSession) -> str:
    """The folder of the tables that are written now."""
    return next(iter(_SCRATCH.get()), None) or application_dir(spark)


def clear(spark: SparkSession) -> None:
    """Delete this application's written tables; frames that read them can't be used any more."""
    _delete(spark, application_dir(spark), BUCKETED)


def _delete(spark: SparkSession, path: str, bucketed: str) -> None:
    for table in spark.catalog.listTables(pattern=f"{bucketed}*"):
        spark.sql(f"DROP TABLE IF EXISTS `{table.name}`")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete the tables that are written inside when the block ends.

    Frames that outlive the block go through the function it is given, which
    writes them beside it.
    """
    outer = _SCRATCH.get()
    folder = f"{written_to(spark)}/{uuid.uuid4().hex}"

    def kept(df: DataFrame) -> DataFrame:
        inner = _SCRATCH.set(outer)
        try:
            return cut(df)
        finally:
            _SCRATCH.reset(inner)

    before = _SCRATCH.set((folder, *outer))
    try:
        yield kept
    finally:
        _SCRATCH.reset(before)
        _delete(spark, folder, _bucketed(folder))


def _bucketed(folder: str) -> str:
    """How the names of bucketed tables in the folder begin."""
    return f"{BUCKETED}{folder.rsplit('/', 1)[1]}_"


def cut(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write the frame to the checkpoint folder and go on from the written table.

    Reading files back gives the planner their true size.  A checkpointed RDD
    would carry the estimate of the plan behind it instead, and estimates of
    joins multiply, so that after a few rounds of a loop they are useless and
    slow to compute.  One folder per application holds all its tables.
    """
    spark = df.sparkSession
    path = f"{written_to(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, key: str) -> DataFrame:
    """Like ``cut``, in buckets by hash of the key: grouping by it, or joining on it, moves no row of the table again.

    There are as many buckets as a shuffle of the session has partitions, and
    one file in each.
    """
    spark = df.sparkSession
    folder, name = written_to(spark), uuid.uuid4().hex
    table = f"{_bucketed(folder)}{name}" if _SCRATCH.get() else f"{BUCKETED}{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        df.repartition(buckets, key).write.format("parquet").option("path", f"{folder}/{name}")
        .bucketBy(buckets, key).saveAsTable(table)
    )
    return spark.table(table)


def keep(df: DataFrame) -> DataFrame:
    """Cache a frame used several times; lost blocks are recomputed from lineage."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
