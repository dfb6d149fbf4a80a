"""What the operators share: tables in the shared folder, small Arrow helpers."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Where it is unset, a local master gets a temporary folder; a cluster gets an error, for its
    executors would not see each other's files.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="skirmish-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/skirmish-{uuid.uuid4().hex}/{label}"
    _WRITTEN.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path.rpartition("/")[0])
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _WRITTEN:
        with contextlib.suppress(Exception):
            remove(spark, path)


def stash(df: DataFrame, label: str, **options) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: the lineage ends here, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._skirmish_path = path
    return out


def unstash(df: DataFrame) -> None:
    """Deletes a stashed table that nothing reads any more."""
    remove(df.sparkSession, df._skirmish_path)


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files go when their plans are collected as garbage, so collect it between the steps of a long job. Python tells
    the JVM of its garbage a moment later."""
    gc.collect()
    time.sleep(0.4)
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 500, size: str = "8MB") -> None:
    """Arrow batches of documents stay small, so that very long texts do not fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "512")


def lean() -> None:
    """In a worker: Arrow's memory comes from the system's allocator, which gives large blocks back when they are free."""
    pa.set_memory_pool(pa.system_memory_pool())


def texts(column: pa.Array) -> list[bytes]:
    """The column's UTF-8 bytes; null is empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b: the same ordered type) as (node, component), component the smallest node.

    Rounds of large-star and small-star links: each node hangs its larger neighbours on the smallest one it knows, so the
    number of rounds grows with the logarithm of the longest path. Every round is a few shuffles of edges, written to the
    shared folder. Null ends are ignored; an empty input gives an empty result. Raises if it has not converged in max_rounds.
    """
    links = stash(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        # large-star: neighbours above the node hang on the smallest that it knows
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small-star: a node and its lower neighbours hang on the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        after_links = stash(small.where("a <> b").distinct(), "links")
        after = after_links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        unstash(links)
        links, done, before = after_links, after == before, after
        if done:
            break
    else:
        raise RuntimeError("components did not converge")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
