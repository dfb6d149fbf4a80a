"""Derived tables, written once: Parquet in the folder that driver and executors share, found again by the state of its inputs.

A derived table that several queries read would else be computed again in every branch of every plan. Its key is the name, length
and time of change of every input file, so a changed input makes a new table.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[tuple, str] = {}


def shared_dir(spark: SparkSession) -> str | None:
    """The folder in ``spark.checkpoint.dir``; where it is unset, a local master gets a temporary one and a cluster has none."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        where = "file://" + tempfile.mkdtemp(prefix="skirmish-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/") if where else None


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def state(spark: SparkSession, path: str) -> tuple:
    """(name, length, time of change) of each file at ``path``, in order."""
    fs, p = _file_system(spark, path)
    files, out = fs.listFiles(p, True), []
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def derived(spark: SparkSession, name: str, inputs: list[str], make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` computes from the files at ``inputs``: read if this application has written it, else written first.

    Without a shared folder it is computed where it is used. A write that fails leaves nothing that a later call would read.
    """
    where = shared_dir(spark)
    if where is None:
        return make()
    key = (spark.sparkContext.applicationId, name, *(state(spark, p) for p in inputs))
    if key not in _WRITTEN:
        path, df = f"{where}/skirmish-{name}-{uuid.uuid4().hex}", make()
        df.write.parquet(path)
        _WRITTEN[key] = path
        atexit.register(forget, spark, key)
        del df
        _collect(spark)
    return spark.read.parquet(_WRITTEN[key])


def _collect(spark: SparkSession) -> None:
    """Has the driver collect its garbage, on which Spark deletes the shuffle files of plans that nothing holds any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def forget(spark: SparkSession, key: tuple) -> None:
    """Deletes a written table."""
    with contextlib.suppress(Exception):
        fs, p = _file_system(spark, _WRITTEN.pop(key))
        fs.delete(p, True)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, which cuts its lineage. ``drop`` deletes it before the program's end."""
    spark = df.sparkSession
    where = shared_dir(spark)
    if where is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key, path = (uuid.uuid4().hex,), f"{where}/skirmish-{name}-{uuid.uuid4().hex}"
    _WRITTEN[key] = path
    atexit.register(forget, spark, key)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash = key
    return out


def drop(df: DataFrame) -> None:
    """Deletes a stashed table that nothing reads any more."""
    forget(df.sparkSession, df._stash)
