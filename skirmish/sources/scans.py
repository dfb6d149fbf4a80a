"""Scans, profiles and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """Files under ``root``: path, suffix, size; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("suffix"), F.col("length").alias("size"))


def file_hashes(spark: SparkSession, root: str) -> DataFrame:
    """SHA-256 of each file under ``root``: a lock's rows. Files are read whole, so the folder should hold small ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))


def check_lock(current: DataFrame, lock: DataFrame) -> DataFrame:
    """Names that changed, went or came since the lock was taken."""
    c, k = current.alias("c"), lock.alias("k")
    both = c.join(k, F.col("c.name") == F.col("k.name"), "full")
    state = F.when(F.col("k.name").isNull(), "ADDED").when(F.col("c.name").isNull(), "MISSING").when(F.col("c.sha256") != F.col("k.sha256"), "CHANGED")
    return both.select(F.coalesce("c.name", "k.name").alias("name"), state.alias("state")).where("state is not null")


def profile(df: DataFrame) -> DataFrame:
    """A row per column: type, rows, share of nulls, exact distinct values; one aggregate over one scan."""
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(df.columns):
        aggs += [F.count_if(F.col(c).isNull()).alias(f"m{i}"), F.countDistinct(c).alias(f"d{i}")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(kind).alias("type"), F.col("n"), F.round(F.col(f"m{i}") / F.greatest(F.col("n"), F.lit(1)), 6).alias("missing"), F.col(f"d{i}").alias("distinct")) for i, (c, kind) in enumerate(df.dtypes)])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def read_text_table(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("UTF-8", "GB18030")) -> DataFrame:
    """A CSV of texts in the first encoding that decodes it; all columns are strings and empty strings are not null."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # else Spark knows a few encodings only
    for e in encodings:
        df = spark.read.option("header", True).option("multiLine", True).option("encoding", e).csv(path)
        names = [c.lstrip("﻿") for c in df.columns]
        df = df.toDF(*names).na.fill("")
        bad = reduce(lambda a, b: a | b, [F.contains(F.coalesce(F.col(f"`{c}`"), F.lit("")), F.lit("�")) for c in names])
        if not df.where(bad).take(1) and not any("�" in c for c in names):
            return df
    raise ValueError(f"{path}: none of {encodings} decodes it")


def ingest(parts: list[DataFrame], aliases: dict[str, list[str]]) -> DataFrame:
    """Tables with differing column names, united: the first alias that a table has (in any case) fills each column; rows are distinct."""
    out = []
    for df in parts:
        have = {c.lower(): c for c in df.columns}
        found = {k: next((have[a.lower()] for a in names if a.lower() in have), None) for k, names in aliases.items()}
        out.append(df.select(*[F.col(c).cast("string").alias(k) if c else F.lit(None).cast("string").alias(k) for k, c in found.items()]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out).distinct()


def write_once(df: DataFrame, path: str) -> None:
    """Writes a table whose folder must not exist."""
    df.write.mode("errorifexists").parquet(path)


def write_or_verify(df: DataFrame, path: str) -> bool:
    """Writes a new table, or proves that the one there has the same rows; returns whether it wrote."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        write_once(df, path)
        return True
    old = spark.read.parquet(path)
    if old.exceptAll(df).take(1) or df.exceptAll(old).take(1):
        raise ValueError(f"{path} holds other rows")
    return False


def latest_ok(responses: DataFrame) -> DataFrame:
    """The last good response (code 200, result 0) per key; of equal times the first by id stays."""
    good = responses.where("http = 200 and result = 0")
    return good.groupBy("key").agg(F.max_by(F.struct("id", "body"), F.struct("at", -F.col("id"))).alias("x"), F.max("at").alias("at")).select("key", "at", "x.id", "x.body")


def json_documents(df: DataFrame, key: str, *cols: str) -> DataFrame:
    """A JSON document per row and its SHA-256."""
    doc = F.to_json(F.struct(*cols))
    return df.select(key, doc.alias("document"), F.sha2(doc, 256).alias("sha256"))
