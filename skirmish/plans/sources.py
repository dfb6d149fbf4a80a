"""Queries of scans, functions, sets and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import adapter as A
from ..sources import collect, scans
from ..sources.store import shared_dir
from ..streaming import jobs
from .base import query

NATION_TYPES = [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")]


@query("s01_file_inventory")
def s01(spark, sf):
    return scans.inventory(spark, sf)


@query("s03_profile", "", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{k}' AS type, count(*) AS n, round(count(*) FILTER ({c} IS NULL) / count(*), 6) AS missing, count(DISTINCT {c}) AS \"distinct\" FROM orders" for c, k in [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderpriority", "string")]))
def s03(spark, sf):
    return scans.profile(A.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"))


@query("s06_ingest", "", "SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS id, c_name AS name FROM customer UNION SELECT CAST(s_suppkey AS VARCHAR), s_name FROM supplier")
def s06(spark, sf):
    return scans.ingest([A.table(spark, sf, "customer"), A.table(spark, sf, "supplier")], {"id": ["C_CUSTKEY", "s_suppkey"], "name": ["c_name", "S_NAME"]})


@query("s15_latest_response", "", """
WITH r AS (SELECT user_id AS key, event_id AS id, ts, event_type AS body, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS http FROM events)
SELECT key, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS at, arg_max(id, ts) AS id, arg_max(body, ts) AS body FROM r WHERE http = 200 GROUP BY key""")
def s15(spark, sf):
    e = A.table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("event_type").alias("body"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("http"), F.lit(0).alias("result"))
    return scans.latest_ok(e).select("key", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), "id", "body")


@query("s17_json_rows", "", "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def s17(spark, sf):
    e = A.table(spark, sf, "events").select("event_type", F.from_json("props", "k long").alias("p"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("k"))


@query("s27_json_documents", "", "SELECT r_regionkey, '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS document, sha256('{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}') AS sha256 FROM region")
def s27(spark, sf):
    return scans.json_documents(A.table(spark, sf, "region"), "r_regionkey", "r_regionkey", "r_name")


@query("f02_latin_tokens", "", "SELECT p_partkey, list_sort(list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z]{2,}'))) AS tokens FROM part")
def f02(spark, sf):
    return A.table(spark, sf, "part").select("p_partkey", F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "p_name", "p_type")), F.lit("[a-z]{2,}"), 0))).alias("tokens"))


@query("f15_time_zone", "", "SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS local FROM events")
def f15(spark, sf):
    return A.table(spark, sf, "events").select("event_id", F.date_format(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Shanghai"), "yyyy-MM-dd HH:mm").alias("local"))


@query("o03_top_per_group", "", "SELECT * EXCLUDE (r) FROM (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS r FROM lineitem) WHERE r <= 3")
def o03(spark, sf):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey")
    return A.table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").withColumn("r", F.row_number().over(w)).where("r <= 3").drop("r")


@query("so5_keep_first", "", "SELECT o_custkey, min(o_orderdate) = max(o_orderdate) AS one_day, arg_min(o_orderkey, row(o_orderdate, o_orderkey)) AS first_order FROM orders GROUP BY o_custkey")
def so5(spark, sf):
    return A.table(spark, sf, "orders").groupBy("o_custkey").agg((F.min("o_orderdate") == F.max("o_orderdate")).alias("one_day"), F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"))


@query("st2_windowed_stream", "", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def st2(spark, sf):
    out = jobs.run_to_table(jobs.windowed(jobs.event_stream(spark, sf)))
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def page_jobs(spark, sf):
    """A job for every page; the stand-in server's answer travels as the payload."""
    return A.table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("key"), F.lit("page").alias("endpoint"), F.col("html").alias("payload"))


def page_server(key, endpoint, payload):
    """Answers with the payload; one of eleven pages is not found, one of thirteen fails."""
    if int(key) % 13 == 0:
        raise TimeoutError(f"page {key}")
    return (404, b"") if int(key) % 11 == 0 else (200, (payload or "").encode())


def _collected(spark, sf):
    where = shared_dir(spark)
    return collect.collect(page_jobs(spark, sf), f"{where}/skirmish-store-{uuid.uuid4().hex}", page_server, wave=5_000)


_SERVED = """
SELECT CAST(page_id AS VARCHAR) AS key, CASE WHEN page_id % 13 = 0 THEN NULL WHEN page_id % 11 = 0 THEN 404 ELSE 200 END AS http_status, CASE WHEN page_id % 13 = 0 THEN 'TimeoutError: page ' || page_id END AS error,
 CASE WHEN page_id % 13 = 0 OR page_id % 11 = 0 THEN '' ELSE coalesce(html, '') END AS body FROM pages"""


@query("s12_collected_manifest", "", f"SELECT key, http_status, error, octet_length(encode(body)) AS bytes, sha256(body) AS sha256 FROM ({_SERVED})")
def s12(spark, sf):
    """The manifest of a store into which every page was collected, in waves."""
    return _collected(spark, sf).select("key", "http_status", "error", "bytes", "sha256")


@query("s14_left_to_do", "", f"SELECT key, error FROM ({_SERVED}) WHERE coalesce(http_status, 0) <> 200")
def s14(spark, sf):
    """What a second run would ask for again: jobs without a good response, and why."""
    m = _collected(spark, sf)
    return collect.todo(page_jobs(spark, sf), m).join(m.select("key", "error"), "key").select("key", "error")
