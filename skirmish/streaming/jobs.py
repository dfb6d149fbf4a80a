"""Structured Streaming twins: windowed counts with late data, latest response by key, predict-then-update ratings."""

from __future__ import annotations

import json
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators import backbone
from ..sources.store import shared_dir


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """The table as a stream; event times are UTC timestamps, for watermarks reject timestamps without a zone."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    if spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)).isFile():
        path = path[:-1] + "[" + path[-1] + "]"  # a stream reads folders, or a pattern that matches one file
    return spark.readStream.schema(schema).load(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(stream: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    w = F.window("ts", width)
    return stream.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def run_to_table(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Drives a stream over what is there now into a memory table, and returns it."""
    name = "t" + uuid.uuid4().hex
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def upsert(target: dict, path: str):
    """A foreachBatch sink that keeps, per key, the row with the latest time: batches are merged with what is stored."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch if target.get("at") is None else batch.unionByName(spark.read.parquet(target["at"]))
        place = f"{path}/v{number}"
        rows.groupBy("key").agg(F.max("at").alias("at"), F.max_by("body", "at").alias("body")).write.mode("overwrite").parquet(place)
        target["at"] = place

    return merge


def refresh_stream(base: DataFrame, refresh: DataFrame, files: int = 8) -> DataFrame:
    """``base`` after ``refresh`` arrived as a stream of ``files`` files, one a micro-batch; see ``refresh_sink``."""
    spark = base.sparkSession
    where = f"{shared_dir(spark)}/skirmish-refresh-{uuid.uuid4().hex}"
    refresh.repartition(files, "series_id").write.parquet(f"{where}/in")
    stream, target = spark.readStream.schema(refresh.schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/in"), {}
    q = stream.withColumn("at", F.lit(0).cast("long")).writeStream.foreachBatch(refresh_sink(target, f"{where}/latest")).option("checkpointLocation", f"{where}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return backbone.refreshed(base, spark.read.parquet(target["at"])) if target else base


def refresh_sink(target: dict, path: str):
    """A foreachBatch sink that keeps the latest version (``at``) of every refreshed series; equal times keep the greater row.

    A table after the refresh is a function of the base and of these versions alone (``backbone.refreshed``, ``diff_classes``): so any
    split of the input into micro-batches gives the same classes and rows, and a batch that runs again changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch if target.get("at") is None else batch.unionByName(spark.read.parquet(target["at"]))
        own = [c for c in batch.columns if c not in ("series_id", "at")]
        latest = rows.groupBy("series_id").agg(F.max(F.struct("at", *own)).alias("v")).select("series_id", "v.*")
        place = f"{path}/v{number}"
        latest.write.mode("overwrite").parquet(place)
        target["at"] = place

    return merge


OUT = "league string, series_id long, t timestamp, p double, late boolean"


class OnlineRatings(StatefulProcessor):
    """Predict-then-update ratings of a league: rows wait until the watermark passes their time, then all rows of that time, whichever
    micro-batches brought them, are predicted from the state before them and only then learned from.

    Spark leaves out rows behind the watermark and counts them in the query's progress (numRowsDroppedByWatermark); one that passed
    in between comes out without p, marked late. Neither changes anything. State: a rating per team, the waiting rows by time.
    """

    def __init__(self, k: float = 32.0, start: float = 1500.0, scale: float = 400.0):
        self.k, self.start, self.scale = k, start, scale

    def init(self, handle) -> None:
        self.handle = handle
        self.rating = handle.getMapState("rating", "team long", "r double")
        self.waiting = handle.getMapState("waiting", "ms long", "rows string")

    def handleInputRows(self, key, rows, timerValues):
        passed, late = timerValues.getCurrentWatermarkInMs(), []
        for frame in rows:
            ms = (pd.to_datetime(frame.t, utc=True).astype("int64") // (1_000_000 if str(frame.t.dtype).startswith("datetime64[ns") else 1_000)).to_numpy()
            for when in np.unique(ms):
                own = frame[ms == when]
                if when <= passed:
                    late.append(pd.DataFrame({"league": key[0], "series_id": own.series_id, "t": own.t, "p": None, "late": True}))
                    continue
                held = json.loads(self.waiting.getValue((int(when),))[0]) if self.waiting.containsKey((int(when),)) else []
                if not held:
                    self.handle.registerTimer(int(when))
                held += [[int(r.series_id), int(r.a), int(r.b), int(r.y)] for r in own.itertuples()]
                self.waiting.updateValue((int(when),), (json.dumps(held),))
        yield from late

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        due = sorted(ms for (ms,) in self.waiting.keys() if ms <= passed)  # timers may come in any order; times may not
        for ms in due:
            rows = sorted(json.loads(self.waiting.getValue((ms,))[0]))
            self.waiting.removeKey((ms,))
            teams = {team for _, a, b, _ in rows for team in (a, b)}
            before = {team: self.rating.getValue((team,))[0] if self.rating.containsKey((team,)) else self.start for team in teams}
            p = [1 / (1 + 10 ** ((before[b] - before[a]) / self.scale)) for _, a, b, _ in rows]
            after = dict(before)
            for (_, a, b, y), q in zip(rows, p):
                after[a] += self.k * (y - q)
                after[b] -= self.k * (y - q)
            for team, r in after.items():
                self.rating.updateValue((team,), (r,))
            yield pd.DataFrame({"league": key[0], "series_id": [r[0] for r in rows], "t": pd.Timestamp(ms, unit="ms"), "p": p, "late": False})

    def close(self) -> None:
        pass


def rate_stream(stream: DataFrame, k: float = 32.0, late: str = "1 hour") -> DataFrame:
    """(league, series_id, t, p, late) of a stream of (league, series_id, t timestamp, a, b, y); see ``OnlineRatings``.

    The last times come out when later rows have moved the watermark past them. The state lives in RocksDB.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return stream.withWatermark("t", late).groupBy("league").transformWithStateInPandas(OnlineRatings(k), OUT, "Append", "EventTime")
