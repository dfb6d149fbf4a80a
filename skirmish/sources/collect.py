"""Resumable collection: responses go once into pack files, and a manifest that only grows says where each lies.

``rawstore`` is a data source. Its writer packs a task's responses into files of its own and lists them in a pending manifest part;
the commit publishes the parts of the tasks that count, so a failed or repeated task leaves nothing that a reader sees. What is left
to do is the jobs without a manifest row: a run that was killed goes on where its last published wave ended.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

RESPONSE = "key string, endpoint string, retrieved_at string, http_status int, error string, body binary"
MANIFEST = "key string, endpoint string, retrieved_at string, http_status int, error string, file string, offset long, bytes long, sha256 string"
#: A pack file is closed when it holds so many bytes.
PACK = 128 << 20
#: A transport takes (key, endpoint, payload) and returns (status, body); what it raises is recorded, never hidden.
Transport = Callable[[str, str, str | None], tuple[int, bytes]]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    parts: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _open(self.path)
        for d in ("packs", "pending", "manifest"):
            store.create_dir(f"{root}/{d}")
        rows, out, name, at, parts = [], None, "", 0, []

        def close():
            nonlocal out, at, rows
            if out is not None:
                out.close()
                parts.append(uuid.uuid4().hex)
                with store.open_output_stream(f"{root}/pending/{parts[-1]}.json") as f:
                    f.write("".join(json.dumps(r) + "\n" for r in rows).encode())
            out, at, rows = None, 0, []

        for batch in iterator:
            for r in batch.to_pylist():
                if out is None:  # a name of its own: no file is ever written twice
                    name = f"{uuid.uuid4().hex}.pack"
                    out = store.open_output_stream(f"{root}/packs/{name}", compression=None)
                body = r.pop("body") or b""
                out.write(body)
                rows.append(r | {"file": name, "offset": at, "bytes": len(body), "sha256": hashlib.sha256(body).hexdigest()})
                at += len(body)
                if at >= PACK:
                    close()
        close()
        return Written(parts)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _open(self.path)
        for m in messages:
            for p in m.parts if m else []:
                store.move(f"{root}/pending/{p}.json", f"{root}/manifest/{p}.json")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _open(self.path)
        for m in messages:
            for p in m.parts if m else []:
                store.delete_file(f"{root}/pending/{p}.json")


class _Part(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        store, root = _open(self.path)
        found = store.get_file_info(fs.FileSelector(f"{root}/manifest", allow_not_found=True))
        return [_Part(f.base_name) for f in sorted(found, key=lambda f: f.base_name)] or [_Part("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.value:
            return
        store, root = _open(self.path)
        with store.open_input_stream(f"{root}/manifest/{partition.value}") as f:
            rows = [json.loads(line) for line in f.read().decode().splitlines()]
        packs: dict = {}
        for r in rows:
            if r["file"] not in packs:
                packs = {r["file"]: store.open_input_file(f"{root}/packs/{r['file']}")}
            body = packs[r["file"]].read_at(r["bytes"], r["offset"])
            if hashlib.sha256(body).hexdigest() != r["sha256"]:
                raise ValueError(f"stored response of {r['key']} is not what was written")
            yield r["key"], r["endpoint"], r["retrieved_at"], r["http_status"], r["error"], body


class RawStore(DataSource):
    """``format("rawstore").option("path", folder)``: reads and appends responses."""

    @classmethod
    def name(cls) -> str:
        return "rawstore"

    def schema(self) -> str:
        return RESPONSE

    def writer(self, schema, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("a store of responses only grows")
        return _Writer(self.options["path"])

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of a store; empty where there is none yet."""
    store, root = _open(path)
    if not store.get_file_info(fs.FileSelector(f"{root}/manifest", allow_not_found=True)):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).json(f"{path}/manifest")


def responses(spark: SparkSession, path: str) -> DataFrame:
    """Every stored response; each is checked against its digest."""
    spark.dataSource.register(RawStore)
    return spark.read.format("rawstore").option("path", path).load()


def todo(jobs: DataFrame, stored: DataFrame) -> DataFrame:
    """The jobs (key, ...) whose key has no good response (status 200) yet."""
    return jobs.join(stored.where("http_status = 200").select("key"), "key", "left_anti")


def fetched(jobs: DataFrame, transport: Transport, parallel: int, retries: int = 2, pause: float = 0.0) -> DataFrame:
    """Responses of ``jobs`` (key, endpoint, payload), over ``parallel`` tasks; a request that fails is tried again after a pause that doubles.

    The last failure is recorded as an error without a status. Null keys are no jobs.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, endpoint, payload in frame.itertuples(index=False):
                for attempt in range(retries + 1):
                    at, status, error, body = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ"), None, None, b""
                    try:
                        status, body = transport(key, endpoint, payload)
                    except Exception as e:  # recorded
                        error = f"{type(e).__name__}: {e}"
                    if error is None or attempt == retries:
                        break
                    time.sleep(pause * 2**attempt)
                out.append((key, endpoint, at, status, error, body))
            yield pd.DataFrame(out, columns=["key", "endpoint", "retrieved_at", "http_status", "error", "body"]).astype({"http_status": "Int32"})

    return jobs.where("key is not null").select("key", "endpoint", "payload").repartition(parallel).mapInPandas(run, RESPONSE)


def collect(jobs: DataFrame, path: str, transport: Transport, parallel: int = 4, wave: int = 10_000, retries: int = 2, pause: float = 0.0) -> DataFrame:
    """Collects what ``path`` does not hold yet, in waves of about ``wave`` jobs that are published one by one; returns the manifest.

    ``jobs``: key, endpoint, payload. Of jobs with one key one is done. A run that ends early has lost at most its last wave.
    """
    spark = jobs.sparkSession
    spark.dataSource.register(RawStore)
    left = todo(jobs.dropDuplicates(["key"]), manifest(spark, path))
    waves = max(1, -(-left.count() // wave))
    for i in range(waves):
        part = todo(jobs.dropDuplicates(["key"]), manifest(spark, path)).where(F.pmod(F.xxhash64("key"), F.lit(waves)) == i)
        fetched(part, transport, parallel, retries, pause).write.format("rawstore").option("path", path).mode("append").save()
    return manifest(spark, path)


class SnapshotExists(FileExistsError):
    """A dated snapshot is written once."""


def snapshot(jobs: DataFrame, root: str, date: str, transport: Transport, **options) -> DataFrame:
    """Collects all ``jobs`` into the new folder ``root``/``date``, and closes it with a summary; fails if the folder is there."""
    store, base = _open(f"{root}/{date}")
    if store.get_file_info(base).type != fs.FileType.NotFound:
        raise SnapshotExists(f"{root}/{date} is there already; snapshots do not change")
    store.create_dir(base)
    out = collect(jobs, f"{root}/{date}", transport, **options)
    n, total = out.agg(F.count("*"), F.sum("bytes")).first()
    with store.open_output_stream(f"{base}/SNAPSHOT.json") as f:
        f.write(json.dumps({"date": date, "responses": n, "bytes": total or 0, "completed_at": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")}).encode())
    return out
