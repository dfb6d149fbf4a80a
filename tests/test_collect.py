"""Collection: killed runs resume, nothing is written twice, snapshots are closed, stored bytes are checked."""

import json
import os

import pytest
from pyspark.sql import functions as F

from skirmish.sources import collect as K


@pytest.fixture
def jobs(spark):
    return spark.range(40).select(F.col("id").cast("string").alias("key"), F.lit("detail").alias("endpoint"), F.concat(F.lit("body "), F.col("id").cast("string")).alias("payload"))


def server(log, broken=()):
    """Logs every request in a file, as transports run in worker processes; keys in ``broken`` end the whole task."""

    def ask(key, endpoint, payload):
        with open(log, "a") as f:
            f.write(key + "\n")
        if key in broken:
            os._exit(1)  # the worker dies, as with a lost executor
        return 200, payload.encode()

    return ask


def asked(log):
    return sorted(open(log).read().split()) if os.path.exists(log) else []


def test_a_killed_run_resumes_without_a_double_write(spark, jobs, tmp_path):
    store, log = f"file://{tmp_path}/store", str(tmp_path / "log")
    with pytest.raises(Exception, match="."):
        K.collect(jobs, store, server(log, {"17"}), wave=8)
    first = {r.key for r in K.manifest(spark, store).collect()}
    assert 0 < len(first) < 40 and "17" not in first
    done = asked(log)
    m = K.collect(jobs, store, server(log), wave=8).collect()
    assert sorted(r.key for r in m) == sorted(map(str, range(40)))
    again = asked(log)[:]
    for k in done:
        again.remove(k)
    assert not first & set(again)  # nothing that was stored is asked for again
    assert {(r.key, bytes(r.body)) for r in K.responses(spark, store).collect()} == {(str(i), f"body {i}".encode()) for i in range(40)}
    K.collect(jobs, store, server(str(tmp_path / "none")), wave=8)
    assert asked(str(tmp_path / "none")) == []


def test_failures_are_recorded_and_tried_again(spark, jobs, tmp_path):
    def flaky(key, endpoint, payload):
        if key == "3":
            raise TimeoutError("late")
        return (404, b"") if key == "4" else (200, payload.encode())

    store = f"file://{tmp_path}/store"
    got = {r.key: r for r in K.collect(jobs.unionAll(jobs), store, flaky).collect()}
    assert len(got) == 40 and (got["3"].http_status, got["3"].error) == (None, "TimeoutError: late") and got["4"].http_status == 404
    assert sorted(r.key for r in K.todo(jobs, K.manifest(spark, store)).collect()) == ["3", "4"]
    assert K.collect(jobs, store, lambda k, e, p: (200, p.encode())).where("http_status = 200").count() == 40


def test_transport_is_tried_again_within_a_run(spark, jobs, tmp_path):
    log = str(tmp_path / "log")

    def second_time(key, endpoint, payload):
        with open(log, "a") as f:
            f.write(key + "\n")
        if open(log).read().split().count(key) == 1:
            raise ConnectionError
        return 200, b"x"

    m = K.collect(jobs.where("key < '2'"), f"file://{tmp_path}/store", second_time)
    assert m.where("http_status = 200").count() == m.count() > 0


def test_snapshots_are_written_once(spark, jobs, tmp_path):
    root = f"file://{tmp_path}/snaps"
    K.snapshot(jobs, root, "2026-01-01", lambda k, e, p: (200, p.encode()))
    closed = json.loads((tmp_path / "snaps/2026-01-01/SNAPSHOT.json").read_text())
    assert closed["responses"] == 40 and closed["bytes"] == sum(len(f"body {i}") for i in range(40))
    with pytest.raises(K.SnapshotExists):
        K.snapshot(jobs, root, "2026-01-01", lambda k, e, p: (200, b""))


def test_changed_bytes_are_found(spark, jobs, tmp_path):
    store = f"file://{tmp_path}/store"
    K.collect(jobs, store, lambda k, e, p: (200, p.encode()), parallel=1)
    pack = next(p for p in (tmp_path / "store/packs").iterdir() if p.stat().st_size)
    pack.write_bytes(b"X" + pack.read_bytes()[1:])
    with pytest.raises(Exception, match="not what was written"):
        K.responses(spark, store).collect()
    with pytest.raises(Exception, match="only grows"):
        K.responses(spark, store).write.format("rawstore").option("path", store).mode("overwrite").save()


def test_empty_stores(spark, jobs, tmp_path):
    store = f"file://{tmp_path}/store"
    assert K.manifest(spark, store).count() == 0 and K.responses(spark, store).count() == 0
    assert K.collect(jobs.limit(0), store, lambda k, e, p: (200, b"")).count() == 0
