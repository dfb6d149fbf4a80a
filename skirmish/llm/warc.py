"""WARC archives with revisit records, and the external merge of their index into capture histories.

Pages become gzip-member records of archive files in the shared folder. Each file's index lines (URL key, timestamp, JSON)
are a locally sorted run; runs are cut by common splitters and every range merges its slices by a loser tree, so that the
ranges in turn hold all captures in the order of URL key and time.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: An archive file ends after the record that takes it to so many bytes.
ROLL = 16 << 20
#: Index lines that the splitters are chosen from, at most.
SAMPLE = 20_000
#: Captures without a time of their own are one second apart from here, by page id.
EPOCH = datetime(2020, 1, 1, tzinfo=timezone.utc)
CRLF = b"\r\n"
ENTRY = "page_id long, url string, date string, record_type string, payload_bytes long, payload_digest string, refers_to long, file string, file_offset long, record_bytes long"


def url_key(url: str) -> str:
    """The host's labels from the top level down, then path and query: ``com,example,www)/a?b``. User, port 80/443 and fragment go."""
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or ""), u.port
    except ValueError:
        return "%20".join(url.lower().split())
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "")
    return "%20".join((f"{key}){u.path or '/'}" + (f"?{u.query}" if u.query else "")).split())


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, date: str, payload: bytes, name: str, refers: int | None) -> bytes:
    """One record, gzipped as a member of its own. A revisit has the payload's digest and length but not the payload."""
    body = b"" if refers is not None else payload
    line = url.replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {line}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{name}", f"X-Payload-Bytes: {len(payload)}", "Content-Type: text/html; charset=utf-8",
    ]
    if refers is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(body)}")
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + CRLF + CRLF + body + CRLF + CRLF) + pack.flush()


def records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, content) of each gzip member of an archive."""
    at, view = 0, memoryview(data)
    while at < len(data):
        unpack = zlib.decompressobj(31)
        raw = unpack.decompress(view[at:])
        size = len(data) - at - len(unpack.unused_data)
        head, _, rest = raw.partition(CRLF + CRLF)
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        n = int(fields["Content-Length"])
        if rest[n:] != CRLF + CRLF:
            raise ValueError("a record's length is wrong")
        yield at, size, fields, rest[:n]
        at += size


def _urn(text: str | None) -> int | None:
    value = (text or "")[len("<urn:page:") : -1]
    return int(value) if value else None


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> tuple[str, DataFrame]:
    """Writes the archives to a new folder of the shared folder: (folder, table of (file, bytes, n) that the finished tasks wrote).

    Of equal payloads the one with the largest id is the response and the others revisit it. A task that is run again writes
    new files, and the table only names those of the run that counted. The folder's file system must be one that Python's
    Arrow can open (local, HDFS with its client library, or an object store).
    """
    spark = pages.sparkSession
    common.small_batches(spark, 200)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("html")))
    keep = common.stash(rows.groupBy("sha1").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1").select("sha1", "keep"), "responses")
    joined = rows.join(keep, "sha1", "left").select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("keep")), F.col("keep")).alias("refers"))
    folder = common.new_path(spark, "warc")

    def run(batches):
        from pyarrow import fs as arrow_fs

        task = TaskContext.get()
        store, root = arrow_fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        stem, n, out, size, count, made = f"part-{task.partitionId():05d}-{task.taskAttemptId()}", 0, None, 0, 0, []
        for b in batches:
            for page, url, html, refers in zip(*[c.to_pylist() for c in b.columns]):
                payload = html.encode("utf-8", "surrogatepass")
                when = (EPOCH + timedelta(seconds=(page or 0) % 4_000_000_000)).strftime("%Y-%m-%dT%H:%M:%SZ")
                raw = record(page, url, when, payload, digest(payload), refers)
                if out is None:
                    name = f"{stem}-{n}.warc.gz"
                    out, size, count, n = store.open_output_stream(f"{root}/{name}", compression=None), 0, 0, n + 1
                out.write(raw)
                size, count = size + len(raw), count + 1
                if size >= ROLL:
                    out.close()
                    made.append((name, size, count))
                    out = None
        if out is not None:
            out.close()
            made.append((name, size, count))
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())], ["file", "bytes", "n"])

    return folder, common.stash(joined.mapInArrow(run, "file string, bytes long, n long"), "archives")


def read_archives(spark, folder: str, files: DataFrame) -> DataFrame:
    """Index entries (ENTRY) of the records of ``files``, from the archives' bytes: a response's digest and length are computed anew."""
    if not files.take(1):
        return spark.createDataFrame([], ENTRY)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    name = F.element_at(F.split("path", "/"), -1)
    blobs = spark.read.format("binaryFile").load(folder).select(name.alias("file"), "content").join(files.select("file"), "file", "left_semi")
    names = [x.split()[0] for x in ENTRY.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches):
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out = []
                for at, size, f, body in records(data):
                    kind = f["WARC-Type"]
                    told = f["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (digest(body) != told or len(body) != int(f["X-Payload-Bytes"])):
                        raise ValueError(f"a payload in {file} is not what was written")
                    out.append((_urn(f["WARC-Record-ID"]), f["WARC-Target-URI"], f["WARC-Date"], kind, int(f["X-Payload-Bytes"]), told, _urn(f.get("WARC-Refers-To")), file, at, size))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    entries = common.stash(blobs.mapInArrow(run, ENTRY), "entries")
    common.small_batches(spark)
    return entries


class LoserTree:
    """Merges sorted iterators: one path of comparisons from leaf to root for each item that leaves."""

    def __init__(self, runs: list[Iterator[str]]):
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        k = len(runs)
        self.losers = [-1] * max(1, k)
        self.winner = self._build(1) if k else -1

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x < y or (x == y and a < b)))

    def _build(self, node: int) -> int:
        k = len(self.runs)
        if node >= k:
            return node - k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (a, b) if self._less(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator[str]:
        k = len(self.runs)
        while k and self.heads[self.winner] is not None:
            w = self.winner
            yield self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            node = (w + k) // 2
            while node:
                if self._less(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


def index_line(entry: dict) -> str:
    """A line of the index: key, timestamp and page id compare as text; the rest is JSON."""
    stamp = "".join(c for c in entry["date"] if c.isdigit())
    page = entry["page_id"]
    place = "-" if page is None else f"{page + 2**63:020d}"
    return f"{url_key(entry['url'])} {stamp} {place} {json.dumps(entry, ensure_ascii=True, separators=(',', ':'))}"


def histories(entries: DataFrame, ranges: int | None = None) -> DataFrame:
    """(range, place, line): all index lines in order, ranges in turn and places in them: the merge of the files' sorted runs.

    The runs' slices meet by range; splitters are full lines, so a URL with many captures is spread over ranges. Slices of a
    range go to one task, whose share of all lines is about 1 / ``ranges`` (default: the number of shuffle partitions).
    """
    spark = entries.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    common.small_batches(spark, 10_000)

    def lines(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("file"), pa.array([index_line(e) for e in b.to_pylist()], pa.string())], ["file", "line"])

    indexed = common.stash(entries.mapInArrow(lines, "file string, line string"), "index")
    some = sorted(r.line for r in indexed.select("line").orderBy(F.xxhash64("line"), "line").limit(SAMPLE).collect())
    cuts = sorted({some[i * len(some) // n] for i in range(1, n)}) if some else []

    def slices(batches):
        held: dict[str, list[str]] = {}
        for b in batches:
            for file, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.setdefault(file, []).append(line)
        rows = []
        for file, run in held.items():
            run.sort()  # a run is one file's index
            at = np.searchsorted(np.array(run, object), np.array(cuts, object), side="left").tolist() if cuts else []
            for k, (a, z) in enumerate(zip([0, *at], [*at, len(run)])):
                if z > a:
                    rows.append((k, file, "\n".join(run[a:z])))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], ["range", "run", "lines"])

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        runs = [s for _, s in sorted(zip(group.column("run").to_pylist(), group.column("lines").to_pylist()))]
        out = list(LoserTree([iter(s.split("\n")) for s in runs]))
        return pa.table({"range": pa.array([key[0].as_py()] * len(out), pa.int32()), "place": pa.array(range(len(out)), pa.int64()), "line": pa.array(out, pa.string())})

    return indexed.mapInArrow(slices, "range int, run string, lines string").groupBy("range").applyInArrow(merge, "range int, place long, line string")


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", ranges: int | None = None) -> DataFrame:
    """(ENTRY, url_key, captured, range, place): every page's record as read back, in the order of the merged index.

    Null payloads and URLs are empty; the payloads of rows without an id are responses or revisits like any other, and a
    payload that only such rows have has no revisits. Rows that repeat the kept id are all responses. Other columns are not
    read; an empty table gives an empty result.
    """
    folder, files = write_archives(pages, id_col, url_col, payload_col)
    entries = read_archives(pages.sparkSession, folder, files)
    merged = histories(entries, ranges)
    body = F.regexp_extract("line", r"^(\S*) (\d+) (\S+) (\{.*)$", 4)
    parsed = merged.select("range", "place", F.regexp_extract("line", r"^(\S*) ", 1).alias("url_key"), F.regexp_extract("line", r"^\S* (\d+) ", 1).alias("captured"), F.from_json(body, ENTRY).alias("e"))
    return parsed.select("e.*", "url_key", "captured", "range", "place")


def op5_warc(spark, sf_dir: str) -> DataFrame:
    out = captures(common.table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", F.col("range").alias("index_range"), F.col("place").alias("index_place"))
