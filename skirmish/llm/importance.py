"""Resampling documents towards a target distribution of hashed word features, by external sort-counts.

Every text becomes a stream of 16-bit buckets once. Streams are written in blocks with the documents' offsets; counting sorts a
block's buckets and run-length encodes them; weighing gathers the buckets' gains and sums them between offsets.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

BUCKETS = 10_000
RUN = 1
PERCENT = 10
MIN_WORDS = 20
SEED = "2024"
#: Features in a block of streams, about; a document is never cut.
BLOCK = 1 << 20
#: Rows that one task ranks, about.
RANKED = 500_000
# A-Z become a-z; every other ASCII byte that is no digit or lower-case letter parts words
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def buckets(text: bytes, run: int = RUN, n_buckets: int = BUCKETS) -> tuple[np.ndarray, int]:
    """The uint16 buckets of a text's features (runs of 1 to ``run`` consecutive words), and its number of words."""
    words = text.translate(_FOLD).split()
    out = [np.fromiter(map(zlib.crc32, words), np.uint32, len(words))]
    for k in range(2, run + 1):
        runs = map(b" ".join, zip(*[words[i:] for i in range(k)]))
        out.append(np.fromiter(map(zlib.crc32, runs), np.uint32))
    return (np.concatenate(out) % np.uint32(n_buckets)).astype(np.uint16), len(words)


def streams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, n_buckets: int = BUCKETS) -> DataFrame:
    """(ids, words, ends, stream): a row per block of documents; ``stream`` holds their buckets as little-endian uint16, one
    document after the other, ``ends`` the place after each one's last bucket. Null and empty texts have none."""
    if not 0 < n_buckets <= 1 << 16:
        raise ValueError("buckets are 16-bit numbers")
    common.small_batches(docs.sparkSession)

    def block(ids, words, parts):
        ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
        one = lambda v, t: pa.array([v], pa.list_(t))
        raw = np.concatenate(parts).astype("<u2", copy=False).tobytes()
        return pa.RecordBatch.from_arrays([one(ids, pa.int64()), one(words, pa.int64()), one(ends, pa.int64()), pa.array([raw], pa.binary())], ["ids", "words", "ends", "stream"])

    def write(batches):
        common.lean()
        ids, words, parts, held = [], [], [], 0
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), common.texts(b.column(1)), strict=True):
                part, n = buckets(text, run, n_buckets)
                ids.append(i)
                words.append(n)
                parts.append(part)
                held += len(part)
                if held >= BLOCK or len(ids) >= BLOCK // 16:
                    yield block(ids, words, parts)
                    ids, words, parts, held = [], [], [], 0
        if ids:
            yield block(ids, words, parts)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(write, "ids array<long>, words array<long>, ends array<long>, stream binary")


def counts(packed: DataFrame, n_buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in ``packed``: each block's buckets are sorted and run-length encoded, a task merges its runs
    by summing between their heads, and one aggregate adds up the tasks. At most ``n_buckets`` rows reach the driver."""

    def encode(batches):
        common.lean()
        keys, sums = np.zeros(0, np.uint16), np.zeros(0, np.int64)
        for b in batches:
            for raw in b.column(0):
                run = np.sort(np.frombuffer(raw.as_buffer(), "<u2"), kind="stable")
                heads = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.zeros(0, np.int64)
                both, n = np.concatenate([keys, run[heads]]), np.concatenate([sums, np.diff(np.append(heads, len(run)))])
                order = np.argsort(both, kind="stable")
                both, n = both[order], n[order]
                heads = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else heads
                keys, sums = both[heads], np.add.reduceat(n, heads) if len(heads) else n
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(sums)], ["bucket", "n"])

    got = packed.select("stream").mapInArrow(encode, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n_buckets, np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target over that in the source, both with one added to every bucket."""
    k, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((float(t + 1) * float(s_all + k)) / (float(s + 1) * float(t_all + k)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: str = SEED) -> int:
    """The document's Gumbel noise in thousandths, from a hash of its id (a null id: of the empty text)."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(packed: DataFrame, gain: np.ndarray, seed: str = SEED) -> DataFrame:
    """(id, words, n_features, weight, score): a row for each document of ``packed``."""

    def weigh(batches):
        common.lean()
        for b in batches:
            for ids, words, ends, raw in zip(*b.columns, strict=True):
                stop = ends.values.to_numpy()
                start = np.concatenate([[0], stop[:-1]]).astype(np.int64)
                weight, full = np.zeros(len(stop), np.int64), stop > start
                if full.any():  # between the starts of two full documents lie only the first one's features
                    weight[full] = np.add.reduceat(gain[np.frombuffer(raw.as_buffer(), "<u2")], start[full])
                shake = np.array([noise(i, seed) for i in ids.values.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([ids.values, words.values, pa.array(stop - start), pa.array(weight), pa.array(weight + shake)], ["id", "words", "n_features", "weight", "score"])

    return packed.select("ids", "words", "ends", "stream").mapInArrow(weigh, "id long, words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", run: int = RUN, n_buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: str = SEED) -> DataFrame:
    """(id, words, n_features, weight, score, rank): every row of ``docs`` with its importance weight; drawn rows have a rank from 1.

    Of the N rows with ``min_words`` words or more, floor(percent N / 100) with the highest scores are drawn; ties go to the
    smaller id, nulls last. Null and empty texts have no features, weight 0 and are not drawn unless min_words is 0. Repeated
    rows are rows of their own; other columns are not read, so their names cannot clash. An empty table gives an empty result;
    an empty target gives every bucket the share that one feature has in it.

    Ranks come from a range partitioning by score: the place in a partition, after the rows of the partitions before it. No
    task holds more than its range.
    """
    spark = docs.sparkSession
    ours = common.stash(streams(docs, id_col, text_col, run, n_buckets), "streams")
    theirs = common.stash(streams(target.withColumn("__none", F.lit(None).cast("long")), "__none", target_text, run, n_buckets), "target")
    gain = gains(counts(ours, n_buckets), counts(theirs, n_buckets))
    scored = common.stash(scores(ours, gain, seed), "scores")
    common.unstash(ours)
    common.unstash(theirs)
    n = scored.where(F.col("words") >= min_words).count()
    best = [F.desc("score"), F.asc_nulls_last("id")]
    ranges = scored.where(F.col("words") >= min_words).repartitionByRange(max(1, -(-n // RANKED)), *best).sortWithinPartitions(*best)
    placed = common.stash(ranges.withColumn("place", F.monotonically_increasing_id()), "ranges")
    placed = placed.withColumn("part", F.shiftright("place", 33)).withColumn("within", F.col("place").bitwiseAND(F.lit((1 << 33) - 1)))
    # a row for each partition of RANKED rows
    firsts = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    rank = F.col("first") + F.col("within") + 1
    drawn = placed.join(firsts, "part").select("id", "words", "n_features", "weight", "score", F.when(rank <= percent * n // 100, rank).alias("rank"))
    rest = scored.where(F.col("words") < min_words).select("id", "words", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return drawn.unionAll(rest)


def op12_importance(spark, sf_dir: str) -> DataFrame:
    out = resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


OP12_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT CAST(i AS UBIGINT) AS i, CAST(i AS UBIGINT) AS v, 0 AS step FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v >> 1, CAST(3988292384 AS UBIGINT)) ELSE v >> 1 END, step + 1 FROM crc WHERE step < 8
), tab AS (SELECT list(v ORDER BY i) AS t FROM crc WHERE step = 8),
folded AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), goal AS (
  SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
), own AS (SELECT doc_id, unnest(w) AS w FROM folded),
vocabulary AS (
  SELECT w, list_transform(generate_series(1, octet_length(encode(w))), lambda p: CAST('0x' || substr(hex(encode(w)), 2 * p - 1, 2) AS UBIGINT)) AS bytes
  FROM (SELECT w FROM own UNION SELECT w FROM goal)
), bucketed AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), bytes), lambda c, b: xor(t[CAST(xor(c % 256, b) AS BIGINT) + 1], c >> 8)), CAST(4294967295 AS UBIGINT)) % 10000 AS bucket
  FROM vocabulary, tab
), s AS (SELECT bucket, count(*) AS s FROM own JOIN bucketed USING (w) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM goal JOIN bucketed USING (w) GROUP BY 1),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(s), 0) FROM s) + 10000 AS DOUBLE))
    / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(t), 0) FROM t) + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT bucket FROM bucketed) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
), weights AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM own JOIN bucketed USING (w) JOIN gain USING (bucket) GROUP BY 1),
scored AS (
  SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM folded LEFT JOIN weights USING (doc_id)
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""
