"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 4 bits have a common neighbour within 2 bits of each. So every distinct fingerprint
emits all its variants within half the radius, the variants meet by a shuffle, and fingerprints that share one are linked.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE = 4
SEED = 42
RADIUS = 4
#: The variants meet in so many jobs, one slice of the variants' space each, so that a fraction of them is on disk at a time.
PASSES = 16
#: Variants in a bucket, about: what one task holds.
BUCKET = 1_500_000
_ODD = np.uint64(0x9E3779B97F4A7C15)  # a bijection of 64 bits: slices and buckets are of even size
_BLOCK = 4096  # fingerprints expanded at once


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of one text: a bit is 1 if more than half of the shingles' hashes have it.

    Words are runs of bytes other than ASCII white space, lower-cased in A-Z only; repeats count. Fewer words than a shingle
    are one shingle; no words give 0. Any length is processed whole, in blocks.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        return xxhash.xxh64_intdigest(joined, seed)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lens)
    starts = ends - lens
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for i in range(0, n, 32768):
        j = min(n, i + 32768)
        raw = b"".join([digest(joined[s:e], seed) for s, e in zip(starts[i:j].tolist(), (ends[i + shingle - 1 : j + shingle - 1] - 1).tolist())])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint long): one row per row of ``docs``. Null texts count as empty."""
    common.small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            seen: dict[bytes, int] = {}
            out = []
            for t in common.texts(b.column(1)):
                if (f := seen.get(t)) is None:
                    f = seen[t] = fingerprint(t)
                out.append(f)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], ["id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fingerprint long")


def masks(radius: int) -> np.ndarray:
    """All 64-bit values with at most ``radius`` bits set."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(64), r)], np.uint64)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star of each component of the pairs (a, b), as pairs (smallest, member)."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    keep = root != np.arange(len(nodes))
    return nodes[root[keep]], nodes[keep]


def ball_links(distinct: DataFrame, n: int, radius: int = RADIUS, passes: int = PASSES) -> DataFrame:
    """Links (a, b) between the fingerprints of ``distinct`` (column fingerprint long, no repeats; n of them).

    The links' components are those of all pairs within ``radius`` (even): fingerprints that share a variant are within the
    radius of each other, so each group that meets is linked as a star, and a bucket returns a spanning forest of its links.
    No group emits all its pairs; at most 2081 distinct fingerprints can meet in one variant at radius 4.
    """
    spark = distinct.sparkSession
    common.small_batches(spark, 10_000)
    ball = masks(radius // 2)
    n_buckets = 1 << max(0, int(np.ceil(np.log2(max(1, n) * len(ball) / passes / BUCKET))))
    pass_bits, bucket_bits = passes.bit_length() - 1, n_buckets.bit_length() - 1
    assert passes == 1 << pass_bits
    blocks = distinct.repartition(max(1, -(-n // (4 * _BLOCK))))
    links = []
    for turn in range(passes):

        def emit(batches, turn=turn):
            held: list[np.ndarray] = []

            def flush():
                fp = np.concatenate(held)
                held.clear()
                for i in range(0, len(fp), _BLOCK):
                    part = fp[i : i + _BLOCK]
                    h = ((part[:, None] ^ ball[None, :]) * _ODD).ravel()
                    at = np.flatnonzero((h >> np.uint64(64 - pass_bits)) == turn) if pass_bits else np.arange(len(h))
                    h, who = h[at], (at // len(ball)).astype(np.uint16)
                    bucket = ((h << np.uint64(pass_bits)) >> np.uint64(64 - bucket_bits)) if bucket_bits else np.zeros(len(h), np.uint64)
                    bucket = bucket.astype(np.uint16 if bucket_bits <= 16 else np.int64)
                    order = np.argsort(bucket, kind="stable")
                    h, who, bucket = h[order], who[order], bucket[order]
                    ids, first = np.unique(bucket, return_index=True)
                    stop = [*first[1:].tolist(), len(h)]
                    rows = [(int(k), h[s:e].tobytes(), part[who[s:e]].tobytes()) for k, s, e in zip(ids, first.tolist(), stop)]
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "variants", "fps"])

            for b in batches:
                if b.num_rows:
                    held.append(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
                if sum(map(len, held)) >= 4 * _BLOCK:
                    yield from flush()
            if held:
                yield from flush()

        def meet(group: pa.Table) -> pa.Table:
            h = np.concatenate([np.frombuffer(x, np.uint64) for x in group.column("variants").to_pylist()])
            fp = np.concatenate([np.frombuffer(x, np.uint64) for x in group.column("fps").to_pylist()])
            s = np.sort(h)
            twice = s[1:][s[1:] == s[:-1]]
            if not len(twice):
                return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
            sieve = np.zeros(1 << 20, bool)
            low = np.uint64((1 << 20) - 1)
            sieve[twice & low] = True
            at = np.flatnonzero(sieve[h & low])
            h, fp = h[at], fp[at]
            order = np.lexsort((fp, h))
            h, fp = h[order], fp[order]
            new = np.concatenate([[True], h[1:] != h[:-1]])
            head = fp[np.flatnonzero(new)][np.cumsum(new) - 1]  # the smallest fingerprint with this variant
            pick = ~new
            pairs = np.unique(np.stack([head[pick], fp[pick]], 1), axis=0) if pick.any() else np.zeros((0, 2), np.uint64)
            ok = np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= radius
            a, b = forest(pairs[ok, 0], pairs[ok, 1]) if ok.any() else (np.zeros(0, np.uint64),) * 2
            return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

        met = blocks.select("fingerprint").mapInArrow(emit, "bucket long, variants binary, fps binary").groupBy("bucket").applyInArrow(meet, "a long, b long")
        links.append(common.stash(met, f"links{turn}"))
        common.free_shuffles(spark)
    out = links[0]
    for x in links[1:]:
        out = out.unionAll(x)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, passes: int = PASSES) -> DataFrame:
    """(id, fingerprint long, component long): the component is the smallest id that links of at most ``radius`` differing bits reach.

    Equal fingerprints are one node, so copies cost nothing. Null and empty texts have fingerprint 0 and are linked like any
    other. Repeated rows and ids give a row each; rows with a null id get a null component where no other row is linked.
    Other columns are not read, so their names cannot clash. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = common.stash(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = common.stash(rows.groupBy("fingerprint").agg(F.min("id").alias("low")), "nodes")
    links = ball_links(nodes.select("fingerprint"), nodes.count(), radius, passes)
    roots = common.components(links)
    best = nodes.join(roots, nodes.fingerprint == roots.node, "left").select("fingerprint", "low", F.coalesce("component", "fingerprint").alias("root"))
    by_root = best.groupBy("root").agg(F.min("low").alias("component"))
    named = best.join(by_root, "root").select("fingerprint", "component")
    named = common.stash(named, "named")
    common.free_shuffles(spark)
    return rows.join(named, "fingerprint").select("id", "fingerprint", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near-duplicates, the one with the smallest id.

    Rows that share an id are one document: all of them stay or go. All columns stay as they are.
    """
    marks = near_duplicates(docs, id_col, text_col, **options).where("id = component").select("id").distinct()
    kept = docs.join(marks.withColumnRenamed("id", "__kept"), F.col(id_col) == F.col("__kept"), "left_semi")
    return kept


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(common.table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
