"""Document fingerprints by content-defined chunking: normalised gear-hash boundaries, chunk digests weighted by length."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of a chunk: at least, the length around which the boundary's mask changes, at most (the last chunk may be shorter).
LEAST, NORMAL, MOST = 16, 64, 256
#: Bits that a boundary's hash has zero: before NORMAL bytes, and after.
STRICT, LOOSE = 8, 4
_BLOCK = 1 << 22
# one 32-bit number per byte value, by rule
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], np.uint32)


def boundaries(data: bytes) -> tuple[list[int], list[int]]:
    """Places after which a chunk may end, for the strict and for the loose mask: functions of the last 32 bytes alone."""
    strict, loose = [], []
    for at in range(0, len(data), _BLOCK):
        lead = min(at, 31)
        h = GEAR[np.frombuffer(data, np.uint8, min(len(data), at + _BLOCK) - at + lead, at - lead)]
        for s in (1, 2, 4, 8, 16):  # doubling: after these steps h covers 32 bytes
            nxt = h.copy()
            nxt[s:] += h[:-s] << np.uint32(s)
            h = nxt
        ends = np.flatnonzero(h[lead:] >> np.uint32(32 - LOOSE) == 0)
        loose.append(ends + (at + 1))
        strict.append(ends[h[lead:][ends] >> np.uint32(32 - STRICT) == 0] + (at + 1))
    return (np.concatenate(strict).tolist(), np.concatenate(loose).tolist()) if loose else ([], [])


def chunks(data: bytes) -> list[tuple[int, int]]:
    """(start, end) of the chunks: normalised chunking looks for a strict boundary up to NORMAL bytes, then for a loose one."""
    strict, loose = boundaries(data)
    strict.append(len(data) + MOST)
    loose.append(len(data) + MOST)
    out, start, n = [], 0, len(data)
    while start < n:
        end = strict[bisect_left(strict, start + LEAST)]
        if end >= start + NORMAL:
            end = min(loose[bisect_left(loose, start + NORMAL)], start + MOST)
        end = min(end, n)
        out.append((start, end))
        start = end
    return out


def digests(data: bytes) -> dict[int, int]:
    """48-bit digest -> length, of the distinct chunks."""
    hashed = xxhash.xxh3_64_intdigest
    return {hashed(data[a:b]) >> 16: b - a for a, b in chunks(data)}


def encode(found: dict[int, int]) -> str:
    """12 hex digits of digest and 4 of length for each chunk, sorted."""
    return "".join([f"{d:012x}{n:04x}" for d, n in sorted(found.items())])


def decode(fingerprint: str) -> dict[int, int]:
    return {int(fingerprint[i : i + 12], 16): int(fingerprint[i + 12 : i + 16], 16) for i in range(0, len(fingerprint), 16)}


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of a's length (in distinct chunks) that lies in chunks of b. Two empty sets: 1; one empty set: 0."""
    if not a or not b:
        return float(not a and not b)
    return sum(n for d, n in a.items() if d in b) / sum(a.values())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint string): one row per row of ``docs``; null texts are empty, and empty texts have an empty fingerprint."""
    common.small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encode(digests(t)) for t in common.texts(b.column(1))], pa.string())], ["id", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fingerprint string")


_LOW = np.iinfo(np.int64).min


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """(part, extra, id, text): rows dealt by ranges of id and sorted in them; each range also holds, as ``extra``, the first
    rows of the next one (of the last range: of the first), so that every row's successor is in its own partition.

    Range bounds come from quantiles of the ids, their number being that of shuffle partitions; texts are shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LOW)).alias("id"), F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.select("id")
    cuts = ids.selectExpr(f"percentile_approx(id, array({', '.join(str(i / n) for i in range(n))}), {100 * n}) as q").first()[0] or []
    cuts = np.unique(np.array(cuts[1:], np.int64))

    def part_of(batches, cuts=cuts):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(cuts, b.column(0).to_numpy(), side="right"), pa.int32()), b.column(0)], ["part", "id"])

    first = sorted(tuple(r) for r in ids.mapInArrow(part_of, "part int, id long").groupBy("part").agg(F.min("id")).collect())  # a row per range
    parts = np.array([p for p, _ in first], np.int64)
    heads = np.array([i for _, i in first], np.int64)

    def deal(batches, cuts=cuts, parts=parts, heads=heads):
        for b in batches:
            ids = b.column(0).to_numpy()
            k = np.searchsorted(parts, np.searchsorted(cuts, ids, side="right"))
            lead = np.flatnonzero(heads[k] == ids)
            idx = pa.array(np.concatenate([np.arange(len(ids)), lead]))
            part = np.concatenate([k, (k[lead] - 1) % len(parts)])
            extra = np.arange(len(part)) >= len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(extra), *[c.take(idx) for c in b.columns]], ["part", "extra", "id", "no_id", "text"])

    common.small_batches(spark)
    dealt = rows.mapInArrow(deal, "part int, extra boolean, id long, no_id boolean, text string")
    return dealt.repartitionById(max(1, len(parts)), F.col("part")).sortWithinPartitions("part", "extra", "id", "text")


def edited(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by as many first code points of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): one row per row of ``docs``.

    The next document is the next row by (id, text), null ids first, after the last one the first; null texts are empty. A
    table of one row is its own successor. Ties of id go by text; equal texts have equal fingerprints; other columns are not
    read; an empty table gives an empty result.
    """
    import hashlib

    def run(batches):
        held = None  # part, id, no_id, text, digests
        for b in batches:
            out = []
            for part, extra, key, no_id, text in zip(*[c.to_pylist() for c in b.columns]):
                if held is not None and held[0] != part:
                    held = None
                if held == (part, "done"):
                    continue
                own = digests(text.encode())
                if held is not None:
                    _, key0, no_id0, text0, own0 = held
                    changed = edited(text0, text).encode()
                    other = digests(changed)
                    out.append((None if no_id0 else key0, len(text0), hashlib.sha256(changed).hexdigest(), encode(own0), encode(other), containment(own0, other), containment(own0, own)))
                held = (part, "done") if extra else (part, key, no_id, text, own)
            cols = list(zip(*out)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return in_order(docs, id_col, text_col, ranges).mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op8_chunks(spark, sf_dir: str) -> DataFrame:
    return compare_next(common.table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
