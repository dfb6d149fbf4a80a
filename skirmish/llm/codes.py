"""Product codes of vectors in whole numbers: exact nearest codebook entries by annular norm pruning.

A part and an entry are at least as far apart as their norms differ. So a codebook's entries are sorted by norm; once a part has
some entry at distance d, only entries with a norm within d of its own can be as near, and these are an interval of that order.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Parts of like norm that are compared with one interval of entries at a time, and the entries that give the first distance.
TILE, FIRST = 64, 8


class Codebook:
    """One part's entries in the order of their norms, for exact nearest-entry queries in whole numbers."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        squares = (self.entries**2).sum(axis=1)
        self.order = np.argsort(squares, kind="stable")
        self.sorted = self.entries[self.order]
        self.squares = squares[self.order]
        self.norms = np.sqrt(self.squares.astype(np.float64))

    def _distances(self, x: np.ndarray, lo: int, hi: int, exact_floats: bool) -> np.ndarray:
        e = self.sorted[lo:hi]
        if exact_floats:  # every sum stays below 2^53, so the products of doubles are whole and exact
            dot = np.rint(x.astype(np.float64) @ e.T.astype(np.float64)).astype(np.int64)
        else:
            dot = x @ e.T
        return (x**2).sum(axis=1)[:, None] + self.squares[None, lo:hi] - 2 * dot

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry for each row of ``x``; ties go to the lower index."""
        n, k = len(x), len(self.sorted)
        most = max(int(np.abs(x).max(initial=0)), int(np.abs(self.entries).max(initial=0)))
        if x.shape[1] * (2 * most) ** 2 >= 1 << 62:
            raise ValueError("components are too large for distances in 64 bits")
        exact_floats = x.shape[1] * most**2 < 1 << 52
        index, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
        norm = np.sqrt((x**2).sum(axis=1).astype(np.float64))
        by_norm = np.argsort(norm, kind="stable")
        for s in range(0, n, TILE):
            rows = by_norm[s : s + TILE]
            tile, size = x[rows], norm[rows]
            at = int(np.searchsorted(self.norms, np.median(size)))
            lo = max(0, min(at - FIRST // 2, k - FIRST))
            first = self._distances(tile, lo, min(k, lo + FIRST), exact_floats).min(axis=1)
            reach = np.sqrt(first.astype(np.float64))
            slack = 1e-9 * (size + reach + 1)  # rounding can only widen the annulus, whose borders belong to it
            a = int(np.searchsorted(self.norms, (size - reach - slack).min(), "left"))
            b = int(np.searchsorted(self.norms, (size + reach + slack).max(), "right"))
            d = self._distances(tile, a, b, exact_floats)
            low = d.min(axis=1)
            index[rows] = np.where(d == low[:, None], self.order[None, a:b], k).min(axis=1)
            best[rows] = low
        return index, best


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """(id, label, v array<long>): vectors whose components are all there and finite, as floor(scale x)."""
    v = F.col(vector_col)
    kept = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    return rows.where(kept).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), scaled.alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths != dim).any():
        raise ValueError(f"vectors differ in length: {dim} and {lengths[lengths != dim][0]}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(lengths), dim)


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks (one array of entries x width per part) after ``rounds`` rounds over all of ``vectors`` (id, v).

    Entries start as the parts of the smallest ids. A round is one job: each task assigns its parts and adds up counts and sums
    per entry, one aggregate joins them, and at most parts x entries rows reach the driver. Sums are whole, so the order of
    rows does not matter.
    """
    first = vectors.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").toArrow().column("v").to_pylist()
    if not first:
        return []
    dim = len(first[0])
    if any(len(v) != dim for v in first) or dim % parts or not dim:
        raise ValueError(f"vectors need one length that {parts} parts divide")
    width = dim // parts
    books = [np.array(first, np.int64)[:, p * width : (p + 1) * width] for p in range(parts)]
    sums = [f"s{j}" for j in range(width)]
    for _ in range(rounds):

        def gather(batches, books=books):
            common.lean()
            ready = [Codebook(b) for b in books]
            total = [np.zeros((len(b), width), np.int64) for b in books]
            count = [np.zeros(len(b), np.int64) for b in books]
            for batch in batches:
                x = _matrix(batch.column(0), dim)
                for p, book in enumerate(ready):
                    own = x[:, p * width : (p + 1) * width]
                    index, _ = book.nearest(own)
                    order = np.argsort(index, kind="stable")
                    heads = np.flatnonzero(np.diff(index[order], prepend=-1))
                    if len(heads):
                        total[p][index[order][heads]] += np.add.reduceat(own[order], heads, axis=0)
                        count[p] += np.bincount(index, minlength=len(count[p]))
            for p in range(len(ready)):
                used = np.flatnonzero(count[p])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(count[p][used]), *[pa.array(total[p][used, j]) for j in range(width)]], ["part", "entry", "n", *sums])

        schema = "part int, entry int, n long, " + ", ".join(f"{s} long" for s in sums)
        got = vectors.select("v").mapInArrow(gather, schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in sums]).toArrow()
        books = [b.copy() for b in books]
        at = (got.column("part").to_numpy(), got.column("entry").to_numpy())
        means = np.stack([got.column(s).to_numpy() for s in sums], axis=1) // got.column("n").to_numpy()[:, None] if got.num_rows else np.zeros((0, width), np.int64)
        for p, e, mean in zip(*at, means, strict=True):
            books[p][e] = mean
    return books


def books_text(books: list[np.ndarray]) -> str:
    """All entries' components in decimals, by part, entry and place, with commas."""
    return ",".join(str(v) for b in books for v in b.ravel().tolist())


def encode(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(id, label, codes binary, error long): a byte per part, and the squared distances' sum."""
    dim = sum(b.shape[1] for b in books)

    def run(batches):
        common.lean()
        ready = [Codebook(b) for b in books]
        for batch in batches:
            x = _matrix(batch.column(2), dim)
            codes, error, at = np.zeros((len(x), len(ready)), np.uint8), np.zeros(len(x), np.int64), 0
            for p, book in enumerate(ready):
                w = book.entries.shape[1]
                index, d = book.nearest(x[:, at : at + w])
                codes[:, p], error, at = index, error + d, at + w
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], ["id", "label", "codes", "error"])

    kind = vectors.schema["label"].dataType.simpleString()
    if not books:
        return vectors.select("id", "label", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("long").alias("error"))
    return vectors.select("id", "label", "v").mapInArrow(run, f"id long, label {kind}, codes binary, error long")


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """((id, label, codes, error), codebooks): the product codes of all vectors of ``rows``.

    Rows whose vector is null or holds null, infinite or NaN components are left out. Repeated rows and ids each get a code; a
    null id ranks last among the first entries; equal distances take the lower entry. Fewer vectors than ``entries`` give that
    many entries; an empty table gives an empty result and no codebooks. Vectors must have one length that ``parts`` divides
    and components that fit 64-bit distances, else a ValueError is raised. Other columns are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte")
    common.small_batches(rows.sparkSession, 20_000, "32MB")
    vectors = common.stash(whole_vectors(rows, id_col, vector_col, label_col, scale), "vectors")
    books = train(vectors, parts, entries, rounds)
    return encode(vectors, books), books


def decode(coded: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """(id, vector array<double>): the vectors that the codes stand for."""

    def run(batches):
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, len(books))
            x = np.concatenate([b[codes[:, p]] for p, b in enumerate(books)], axis=1) / scale
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["id", "vector"])

    return coded.select("id", "codes").mapInArrow(run, "id long, vector array<double>")


def op13_codes(spark, sf_dir: str) -> DataFrame:
    coded, books = compress(common.table(spark, sf_dir, "embeddings"))
    coded = common.stash(coded, "codes")
    # a row per label; the null-safe key keeps null labels together
    key = F.coalesce(F.concat(F.lit("l"), F.col("label").cast("string")), F.lit("n"))
    sums = coded.groupBy(key.alias("key")).agg(F.sum("error").alias("label_error"))
    code = F.lower(F.hex("codes"))
    digest = hashlib.sha256(books_text(books).encode()).hexdigest()
    return coded.withColumn("key", key).join(sums, "key").select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same in SQL: each round is an assignment of all parts to all entries and a mean."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, part, any_value(x) AS x, any_value(label) AS label, CAST(min(d) AS BIGINT) AS d, arg_min(entry, d * {entries} + entry) AS entry
  FROM (SELECT p.vec_id, p.part, p.x, p.label, c.entry, list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, c.x) + list_inner_product(c.x, c.x) AS d FROM p JOIN c{r} c USING (part))
  GROUP BY vec_id, part)""")
        if r < rounds:
            steps.append(f"""
c{r + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
    SELECT part, entry, list(mean ORDER BY i) AS x FROM (
      SELECT part, entry, i, floor(sum(x[i]) / count(*)) AS mean FROM a{r}, (SELECT CAST(i AS BIGINT) AS i FROM range(1, (SELECT max(len(x)) FROM p) + 1) g(i)) GROUP BY part, entry, i)
    GROUP BY part, entry) m USING (part, entry))""")
    return f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda y: floor({SCALE} * CAST(y AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
), p AS MATERIALIZED (
  SELECT vec_id, label, CAST(k AS INTEGER) AS part, list_slice(v, CAST(k AS BIGINT) * (len(v) // {parts}) + 1, (CAST(k AS BIGINT) + 1) * (len(v) // {parts})) AS x FROM v, range({parts}) r(k)
), c0 AS MATERIALIZED (
  SELECT part, CAST(row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS INTEGER) AS entry, x FROM p
  WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {entries})
),{",".join(steps)},
e AS (
  SELECT vec_id, any_value(label) AS label, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id
), b AS (SELECT sha256(string_agg(CAST(CAST(x[i] AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, i)) AS digest FROM c{rounds}, (SELECT CAST(i AS BIGINT) AS i FROM range(1, (SELECT max(len(x)) FROM p) + 1) g(i)))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256 FROM e, b
"""


OP13_SQL = _sql()
