"""Approximate nearest neighbours by an adaptive scan of dimensions within probed lists.

Vectors are rotated at random, so that the first dimensions of a difference tell its length up to a known spread. A list's vectors
lie in column blocks; a scan adds up partial squared distances block by block, and after each block a hypothesis test abandons the
candidates that are, but for a small chance, farther than the query's bound. What is left is measured exactly.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

K = 10
#: Fitted on so many different vectors at most, those with the smallest digests, and on so many numbers at most.
SAMPLE, SAMPLE_NUMBERS = 16_384, 4_000_000
#: Lists at most, and dimensions of a column block.
LISTS, COLUMNS = 1024, 16
#: Numbers in one list block, queries that meet it, and queries that are scanned at once: what a task holds.
BLOCK_NUMBERS, BATCH, AT_ONCE = 1 << 19, 512, 64
#: So many vectors of a block give the first bound of a query that has none.
FIRST = 256
#: The test's level: a candidate goes if its partial distance, scaled up, is over (1 + LEVEL / sqrt(dimensions seen)) times the bound.
LEVEL = 2.1
#: Share of neighbours that the probed lists must hold among the sample's own queries.
RECALL = 0.98
_SEED = 11


class Index:
    """What the driver fits and every task gets: the rotation, the lists' centres and the number of lists to probe."""

    def __init__(self, rotation: np.ndarray, centres: np.ndarray, probes: int):
        self.rotation, self.centres, self.probes = rotation, centres, probes

    def by_distance(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to all centres, up to a constant per row."""
        return (self.centres**2).sum(axis=1)[None, :] - 2 * (x @ self.centres.T)


def fit(sample: np.ndarray, n: int, k: int = K, recall: float = RECALL) -> Index:
    """The index of n vectors, from ``sample``: about sqrt(n) lists by k-means, and as many probes as hold ``recall`` of the k
    nearest sampled vectors of up to 256 sampled queries, on average. A sample is sparser than all rows, so its neighbours lie
    farther off and need more probes than those of all rows do."""
    rng = np.random.default_rng(_SEED)
    dim = sample.shape[1]
    q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
    rotation = q * np.sign(np.diag(r))
    n_lists = max(1, min(LISTS, round(n**0.5), len(sample) // 16))
    centres = sample[rng.permutation(len(sample))[:n_lists]].copy()
    for _ in range(10):
        near = np.argmin(Index(rotation, centres, 1).by_distance(sample), axis=1)
        order = np.argsort(near, kind="stable")
        heads = np.flatnonzero(np.diff(near[order], prepend=-1))
        centres[near[order][heads]] = np.add.reduceat(sample[order], heads, axis=0) / np.diff(np.append(heads, len(near)))[:, None]
    index = Index(rotation, centres, n_lists)
    near = np.argmin(index.by_distance(sample), axis=1)
    asked = sample[:256]
    d = (sample**2).sum(axis=1)[None, :] - 2 * (asked @ sample.T)
    d[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    true = np.argsort(d, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
    place = np.argsort(np.argsort(index.by_distance(asked), axis=1, kind="stable"), axis=1, kind="stable")
    ranks = np.sort(np.take_along_axis(place, near[true], axis=1).ravel())
    if len(ranks):
        index.probes = int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1
    return index


def _matrix(column: pa.Array) -> np.ndarray:
    lengths = np.diff(column.offsets.to_numpy())
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError("vectors differ in length")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(lengths), lengths[0] if len(lengths) else 0)


def distinct_vectors(rows: DataFrame, id_col: str, vector_col: str, keep: int) -> tuple[DataFrame, DataFrame]:
    """((id, key), (key, v, ids)): the rows that take part, once each, and a row per different vector with its ``keep`` smallest ids.

    Copies of a vector are equally near to everything, so no more than ``keep`` of them can be needed; a limit before the shuffle
    keeps as few of a hot vector in every task. ``key`` is a 128-bit digest of the components.
    """
    v = F.col(vector_col)
    whole = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    base = rows.where(whole & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: x.cast("double")).alias("v"))

    def digest(batches):
        for b in batches:
            x = _matrix(b.column(1)) + 0.0  # no negative zeros
            keys = [hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in x]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), b.column(1)], ["id", "key", "v"])

    keyed = common.stash(base.mapInArrow(digest, "id long, key binary, v array<double>"), "keyed")
    pairs = common.stash(keyed.select("id", "key").distinct(), "pairs")
    rank = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    first = pairs.withColumn("r", rank).where(F.col("r") <= keep).groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return pairs, common.stash(keyed.groupBy("key").agg(F.first("v").alias("v")).join(first, "key"), "entries")


def blocks(entries: DataFrame, index: Index) -> tuple[DataFrame, np.ndarray]:
    """(list, sub, keys, ids, n_ids, vectors, columns), and how many blocks each list has.

    Every vector goes to its nearest list; a list is cut into as many blocks as its size asks for. A block has its vectors'
    keys, ids and components, and the rotated components once more by columns: COLUMNS dimensions of all vectors together.
    """

    def assign(batches):
        for b in batches:
            near = np.argmin(index.by_distance(_matrix(b.column(1))), axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32))], ["key", "v", "ids", "list"])

    dim = len(index.rotation)
    size = max(64, BLOCK_NUMBERS // dim)
    placed = common.stash(entries.select("key", "v", "ids").mapInArrow(assign, "key binary, v array<double>, ids array<long>, list int"), "placed")
    subs = np.zeros(len(index.centres), np.int64)
    for r in placed.groupBy("list").count().collect():  # a row per list
        subs[r["list"]] = -(-r["count"] // size)
    cut = subs.tolist()
    parts = F.element_at(F.array(*map(F.lit, cut)), F.col("list") + 1)
    sub = F.pmod(F.xxhash64("key"), parts).cast("int")

    def pack(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids = t.column("ids").to_pylist()
        x = _matrix(t.column("v").chunk(0))
        y = (x @ index.rotation).astype(np.float32)
        out = {
            "list": t.column("list")[:1], "sub": t.column("sub")[:1], "keys": [b"".join(t.column("key").to_pylist())], "ids": [[i for own in ids for i in own]], "n_ids": [list(map(len, ids))],
            "vectors": [x.tobytes()], "columns": [[np.ascontiguousarray(y[:, c : c + COLUMNS].T).tobytes() for c in range(0, dim, COLUMNS)]],
        }
        return pa.table(out, schema=pa.schema([("list", pa.int32()), ("sub", pa.int32()), ("keys", pa.binary()), ("ids", pa.list_(pa.int64())), ("n_ids", pa.list_(pa.int32())), ("vectors", pa.binary()), ("columns", pa.list_(pa.binary()))]))

    packed = placed.withColumn("sub", sub).groupBy("list", "sub").applyInArrow(pack, "list int, sub int, keys binary, ids array<long>, n_ids array<int>, vectors binary, columns array<binary>")
    return common.stash(packed, "blocks"), subs


def scan(queries: np.ndarray, bound: np.ndarray, columns: list[np.ndarray], index: Index, level: float = LEVEL) -> tuple[np.ndarray, np.ndarray, int]:
    """(query, vector, additions): the pairs that every test leaves.

    ``queries`` are rotated, ``bound`` holds squared distances (infinite where none is known), ``columns`` the block's vectors.
    The first column block is measured for all pairs at once, later ones only for the pairs still alive; ``additions`` counts
    the dimensions of pairs that were measured. After the last block the bound itself decides, with room for rounding.
    """
    dim, seen, n = queries.shape[1], len(columns[0]), columns[0].shape[1]
    head = queries[:, :seen]
    partial = np.maximum((head**2).sum(axis=1)[:, None] + (columns[0] ** 2).sum(axis=0)[None, :] - 2 * (head @ columns[0]), 0)

    room = (np.sqrt(bound) * (1 + 1e-5) + 1e-6 * np.sqrt((queries**2).sum(axis=1))) ** 2

    def limit(seen):
        return room if seen == dim else room * (seen / dim) * (1 + level / seen**0.5) ** 2

    work = len(queries) * n * seen
    qi, vi = np.nonzero(partial <= limit(seen)[:, None])
    partial = partial[qi, vi]
    for block in columns[1:]:
        add = np.empty(len(qi))
        for s in range(0, len(qi), 1 << 16):
            q, v = qi[s : s + (1 << 16)], vi[s : s + (1 << 16)]
            add[s : s + (1 << 16)] = ((queries[q, seen : seen + len(block)] - block[:, v].T) ** 2).sum(axis=1)
        work += len(qi) * len(block)
        seen += len(block)
        partial = partial + add
        alive = partial <= limit(seen)[qi]
        qi, vi, partial = qi[alive], vi[alive], partial[alive]
    return qi, vi, work


def _scanned(probes: DataFrame, packed: DataFrame, subs: np.ndarray, index: Index, keep: int) -> DataFrame:
    """(query, distance, ids): what each probed block has within the queries' bounds, at most ``keep`` vectors a query.

    ``probes``: query, list, v, bound. A list's queries are dealt into batches and its vectors into blocks, and every batch meets
    every block once, each pair in a group of its own; so neither a list nor its queries are ever one task's.
    """
    batches = np.zeros(len(subs), np.int64)
    for r in probes.groupBy("list").count().collect():  # a row per list
        batches[r["list"]] = -(-r["count"] // BATCH)
    per = lambda a: F.element_at(F.array(*map(F.lit, a.tolist())), F.col("list") + 1)
    to_all = lambda a: F.explode(F.sequence(F.lit(0), (per(a) - 1).cast("int")))
    left = probes.where(per(subs) > 0).withColumn("batch", F.pmod(F.xxhash64("query"), per(batches)).cast("int")).withColumn("sub", to_all(subs))
    right = packed.where(per(batches) > 0).withColumn("batch", to_all(batches))
    dim = len(index.rotation)

    def meet(q: pa.Table, b: pa.Table) -> pa.Table:
        empty = {"query": pa.array([], pa.binary()), "distance": pa.array([], pa.float64()), "ids": pa.array([], pa.list_(pa.int64()))}
        if not q.num_rows or not b.num_rows:
            return pa.table(empty)
        q, block = q.combine_chunks(), b.slice(0, 1).to_pylist()[0]
        original = _matrix(q.column("v").chunk(0))
        bound = q.column("bound").to_numpy() ** 2
        x = np.frombuffer(block["vectors"], np.float64).reshape(-1, dim)
        columns = [np.frombuffer(c, np.float32).reshape(-1, len(x)).astype(np.float64) for c in block["columns"]]
        if len(x) >= keep and np.isinf(bound).any():  # as many vectors as are asked for bound the rest of the block
            some = x[:FIRST]
            d = (original**2).sum(axis=1)[:, None] + (some**2).sum(axis=1)[None, :] - 2 * (original @ some.T)
            bound = np.minimum(bound, np.maximum(np.partition(d, keep - 1, axis=1)[:, keep - 1], 0))
        pairs = []
        for s in range(0, len(original), AT_ONCE):
            part = slice(s, s + AT_ONCE)
            qi, vi, _ = scan(original[part] @ index.rotation, bound[part], columns, index)
            pairs.append((qi + s, vi, np.concatenate([np.zeros(0), *[np.sqrt(((original[part][qi[i : i + 65536]] - x[vi[i : i + 65536]]) ** 2).sum(axis=1)) for i in range(0, len(qi), 65536)]])))
        qi, vi, exact = map(np.concatenate, zip(*pairs))
        ends = np.cumsum(block["n_ids"])
        first = np.array(block["ids"])[ends - np.array(block["n_ids"])]
        order = np.lexsort((first[vi], exact, qi))
        qi, vi, exact = qi[order], vi[order], exact[order]
        place = np.arange(len(qi)) - np.searchsorted(qi, qi)
        top = place < keep
        names = q.column("query").to_pylist()
        ids = [block["ids"][ends[v] - block["n_ids"][v] : ends[v]] for v in vi[top].tolist()]
        return pa.table({"query": pa.array([names[i] for i in qi[top].tolist()], pa.binary()), "distance": exact[top], "ids": pa.array(ids, pa.list_(pa.int64()))})

    return left.groupBy("list", "sub", "batch").cogroup(right.groupBy("list", "sub", "batch")).applyInArrow(meet, "query binary, distance double, ids array<long>")


def _nearest(found: DataFrame, keep: int) -> DataFrame:
    """(query, id, distance): the ``keep`` nearest ids of each query, ties to smaller ids; tasks keep as few before the shuffle."""
    flat = found.select("query", "distance", F.explode("ids").alias("id"))
    return flat.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))).where(F.col("r") <= keep).drop("r")


def search(rows: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, id, distance): for each row where ``is_query`` (a condition on ``id``), the k nearest other rows that are found.

    Distances are Euclidean, in doubles, between the vectors as given; ties go to the smaller id; fewer than k other rows give
    all of them. Every row is indexed; the index is fitted on at most SAMPLE different vectors. Vectors that are null, zero, or
    hold null or non-finite components take no part, nor do null ids. Rows with an equal id and vector are one row; an id with
    several vectors is a candidate with each and, as a query, gets the nearest of what each finds: the rows of other ids among
    the k + 1 nearest. Vectors of different lengths raise a ValueError. Other columns are not read. An empty table gives an empty
    result. Equal input gives equal output.

    The nearest list is scanned first; the distance of its ``k + 1``-th vector bounds the query in the other lists that it probes.
    A query probes more lists than the index says where those hold too few vectors.
    """
    spark = rows.sparkSession
    common.small_batches(spark, 10_000, "32MB")
    keep = k + 1
    schema = "query_id long, rank int, id long, distance double"
    pairs, entries = distinct_vectors(rows, id_col, vector_col, keep)
    n = entries.count()
    if not n:
        return spark.createDataFrame([], schema)
    dim = len(entries.select("v").first()[0])
    bound = min(SAMPLE, max(64, SAMPLE_NUMBERS // dim))
    sample = _matrix(entries.orderBy("key").limit(bound).select("v").toArrow().combine_chunks().column("v").chunk(0))
    index = fit(sample, n, k, recall)
    packed, subs = blocks(entries, index)
    sizes = np.zeros(len(subs), np.int64)
    for r in packed.groupBy("list").agg(F.sum(F.size("n_ids")).alias("n")).collect():  # a row per list
        sizes[r["list"]] = r["n"]
    asked = pairs.where(is_query)
    queries = common.stash(entries.join(asked.select("key").distinct(), "key").select("key", "v"), "queries")

    def probe(batches):
        for b in batches:
            x = _matrix(b.column(1))
            order = np.argsort(index.by_distance(x), axis=1, kind="stable")
            held = np.cumsum(sizes[order], axis=1)
            enough = np.argmax(held >= min(n, 8 * keep), axis=1) + 1  # lists that hold enough vectors to choose from
            take = np.maximum(index.probes, enough)
            row = np.repeat(np.arange(len(x)), take)
            place = np.arange(len(row)) - np.repeat(np.cumsum(take) - take, take)
            turn = place < enough[row]  # the lists that set the bound
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(order[row, place].astype(np.int32)), b.column(1).take(pa.array(row)), pa.array(turn)], ["query", "list", "v", "first"])

    probes = common.stash(queries.select("key", "v").mapInArrow(probe, "query binary, list int, v array<double>, first boolean"), "probes")
    near = common.stash(_scanned(probes.where("first").withColumn("bound", F.lit(float("inf"))), packed, subs, index, keep), "near")
    # the keep-th nearest id so far; a row per query
    bounds = _nearest(near, keep).groupBy("query").agg(F.when(F.count("*") >= keep, F.max("distance")).otherwise(float("inf")).alias("bound"))
    far = common.stash(_scanned(probes.where("not first").join(bounds, "query"), packed, subs, index, keep), "far")
    best = common.stash(_nearest(near.unionAll(far), keep), "best").groupBy("query").agg(F.collect_list(F.struct("distance", "id")).alias("found"))  # keep rows a query
    flat = asked.join(best, F.col("key") == F.col("query")).select(F.col("id").alias("query_id"), F.explode("found").alias("f")).where("f.id <> query_id").groupBy("query_id", F.col("f.id").alias("id")).agg(F.min("f.distance").alias("distance"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return flat.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def op11_neighbours(spark, sf_dir: str) -> DataFrame:
    out = search(common.table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), F.col("distance").alias("score"))
