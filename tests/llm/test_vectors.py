"""Nearest neighbours, product codes and importance resampling: brute force, edge rows, plain forms."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skirmish.llm import codes, common, importance, neighbours

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(ids, x, i, k=10):
    d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
    return [(int(ids[j]), d[j]) for j in np.lexsort((ids, d)) if ids[j] != ids[i]][:k]


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.id, r.distance))
        assert r.rank == len(out[r.query_id])
    return out


def test_neighbours_recall(spark, sf):
    rows = common.table(spark, sf, "embeddings")
    e = rows.toPandas()
    ids, x = e.vec_id.to_numpy(), np.stack(e.embedding.to_numpy()).astype(float)
    got = found(neighbours.search(rows, F.col("id") % 10 == 0))
    hit = total = 0
    for i in np.flatnonzero(ids % 10 == 0):
        true, own = brute(ids, x, i), got[ids[i]]
        assert len(own) == len(true) and own == sorted(own, key=lambda p: (p[1], p[0]))
        where = {v: j for j, v in enumerate(ids)}
        assert all(abs(d - np.sqrt(((x[where[v]] - x[i]) ** 2).sum())) < 1e-12 for v, d in own)
        hit, total = hit + len({v for v, _ in true} & {v for v, _ in own}), total + len(true)
    assert hit / total >= 0.9


def test_neighbours_with_groups_of_copies(spark, monkeypatch):
    """A third of the rows is one vector, the lists are cut into many blocks and batches: still ten each, ties by id."""
    monkeypatch.setattr(neighbours, "BLOCK_NUMBERS", 512)
    monkeypatch.setattr(neighbours, "BATCH", 16)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((900, 20)).astype(np.float32)
    x[::3] = x[0]
    x[1::9] = x[1]
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VECTORS)
    got = found(neighbours.search(rows, F.col("id") % 5 == 0))
    assert sorted(got) == list(range(0, 900, 5))
    hit = sum(len({v for v, _ in got[i]} & {v for v, _ in brute(np.arange(900), x.astype(float), i)}) for i in got)
    assert hit >= 9.5 * len(got)
    assert got[0] == [(3 * j, 0.0) for j in range(1, 11)] and got[30][:1] == [(0, 0.0)] and 30 not in dict(got[30])
    again = found(neighbours.search(rows.repartition(7), F.col("id") % 5 == 0))
    assert again == got


def test_neighbours_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [1.0, inf], 1), (6, [1.0, None], 1), (None, [1.0, 0.0], 1), (100, [1.0, 0.5], None), (7, [-0.0, 3.0], 1)]
    clash = [F.lit("clash").alias(c) for c in ("id", "key", "list", "ids", "v", "r", "query", "distance", "bound")]
    rows = spark.createDataFrame(data, VECTORS).select("*", *clash)
    got = found(neighbours.search(rows, F.col("id") % 100 == 0))
    assert got == {0: [(100, 0.5), (1, 1.0), (7, math.sqrt(10))], 100: [(0, 0.5), (1, math.sqrt(1.25)), (7, math.sqrt(7.25))]}
    assert found(neighbours.search(rows.limit(0), F.col("id") % 100 == 0)) == {}
    assert found(neighbours.search(rows.where("vec_id = 0"), F.col("id") % 100 == 0)) == {}


def test_scan_abandons_early_but_keeps_the_near():
    rng = np.random.default_rng(3)
    x = 2 * rng.standard_normal((50, 64))[rng.integers(0, 50, 2000)] + rng.standard_normal((2000, 64))
    index = neighbours.fit(x[:1000], 2000)
    assert np.allclose(index.rotation @ index.rotation.T, np.eye(64))
    q = x[:20] + 0.3 * rng.standard_normal((20, 64))
    d = ((q[:, None, :] - x[None]) ** 2).sum(axis=2)
    bound = np.sort(d, axis=1)[:, 10]
    y = x @ index.rotation
    qi, vi, work = neighbours.scan(q @ index.rotation, bound, [y[:, c : c + 16].T for c in range(0, 64, 16)], index)
    near = {(i, j) for i in range(20) for j in np.argsort(d[i])[:10]}
    assert len(near & set(zip(qi.tolist(), vi.tolist()))) >= 0.97 * len(near)
    assert work < 0.5 * d.size * 64
    assert (d[qi, vi] <= bound[qi] * 1.001).all()


def test_nearest_entry_is_exact_with_ties():
    rng = np.random.default_rng(1)
    for scale, width in ((3, 4), (300, 16), (1 << 27, 8)):
        entries = rng.integers(-scale, scale + 1, (256, width))
        entries[200] = entries[10]
        x = np.concatenate([rng.integers(-scale, scale + 1, (500, width)), entries[:50], np.zeros((1, width), np.int64)])
        d = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
        index, best = codes.Codebook(entries).nearest(x)
        assert (index == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    with pytest.raises(ValueError):
        codes.Codebook(np.array([[1 << 40]])).nearest(np.array([[0]]))


def test_norms_prune_entries():
    """Entries of far norms are never measured."""
    entries = np.arange(256)[:, None] * np.array([[1000, 0]])
    book, seen = codes.Codebook(entries), []
    plain = book._distances
    book._distances = lambda x, lo, hi, e: (seen.append(hi - lo), plain(x, lo, hi, e))[1]
    index, _ = book.nearest(np.repeat(np.array([[5200, 3]]), 10, axis=0))
    assert (index == 5).all() and max(seen) <= codes.FIRST


def plain_codes(rows):
    """The contract once more, in Python's whole numbers: [(id, code, error, label)] and the final entries."""
    kept = sorted((i, [math.floor(1024 * c) for c in v], label) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v))
    w = len(kept[0][1]) // 4
    parts = [[v[p * w : p * w + w] for _, v, _ in kept] for p in range(4)]
    books = [[own[e] for e in range(min(256, len(own)))] for own in parts]

    def assign(p):
        return [min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p])) for x in parts[p]]

    for _ in range(4):
        for p in range(4):
            got = assign(p)
            for k in range(len(books[p])):
                own = [x for x, (_, at) in zip(parts[p], got) if at == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    last = [assign(p) for p in range(4)]
    return [(i, "".join(f"{last[p][r][1]:02x}" for p in range(4)), sum(last[p][r][0] for p in range(4)), label) for r, (i, _, label) in enumerate(kept)], books


def test_codes_equal_plain_form(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [round(float(c), 2) for c in rng.standard_normal(8)], int(i % 3) if i % 4 else None) for i in range(400)]
    rows += [(400, None, 1), (401, [float("nan")] * 8, 1), (402, [1.0] * 7 + [None], 1), (403, [float("-inf")] * 8, 1), (404, [0.0] * 8, None), (405, rows[7][1], 2)]
    clash = [F.lit("clash").alias(c) for c in ("id", "v", "codes", "error", "key", "code")]
    df = spark.createDataFrame(rows, VECTORS.replace("float", "double")).select("*", *clash)
    want, books = plain_codes(rows)
    coded, got_books = codes.compress(df.repartition(5))
    assert [b.tolist() for b in got_books] == books
    assert sorted((r.id, r.codes.hex(), r.error, r.label) for r in coded.collect()) == sorted(want, key=lambda r: r[0])
    back = {r.id: r.vector for r in codes.decode(coded, got_books).collect()}
    far = sum((1024 * a - math.floor(1024 * b)) ** 2 for i, v, _ in rows[:400] for a, b in zip(back[i], v))
    assert abs(far - sum(e for i, _, e, _ in want if i < 400)) < 1e-3
    empty, none = codes.compress(df.limit(0))
    assert empty.count() == 0 and none == []
    twice, _ = codes.compress(df.where("vec_id < 3").unionAll(df.where("vec_id < 3")))
    assert twice.count() == 6 and {r.error for r in twice.collect()} == {0}


def plain_resample(docs, target, run=1):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return w, [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in range(1, run + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(b for _, x in docs for b in features(x)[1]), Counter(b for x in target for b in features(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + 10_000) / ((s[b] + 1) * (sum(t.values()) + 10_000))))
    out = []
    for i, x in docs:
        w, f = features(x)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append((i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((-r[4], r[0] is None, r[0] or 0, n) for n, r in enumerate(out) if r[1] >= 20)
    ranks = {n: k + 1 for k, (*_, n) in enumerate(able[: len(able) // 10])}
    return sorted(((*r, ranks.get(n)) for n, r in enumerate(out)), key=str)


@pytest.mark.parametrize("run", [1, 2])
def test_resampling_equals_plain_form(spark, sf, run, monkeypatch):
    monkeypatch.setattr(importance, "BLOCK", 500)
    monkeypatch.setattr(importance, "RANKED", 20)
    docs = [(r.doc_id, r.text) for r in common.table(spark, sf, "documents").select("doc_id", "text").collect()]
    docs += [(-1, None), (-2, ""), (-3, "... !"), (-4, "Ünïcode ÀB aB ab 9x \x00 a b"), (-5, "word " * 100_000), (-6, "one two " * 30), (-7, "one two " * 30), (None, "no id " * 30)]
    target = [r.text for r in common.table(spark, sf, "benchmark").collect()] + [None, ""]
    clash = [F.lit("clash").alias(c) for c in ("id", "ids", "words", "stream", "rank", "score", "part", "place")]
    df = spark.createDataFrame(docs, "doc_id long, text string").select("*", *clash).repartition(6)
    got = importance.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), run=run)
    assert sorted(((r.id, r.words, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()), key=str) == plain_resample(docs, target, run)


def test_resampling_edge_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    target = spark.createDataFrame([], "text string")
    rows = importance.resample(docs, target, percent=100, min_words=0).collect()
    assert sorted(r["rank"] for r in rows) == [1, 2, 3] and {r.weight for r in rows if r.id == 2} == {0}
    assert importance.resample(docs.limit(0), target).count() == 0
    packed = importance.streams(docs).collect()
    assert sum(len(r.stream) for r in packed) == 2 * 4 and pa.array([r.ends[-1] for r in packed]).to_pylist() == [len(r.stream) // 2 for r in packed]
