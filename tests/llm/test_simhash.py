import random

import xxhash
from pyspark.sql import functions as F

from skirmish.llm import common, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_fingerprint(text: str) -> int:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_fingerprint_matches_definition():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 5, 40, 900):
        text = " \t\n".join(rng.choice(["The", "É", "cat", "ñu", "X", " x"]) for _ in range(n))
        assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_components_of_paths_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(200, 200), (7, None)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = brute_components([p for p in pairs if None not in p], range(300))
    assert got == {n: c for n, c in want.items() if n <= 40 or 100 <= n < 150}


def test_links_equal_all_pairs(spark):
    rng = random.Random(3)
    fps = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            for _ in range(rng.randrange(1, 6)):
                x ^= 1 << rng.randrange(64)
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.ball_links(spark.createDataFrame([(f,) for f in fps], "fingerprint long"), len(fps), passes=2)
    got = {r.node: r.component for r in common.components(links).collect()}
    near = [(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4]
    want = brute_components(near, fps)
    assert {f: got.get(f, f) for f in fps} == want


def test_edge_rows(spark):
    rows = [(1, None, "en", None, 0), (2, "", None, "s", 0), (3, "a b c d e", "en", "s", 9), (3, "a b c d e", "en", "s", 9), (4, "x " * 50_000, None, None, 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("clash")).withColumn("fingerprint", F.lit(None).cast("string"))
    got = sorted((r.id, r.component) for r in simhash.near_duplicates(docs, passes=1).collect())
    assert got == [(1, 1), (2, 1), (3, 3), (3, 3), (4, 4)]
    assert sorted(r.doc_id for r in simhash.keep_one(docs, passes=1).collect()) == [1, 3, 3, 4]
    assert simhash.near_duplicates(docs.limit(0), passes=1).count() == 0


def test_query_on_small_tables(spark, sf):
    docs = {r.doc_id: r.text for r in common.table(spark, sf, "documents").collect()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op9_simhash(spark, sf).collect()}
    fps = {i: brute_fingerprint(t) for i, t in docs.items()}
    near = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4]
    want = brute_components(near, fps)
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in docs}
