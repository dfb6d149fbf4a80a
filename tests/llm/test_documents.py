"""Packing, quality, suffixes, audio, mixing, chunks and language ID on edge rows and against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skirmish.llm import audio, chunks, common, langid, mixing, packing, quality, suffixes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [(1, None, "en", None, 0), (2, "", None, "s", 0), (3, "a b c", "en", "s", 5), (3, "a b c", "en", "s", 5), (None, "no id é", "fr", "t", 7), (9, "long words " * 20_000, "en", "s", 1)]


@pytest.fixture(scope="module")
def edge(spark):
    clash = ["id", "size", "key", "part", "score", "fingerprint", "__x", "piece", "media"]
    return spark.createDataFrame(EDGE, SCHEMA).select("*", *[F.lit("clash").alias(c) for c in clash])


@pytest.fixture(scope="module")
def docs(spark, sf):
    return common.table(spark, sf, "documents")


def test_packing_is_a_partition_of_all_tokens(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    ids = {r.doc_id: [*tokenizer.encode(r.text, add_special_tokens=False).ids, 2] for r in docs.collect()}
    rows = packing.pack_documents(docs.repartition(5), fanout=2).collect()
    seqs = defaultdict(list)
    got = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
        got[r.doc_id].append((r.piece, r.start, r.length))
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    for i, parts in got.items():
        assert [(s, n) for _, s, n in sorted(parts)] == packing.cut_points(len(ids[i]))
    total = sum(map(len, ids.values()))
    assert len(seqs) <= 1.02 * total / 1024 + 2
    assert set(got) == set(ids)


def test_packing_edge_rows(spark, edge):
    rows = packing.pack_documents(edge).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.length) for r in rows if r.doc_id != 9) == [(False, 1, 1), (False, 2, 1), (False, 3, 4), (False, 3, 4), (True, 0, 4)]
    assert packing.pack_documents(edge.limit(0)).count() == 0
    unique = edge.where("doc_id in (1, 9)")
    out = packing.sequences(unique).collect()
    assert sum(len(r.ids) for r in out) == sum(r.length for r in rows if r.doc_id in (1, 9))


def test_best_fit_fills_the_tightest_bin():
    bins, offsets, free = packing.best_fit(np.array([6, 5, 4, 5]), 10)
    assert sorted(free) == [0, 0] and bins[0] == bins[2] and bins[1] == bins[3]
    done, up = packing.pack(np.array([[i, 0, 0, 600, 0] for i in range(50)]), False, 0, carry=10)
    assert len(up) == 10 and len(done) == 40


def test_suffixes_equal_brute_force(spark, docs, edge):
    def brute(texts):
        raw = [(i, (t or "").encode()) for i, t in texts]
        count = Counter(t[i : i + 200] for _, t in raw for i in range(len(t) - 199))
        out = []
        for i, t in raw:
            mark = bytearray(len(t))
            for p in range(len(t) - 199):
                if count[t[p : p + 200]] > 1:
                    mark[p : p + 200] = b"\1" * 200
            spans = sum(1 for p in range(len(mark)) if mark[p] and not (p and mark[p - 1]))
            out.append((i, len(t), sum(mark), spans, hashlib.sha256(bytes(c for c, m in zip(t, mark) if not m)).hexdigest()))
        return sorted(out, key=str)

    def ours(df):
        return sorted(((r.id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffixes.remove_repeats(df).collect()), key=str)

    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(600)) for _ in range(3)]
    made = []
    for i in range(60):
        s = rng.choice(base)
        a, n = rng.randrange(0, 350), rng.randrange(190, 320)
        made.append((i, "".join(rng.choice("xyzé ") for _ in range(rng.randrange(0, 60))) + s[a : a + n] + "".join(rng.choice("uvw ") for _ in range(rng.randrange(0, 60)))))
    made += [(100, "ab" * 300), (101, "q" * 230), (102, base[0]), (103, base[0][1:])]
    df = spark.createDataFrame(made, "doc_id long, text string")
    assert ours(df) == brute(made)
    assert ours(edge.where("doc_id is null or doc_id <> 9")) == brute([(i, t) for i, t, *_ in EDGE if i != 9])
    sample = [(r.doc_id, r.text) for r in docs.collect()]
    assert ours(docs) == brute(sample)
    assert suffixes.remove_repeats(edge.limit(0)).count() == 0


def test_prefix_loser_tree_merges_and_shares():
    rng = random.Random(2)
    runs, everything = [], []
    for _ in range(7):
        items = sorted("".join(rng.choice("ab") for _ in range(rng.randrange(0, 12))).encode() for _ in range(rng.randrange(0, 30)))
        everything += items
        runs.append([(s, suffixes.common_prefix(items[i - 1], s, 0) if i else 0, None) for i, s in enumerate(items)])
    got = list(suffixes.PrefixLoserTree(runs))
    assert [s for s, _, _ in got] == sorted(everything)
    for (a, _, _), (b, n, _) in zip(got, got[1:]):
        assert n == suffixes.common_prefix(a, b, 0)
    blob = suffixes.front_code([(s, b"l", 5, i) for i, s in enumerate(sorted(everything))])
    assert [s for s, _, _ in suffixes.decode_run(blob)] == sorted(everything)


def test_audio_round_trip_and_equal_texts(spark, edge):
    rows = audio.digest(audio.store(edge)).collect()
    by = {r.id: r for r in rows if r.id is not None}
    for i, text, *_ in EDGE:
        if i is None:
            continue
        raw = (text or "").encode()
        full = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
        assert (by[i].n_bytes, by[i].payload_bytes, by[i].payload_sha256, by[i].tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
    assert by[1].feature == by[2].feature != by[3].feature
    clips = audio.tensors(audio.store(edge).where("id = 9")).orderBy("clip").collect()
    assert len(clips) > 3 and all(len(c.log_mel) == audio.CLIP * audio.BANDS for c in clips)
    assert all(abs(a.end_s - b.start_s) < 1e-9 for a, b in zip(clips, clips[1:]))
    assert audio.digest(audio.store(edge.limit(0))).count() == 0


def test_audio_parts_against_plain_forms():
    rng = np.random.default_rng(1)
    x = rng.normal(size=999).astype(np.float32)
    up, down, taps = 3, 2, 8
    h = audio._phases(up, down, taps)
    proto = h.T.reshape(-1)  # the filter before it was split
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    full = np.convolve(wide, proto)
    want = full[(taps // 2 - 1) * up :][::down][: -(-len(x) * up // down)]
    got = audio.resample(x, up, down, taps)
    assert np.allclose(got[20:-20], want[20 : len(got) - 20], atol=1e-4)
    energy = np.array([0, 5, 1, 1, -5, -5, 4, -5], float)
    assert audio.segments(energy, 0.9, -0.2) == [(1, 4), (6, 7)]
    t = audio.tensor_array(np.zeros((2, audio.CLIP, audio.BANDS), np.float32))
    assert t.type.shape == [audio.CLIP, audio.BANDS] and len(t) == 2
    data, rate = audio.read_wav(audio.wav(b"abc"))
    assert (data, rate) == (b"abc", audio.RATE)


def test_mixing_targets_and_copies(spark, edge):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randrange(0, 400), "en", rng.choice(["a", "b", "c", "c", "c", "d", None]), 0) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(df).collect()
    assert {r.id for r in out} == {r[0] for r in rows}
    per = defaultdict(int)
    goal = {}
    for r in out:
        per[r.source] += r.copies * r.size
        goal[r.source] = r.target
        assert 0 <= r.copies <= 3
    assert abs(sum(goal.values()) - sum(r.size for r in out)) < 1e-6 * sum(goal.values())
    for s, t in goal.items():
        assert t <= 3 * sum(r.size for r in out if r.source == s) + 1e-6
        assert abs(per[s] - t) <= 0.03 * t + 400
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    assert len(mixing.mix(edge).collect()) == len(EDGE)
    assert mixing.mix(edge.limit(0)).count() == 0
    copies = {r.id: r.copies for r in out}
    assert Counter(r.doc_id for r in mixing.apply_mix(df).collect()) == Counter({i: c for i, c in copies.items() if c})


def test_chunks_shift_and_successors(spark, edge):
    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 9))) for _ in range(2000))
    own, moved = chunks.digests(text.encode()), chunks.digests(("some new start " + text).encode())
    assert chunks.containment(own, moved) > 0.95 and chunks.containment(own, chunks.digests(text[::-1].encode())) == 0
    assert chunks.decode(chunks.encode(own)) == own
    data = text.encode()
    assert b"".join(data[a:b] for a, b in chunks.chunks(data)) == data
    rows = [(i * 3 % 101, text[i * 50 : i * 50 + 300] + "é😀") for i in range(101)]
    got = {r.id: r for r in chunks.compare_next(spark.createDataFrame(rows, "doc_id long, text string"), ranges=5).collect()}
    order = sorted(rows)
    for (i, t), (_, nxt) in zip(order, [*order[1:], order[0]]):
        half = len(t) // 2
        changed = t[: len(t) - half] + nxt[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert got[i].near_next == chunks.containment(chunks.digests(t.encode()), chunks.digests(nxt.encode()))
    out = chunks.compare_next(edge, ranges=3).collect()
    assert len(out) == len(EDGE) and {r.n_chars for r in out} == {len(t or "") for _, t, *_ in EDGE}
    assert len({r.fingerprint for r in out if r.id == 3}) == 1
    assert chunks.compare_next(edge.limit(0)).count() == 0


def test_language_id(spark, docs, edge, sf):
    model = langid.fitted(docs)
    rows = langid.predict(docs, model).join(docs.select("doc_id", "lang"), F.col("id") == F.col("doc_id")).where(langid.held_out("id")).collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)
    got = {r.id: (r.lang_pred, r.score) for r in langid.predict(edge, model).collect()}
    assert got[1] == got[2] == ("und", 0.0) and 0 <= got[9][1] <= 1
    assert langid.predict(edge.limit(0), model).count() == 0
    texts = {r.lang: r.text for r in docs.where("n_chars > 1500").collect()}
    en, fr = texts["en"][:700], texts["fr"][:700]
    spans = model.spans(en + " " + fr)
    assert [s[2] for s in spans][0] == "en" and spans[-1][2] == "fr" and len(spans) <= 4
    assert langid.keep_known(docs.limit(20), model).columns == docs.columns
    assert model.predict("Привет мир")[0] in (*model.langs, "und")


def test_viterbi_shortcut_equals_the_full_path():
    rng = np.random.default_rng(3)
    model = langid.Model(["a", "b", "c"], rng.integers(0, 50, (3, 1 << langid.BITS)), np.ones((3, len(langid.SCRIPT_NAMES)), int))

    def plain(score):
        best = [(list(score[0]), [[k] for k in range(3)])]
        state, paths = best[0]
        for row in score[1:]:
            top = max(range(3), key=lambda k: state[k])
            nxt, new = [], []
            for k in range(3):
                if state[top] - langid.SWITCH > state[k]:
                    nxt.append(state[top] - langid.SWITCH + row[k])
                    new.append([*paths[top], k])
                else:
                    nxt.append(state[k] + row[k])
                    new.append([*paths[k], k])
            state, paths = nxt, new
        return max(state)

    for n in (1, 2, 30, 200):
        for spread in (0.5, 3.0, 8.0):
            score = rng.normal(scale=spread, size=(n, 3))
            path = model.path(score)
            value = score[np.arange(n), path].sum() - langid.SWITCH * np.count_nonzero(np.diff(path))
            assert abs(value - plain(score)) < 1e-6


def test_quality(spark, docs, edge, sf):
    labels = common.table(spark, sf, "labels")
    model = quality.fit(docs, labels.where(~quality.held_out()))
    rows = quality.score(docs, model).join(labels, F.col("id") == F.col("doc_id")).collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert sum(s >= quality.THRESHOLD for s in good) >= 0.9 * len(good)
    assert np.mean(good) > np.mean(bad) + 0.3
    got = quality.score(edge, model).collect()
    assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got)
    assert quality.score(edge.limit(0), model).count() == 0
    none = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(edge, none).collect()} == {0.5}


def test_packing_of_partitions_with_lengths_of_their_own(spark):
    """Two partitions of 600 tokens a document and two of 360: one of each fills a sequence, however many a partition has."""
    text = F.when(F.col("id") < 50_000, F.repeat(F.lit(" a"), 599)).otherwise(F.repeat(F.lit(" a"), 359))
    rows = spark.range(0, 100_000, 1, 4).select(F.col("id").alias("doc_id"), text.alias("text"))
    for options in ({}, {"node": 30_000}):
        out = packing.pack_documents(rows, **options).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("k"), F.min("offset").alias("o")).agg(F.count("*"), F.sum("k"), F.max("n"), F.max("o")).first()
        assert out[0] <= 50_000 + 8 and tuple(out[1:]) == (100_000, 960, 0)


def test_dealt_pieces_are_all_pieces_in_equal_mixes():
    pieces = np.array([[i, 0, 0, n, 0] for i, n in enumerate([600] * 500 + [100] * 300)])
    for nodes in (1, 3, 64, 700):
        parts = packing.deal(5, pieces, nodes)
        assert len({k for k, _ in parts}) == len(parts) and all(0 <= k < nodes for k, _ in parts)
        assert sorted(np.concatenate([x for _, x in parts])[:, 0].tolist()) == list(range(800))
        counts = [int((x[:, 3] == 600).sum()) for _, x in parts]
        assert max(counts) - min(counts) <= 1


def test_packing_ids_of_added_tokens(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "no <|endoftext| > here", "word " * 3000 + "<|endoftext|>é"]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 220, 50256, 275]
    got = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for i, ids in enumerate(want):
        raw = np.array([*ids, packing.END], "<u4").tobytes()
        cuts = [(p, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])) for p, (s, n) in enumerate(packing.cut_points(len(ids) + 1))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == i) == cuts
