"""Removal of repeated byte strings by sorted suffixes: a distributed merge sort that knows common prefixes.

Only suffixes at content-defined anchors are sorted: the smallest hash of the GRAM-byte strings in every window of LENGTH
bytes, which equal windows choose alike. So two equal windows share an anchor at the same place, and whatever is repeated is
seen in the neighbourhoods of suffixes that start with the same gram.

1. Every partition finds its anchors and sends their gram's hash: a sieve that only drops anchors whose gram occurs once.
2. The suffixes at the others are sorted in each partition. The sorted runs are exchanged front-coded, and loser trees merge
   them that compare only past the prefixes known to be common. In the merged order the common prefixes of neighbours tell
   which suffixes agree in their first r bytes; what is left of the anchors is ordered in the same way. A window is repeated if
   its two parts agree with those of another suffix: ranks in the two orders are compared, bytes behind them, no hashes.
3. The marked ranges of a document are united and its other bytes kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH = 200
GRAM = 40
_SPAN = LENGTH - GRAM  # bytes left of an anchor that a window with it may hold
#: Anchors, and suffixes, that meet in one group, about.
BUCKET, SUFFIXES = 100_000, 25_000
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_MIX = np.array([xxhash.xxh64_intdigest(bytes([b]), 11) for b in range(256)], np.uint64)  # by rule: a number per byte value


def _power(n: int) -> np.uint64:
    return _U(pow(int(_BASE), n, 1 << 64))


def gram_hashes(raw: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes from each place on, by doubling."""
    have, width, out, filled = _MIX[raw], 1, None, 0
    while True:
        if size & width:
            out = have if out is None else out[: len(out) - width] * _power(width) + have[filled:][: len(out) - width]
            filled += width
        if width * 2 > size:
            break
        have = have[:-width] * _power(width) + have[width:]
        width *= 2
    out = out ^ (out >> _U(29))
    out = out * _U(0xBF58476D1CE4E5B9)
    return out ^ (out >> _U(32))


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(places, gram hashes) of the anchors: in every LENGTH bytes, the place of the smallest gram hash, the first of equal ones."""
    if len(text) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(np.frombuffer(text, np.uint8))
    key = (h & _U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    low, width = key, 1
    while width * 2 <= _SPAN + 1:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = _SPAN + 1 - width
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    at = np.unique(low & _U(0xFFFFFFFF)).astype(np.int64)
    return at, h[at]


def common_prefix(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of a and b, of which ``at`` bytes are known."""
    n = min(len(a), len(b))
    step = 8
    while at < n:
        z = min(n, at + step)
        if a[at:z] == b[at:z]:
            at, step = z, step * 2
        elif z - at == 1:
            return at
        else:
            step = max(1, (z - at) // 2)
            if step == 1:
                while at < z and a[at] == b[at]:
                    at += 1
                return at
    return at


class PrefixLoserTree:
    """Merges sorted runs of (bytes, prefix shared with the run's previous string, payload).

    Each player knows how much it shares with the last string that left. The one that shares more is the smaller; only
    equal shares are compared, from that byte on. Iterating yields (bytes, prefix shared with the previous one, payload).
    """

    def __init__(self, runs: list):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        self.known = [0] * len(runs)
        self.losers = [-1] * max(1, len(runs))
        self.winner = self._build(1) if runs else -1

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix becomes what it shares with the winner."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        p, q = self.known[a], self.known[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        n = common_prefix(x[0], y[0], p)
        s, t = x[0], y[0]
        less = (s[n] < t[n]) if n < len(s) and n < len(t) else (len(s) < len(t) or (len(s) == len(t) and a < b))
        win, lose = (a, b) if less else (b, a)
        self.known[lose] = n
        return win, lose

    def _build(self, node: int) -> int:
        k = len(self.runs)
        if node >= k:
            return node - k
        win, self.losers[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return win

    def __iter__(self):
        k = len(self.runs)
        while k and self.heads[self.winner] is not None:
            w = self.winner
            text, _, payload = self.heads[w]
            yield text, self.known[w], payload
            self.heads[w] = nxt = next(self.runs[w], None)
            self.known[w] = nxt[1] if nxt is not None else 0
            node = (w + k) // 2
            while node:
                w, self.losers[node] = self._play(self.losers[node], w)
                node //= 2
            self.winner = w


def front_code(items: list[tuple[bytes, bytes, int, int]]) -> bytes:
    """A run: sorted (suffix, left side reversed, key, place), each side without the prefix it shares with the one before, compressed."""
    shared, cut, keys, places = ([], []), ([], []), [], []
    last = [b"", b""]
    for *sides, key, place in items:
        for i, x in enumerate(sides):
            n = common_prefix(last[i], x, 0)
            shared[i].append(n)
            cut[i].append(x[n:])
            last[i] = x
        keys.append(key)
        places.append(place)
    n = len(items)
    lengths = [np.fromiter(map(len, c), np.uint8, n).tobytes() for c in cut]
    head = [np.int64(n).tobytes(), *[np.array(x, np.uint8).tobytes() for x in shared], *lengths, np.array(keys, np.int64).tobytes(), np.array(places, np.int64).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([*head, *cut[0], *cut[1]]))


def decode_run(packed: bytes):
    blob = zstandard.ZstdDecompressor().decompress(packed)
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    lcp, left_lcp, cut, left_cut = (np.frombuffer(blob, np.uint8, n, 8 + i * n) for i in range(4))
    keys, places = (np.frombuffer(blob, np.int64, n, 8 + 4 * n + i * 8 * n) for i in range(2))
    at = 8 + 20 * n
    before = at + int(cut.sum(dtype=np.int64))
    last = left = b""
    for i in range(n):
        c, m = int(cut[i]), int(left_cut[i])
        last = last[: lcp[i]] + blob[at : at + c]
        left = left[: left_lcp[i]] + blob[before : before + m]
        yield last, int(lcp[i]), (left, int(keys[i]), int(places[i]))
        at, before = at + c, before + m


def _shared_left(lefts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(order of the left sides, bytes each shares with the one before it in that order)."""
    order = sorted(range(len(lefts)), key=lefts.__getitem__)
    size = np.array([len(x) for x in lefts], np.int64)[order]
    rows = np.zeros((len(lefts), _SPAN), np.uint8)
    for i, k in enumerate(order):
        rows[i, : size[i]] = np.frombuffer(lefts[k], np.uint8)
    shared = np.zeros(len(lefts), np.int64)
    if len(lefts) > 1:
        differs = rows[1:] != rows[:-1]
        first = np.where(differs.any(axis=1), differs.argmax(axis=1), _SPAN)
        shared[1:] = np.minimum(first, np.minimum(size[1:], size[:-1]))
    return np.array(order, np.int64), shared


def repeated(suffixes: list[int], shared: list[int], lefts: list[bytes]) -> np.ndarray:
    """hits[i, l]: whether the window with l bytes left of the anchor of member i is another member's as well.

    Members are different (suffix, left side) in the order of their suffixes: ``suffixes`` has their lengths, ``shared`` the
    prefix each shares with the one before. Suffixes agree in r bytes if all shared prefixes between them are r or more, so
    counting the smaller ones gives each length's classes; left sides likewise in their own order.
    """
    n = len(suffixes)
    r_len, l_len, lcp = np.array(suffixes, np.int64), np.array([len(x) for x in lefts], np.int64), np.array(shared, np.int64)
    order, left_lcp = _shared_left(lefts)
    hits = np.zeros((n, _SPAN + 1), bool)
    lc = np.empty(n, np.int64)
    for l in range(_SPAN, -1, -1):
        fits = np.flatnonzero((l_len >= l) & (r_len >= LENGTH - l))
        if len(fits) < 2:
            continue
        lc[order] = np.cumsum(left_lcp < l) if l else 0
        window = (np.cumsum(lcp < LENGTH - l) * (n + 1) + lc)[fits]
        by = np.argsort(window, kind="stable")
        same = window[by[1:]] == window[by[:-1]]
        twice = np.zeros(len(fits), bool)
        twice[by[1:]] |= same
        twice[by[:-1]] |= same
        hits[fits[twice], l] = True
    return hits


def runs_of(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first l, l after the last) of the runs of hits in each row."""
    mask = np.zeros((len(hits), _SPAN + 3), np.int8)
    mask[:, 1:-1] = hits
    edge = np.diff(mask, axis=1)
    rows, first = np.nonzero(edge == 1)
    _, after = np.nonzero(edge == -1)
    return rows, first, after


_ANCHOR = np.dtype([("gram", "<u8"), ("key", "<i8"), ("place", "<i8")])


def _bucket_rows(values: np.ndarray, bits: int):
    bucket = (values["gram"] >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)
    order = np.argsort(bucket, kind="stable")
    values, bucket = values[order], bucket[order]
    ids, first = np.unique(bucket, return_index=True)
    return [(int(k), values[a:z]) for k, a, z in zip(ids, first.tolist(), [*first[1:].tolist(), len(values)])]


def _find_anchors(bits: int):
    def run(batches):
        common.lean()
        for b in batches:
            made = []
            for key, text in zip(b.column(0).to_pylist(), common.texts(b.column(1))):
                at, grams = anchors(text)
                if len(at):
                    x = np.empty(len(at), _ANCHOR)
                    x["gram"], x["key"], x["place"] = grams, key, at
                    made.append(x)
            if made:
                rows = _bucket_rows(np.concatenate(made), bits)
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1].tobytes() for r in rows], pa.binary())], ["bucket", "anchors"])

    return run


def _meet_anchors(group: pa.Table) -> pa.Table:
    """Of the anchors of a bucket whose gram's hash occurs again: one row of each place, kind 1 (stop is the hash); rows of equal
    keys are equal throughout, so a place that occurs twice is repeated with all around it, kind 0."""
    common.lean()
    x = np.concatenate([np.frombuffer(v, _ANCHOR) for v in group.column("anchors").to_pylist()])
    x = x[np.lexsort((x["place"], x["key"], x["gram"]))]
    new_gram = np.concatenate([[True], x["gram"][1:] != x["gram"][:-1]])
    new_place = new_gram | np.concatenate([[True], (x["key"][1:] != x["key"][:-1]) | (x["place"][1:] != x["place"][:-1])])
    gram_no, place_no = np.cumsum(new_gram) - 1, np.cumsum(new_place) - 1
    again = np.bincount(gram_no)[gram_no] > 1
    copies = x[new_place & (np.bincount(place_no)[place_no] > 1)]
    edge = x[new_place & again]
    start, stop = np.maximum(copies["place"] - _SPAN, 0), copies["place"] + LENGTH  # may lie behind the text's end
    cols = [np.concatenate([a, b]) for a, b in ((copies["key"], edge["key"]), (np.zeros(len(copies), np.int64), np.ones(len(edge), np.int64)), (start, edge["place"]), (stop, edge["gram"].view(np.int64)))]
    return pa.table({"key": cols[0], "kind": cols[1], "start": cols[2], "stop": cols[3]})


def _sort_suffixes(bits: int):
    def run(batches):
        common.lean()
        held: dict[int, list] = {}

        def flush():
            for k, items in held.items():
                items.sort()
                yield k, front_code(items)
            held.clear()

        n = 0
        for b in batches:
            for key, text, places, grams in zip(b.column(0).to_pylist(), common.texts(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist()):
                for p, g in zip(places, grams):
                    k = (g & (1 << 64) - 1) >> (64 - bits) if bits else 0
                    held.setdefault(k, []).append((text[p : p + LENGTH], text[max(0, p - _SPAN) : p][::-1], key, p))
                n += len(places)
            if n >= SUFFIXES:
                rows, n = list(flush()), 0
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "run"])
        rows = list(flush())
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "run"])

    return run


def _ranges(members: dict) -> list[np.ndarray]:
    """[keys, starts, stops] of the repeated ranges around the members of whole groups: (suffix number, left side) -> [size,
    shared prefix, keys, places] in merged order."""
    rows = list(members.values())
    lefts = [left for _, left in members]
    hits = repeated([r[0] for r in rows], [r[1] for r in rows], lefts)
    for i, r in enumerate(rows):
        if len(r[2]) > 1:  # the same bytes on both sides at several places
            hits[i, max(0, LENGTH - r[0]) : len(lefts[i]) + 1] = True
    row, first, after = runs_of(hits)
    keys = [np.array(rows[i][2], np.int64) for i in row.tolist()]
    places = [np.array(rows[i][3], np.int64) for i in row.tolist()]
    return [np.concatenate(c) if row.size else np.zeros(0, np.int64) for c in (keys, [p - int(z) + 1 for p, z in zip(places, after)], [p - int(f) + LENGTH for p, f in zip(places, first)])]


def _merge_suffixes(group: pa.Table) -> pa.Table:
    common.lean()
    out, members, number, last = [], {}, 0, b""
    for suffix, shared, (left, key, place) in PrefixLoserTree([decode_run(r) for r in group.column("run").to_pylist()]):
        if not (shared == len(suffix) == len(last)):  # another suffix
            number += 1
            if shared < GRAM and len(members) >= 2_000:  # and another gram: no window of it is here
                out.append(_ranges(members))
                members = {}
            common_bytes = shared
        else:
            common_bytes = len(suffix)
        last = suffix
        if (seen := members.get((number, left))) is not None:
            seen[2].append(key)
            seen[3].append(place)
        else:
            members[number, left] = [len(suffix), common_bytes, [key], [place]]
    if members:
        out.append(_ranges(members))
    cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
    return pa.table({"key": cols[0], "start": cols[1], "stop": cols[2]})


def unite(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union; runs that touch are one."""
    out: list[list[int]] = []
    for a, z in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, id, text): rows with equal keys are equal in id and text, so they share their ranges."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.xxhash64(F.col(id_col), text).alias("key"), F.col(id_col).alias("id"), text.alias("text"))


def _bits(n: int, most: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1, n) / most))))


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, start, stop): byte ranges of the rows (by ``_keyed``), stops to be cut at the text's end, whose union is every byte of a LENGTH-byte string that also starts elsewhere."""
    spark = docs.sparkSession
    common.small_batches(spark)
    rows = _keyed(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = rows.select("key", "text").mapInArrow(_find_anchors(_bits(size * 2 // (_SPAN + 2), BUCKET)), "bucket long, anchors binary")
    met = common.stash(found.groupBy("bucket").applyInArrow(_meet_anchors, "key long, kind long, start long, stop long"), "anchors")
    common.free_shuffles(spark)
    whole = met.where("kind = 0").select("key", "start", "stop")
    edges = met.where("kind = 1").select("key", F.col("start").alias("place"), F.col("stop").alias("gram"))
    n = edges.count()
    lists = edges.distinct().groupBy("key").agg(F.collect_list(F.struct("place", "gram")).alias("at")).select(F.col("key").alias("k"), "at.place", "at.gram")
    # of rows that are equal throughout, one shows its suffixes: their copies' ranges are in ``whole``
    texts = rows.select("key", "text").join(lists, F.col("key") == F.col("k")).select("key", "text", "place", "gram")
    common.small_batches(spark)
    runs = texts.mapInArrow(_sort_suffixes(_bits(n, SUFFIXES)), "bucket long, run binary")
    merged = common.stash(runs.groupBy("bucket").applyInArrow(_merge_suffixes, "key long, start long, stop long"), "merged")
    common.free_shuffles(spark)
    return whole.unionAll(merged)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept binary, spans array<struct<start, stop>>): one row per row of ``docs``.

    Null texts are empty; texts of fewer than LENGTH bytes lose nothing. Matches lie within documents, overlap freely and may
    be in the same document; equal rows are copies of each other. Kept bytes may cut a character in two. Null ids are kept;
    other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ranges = repeated_ranges(docs, id_col, text_col)
    per = ranges.groupBy(F.col("key").alias("k")).agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    joined = _keyed(docs, id_col, text_col).join(per, F.col("key") == F.col("k"), "left")
    flat = joined.select("id", "text", F.col("ranges.start").alias("starts"), F.col("ranges.stop").alias("stops"))
    common.small_batches(spark)
    kind = flat.schema["id"].dataType.simpleString()
    span_kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        for b in batches:
            out = []
            for text, starts, stops in zip(common.texts(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist()):
                spans = unite([(a, min(z, len(text))) for a, z in zip(starts or [], stops or [])])
                cuts = [0, *(x for s in spans for x in s), len(text)]
                kept = b"".join(text[a:z] for a, z in zip(cuts[::2], cuts[1::2]))
                out.append((len(text), len(text) - len(kept), len(spans), kept, [{"start": a, "stop": z} for a, z in spans]))
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int64(), pa.int64(), pa.binary(), span_kind])]], ["id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    return flat.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:bigint,stop:bigint>>")


def op4_suffixes(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(common.table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
