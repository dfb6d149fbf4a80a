"""Best-fit packing of documents into sequences, by hierarchical residual packing.

Every partition packs its own pieces by best fit and emits the sequences that came out nearly full. What lies in underfull
ones goes up a tree as items again: each level has fewer nodes, to which the groups below deal their pieces by length, and
which pack by best fit in turn, until the last level emits all that is left. Only residues move.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAX_TOKENS = 1024
END = 2
#: A sequence with so many free places or fewer is nearly full.
SLACK = 8
#: A level has a node for so many groups of the level below.
FANOUT = 8
#: Pieces of a node, about, at most. A level that would have larger nodes has more of them, and the tree ends where levels get
#: no narrower; as all nodes of a level have the same mix of lengths, little is lost by that.
NODE = 1_000_000
#: A group deals its pieces to so many nodes, at most.
SPREAD = 64
CACHE = 1_000_000
_NULL = np.iinfo(np.int64).min
SCHEMA = "grp int, sequence_id long, offset long, doc_id long, piece int, start long, length long, ids_crc32 long, loose binary"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_marks() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes, by a byte-level BPE file of ``tokenizers``.

    Text is cut by the file's pattern, and the model's ids of each part are cached, for most parts of a text occur again. A text
    that holds one of the file's added tokens goes to the tokenizer as a whole, for these have ids of their own.
    A worker process keeps its encoder from task to task.
    """

    _kept: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = str.maketrans({chr(b): c for b, c in _byte_marks().items()})
        self.cut = regex.compile(public_tokenizers.PATTERN).findall
        self.cache: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        marked = part.encode().decode("latin-1").translate(self.marks)
        return array("I", [t.id for t in self.model.tokenize(marked)]).tobytes()

    def encode(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts, cache = self.cut(text), self.cache
        found = [cache.get(p) for p in parts]
        if None in found:
            if len(cache) > CACHE:
                cache.clear()
            for i, raw in enumerate(found):
                if raw is None:
                    p = parts[i]
                    if (raw := cache.get(p)) is None:
                        raw = cache[p] = self._part(p)
                    found[i] = raw
        return b"".join(found)


def cut_points(n: int, most: int = MAX_TOKENS) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens: pieces of ``most``, the first one maybe shorter."""
    first = n - (-(-n // most) - 1) * most
    return [(0, first), *((s, most) for s in range(first, n, most))]


def best_fit(sizes: np.ndarray, most: int = MAX_TOKENS) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best-fit decreasing: (bin, offset) of every item and the bins' free places. O(1) an item: bins lie in stacks by free places."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    free: list[int] = []
    stacks: list[list[int]] = [[] for _ in range(most + 1)]
    some = 0  # bit c: a bin with c free places
    for i, s in zip(order.tolist(), sizes[order].tolist()):
        fits = some >> s
        if fits:
            c = s + (fits & -fits).bit_length() - 1
            b = stacks[c].pop()
            if not stacks[c]:
                some ^= 1 << c
        else:
            c, b = most, len(free)
            free.append(most)
        bins[i], offsets[i] = b, most - c
        free[b] = c - s
        stacks[c - s].append(b)
        some |= 1 << (c - s)
    return bins, offsets, free


def pack(pieces: np.ndarray, final: bool, base: int, most: int = MAX_TOKENS, slack: int = SLACK, carry: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Packs ``pieces`` (rows of doc_id, piece, start, length, crc); (rows of sequence_id, offset, *piece; the rows that go up).

    All pieces of underfull bins go up, or the emptiest bins' first ``carry`` pieces.
    """
    pieces = pieces[np.lexsort((pieces[:, 1], pieces[:, 0]))]
    bins, offsets, free = best_fit(pieces[:, 3], most)
    spare = np.array(free, np.int64)
    loose = np.zeros(len(spare), bool)
    if not final and len(spare):
        count = np.bincount(bins, minlength=len(spare))
        order = np.argsort(-spare, kind="stable")
        order = order[spare[order] > slack]
        loose[order if carry is None else order[np.cumsum(count[order]) <= carry]] = True
    up = loose[bins] if len(spare) else np.zeros(0, bool)
    done = np.column_stack([bins[~up] + base, offsets[~up], pieces[~up]])
    return done, pieces[up]


def _batch(grp: int, done: np.ndarray, up: np.ndarray) -> pa.RecordBatch:
    """Rows of placed pieces and, if any piece goes up, one row that holds all of these."""
    n, tail = len(done), 1 if len(up) else 0
    rows = np.vstack([done, np.zeros((tail, done.shape[1]), np.int64)])
    blank = np.arange(n + tail) >= n

    def ints(k, kind, mask=blank):
        return pa.array(rows[:, k], pa.int64(), mask=mask).cast(kind)

    ids = ints(2, pa.int64(), blank | (rows[:, 2] == _NULL))
    loose = pa.array([None] * n + [np.ascontiguousarray(up, np.int64).tobytes()] * tail, pa.binary())
    cols = [pa.array([grp] * (n + tail), pa.int32()), ints(0, pa.int64()), ints(1, pa.int64()), ids, ints(3, pa.int32()), ints(4, pa.int64()), ints(5, pa.int64()), ints(6, pa.int64()), loose]
    return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in SCHEMA.split(", ")])


def deal(grp: int, pieces: np.ndarray, nodes: int, spread: int = SPREAD) -> list[tuple[int, np.ndarray]]:
    """(node, pieces): a group's pieces, dealt by turns in order of length to nodes that lie all over the level."""
    n = min(nodes, spread)
    ranked = pieces[np.argsort(-pieces[:, 3], kind="stable")]
    return [((grp + i * (nodes // n)) % nodes, ranked[i::n]) for i in range(n) if i < len(ranked)]


def _deal(nodes: int):
    def run(batches):
        for b in batches:
            for grp, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parts = deal(grp, np.frombuffer(raw, np.int64).reshape(-1, 5), nodes)
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([x.tobytes() for _, x in parts], pa.binary())], ["node", "loose"])

    return run


def _merge(depth: int, final: bool, most: int, slack: int):
    """A node of the tree: packs what its groups sent up."""

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        grp = key[0].as_py()
        items = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 5) for x in group.column("loose").to_pylist()])
        return pa.Table.from_batches([_batch(grp, *pack(items, final, depth << 56 | grp << 28, most, slack))])

    return merge


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, most: int = MAX_TOKENS, end: int = END, slack: int = SLACK, fanout: int = FANOUT, node: int = NODE) -> DataFrame:
    """(sequence_id, offset, doc_id, piece, start, length, ids_crc32): one row per piece of each document.

    A document is its text's ids and the end id; documents of more than ``most`` tokens are cut. A null or empty text is the
    end id alone. Null ids stay null, repeated rows are packed each, other columns are not read; an empty table gives no
    rows. Ties go by id and piece, so a partition's packing does not depend on the order of its rows; sequence ids depend on
    how the input is split into partitions.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    path = tokenizer or default_tokenizer()

    def local(batches):
        encoder, rows, grp = Encoder.of(path), [], TaskContext.get().partitionId()
        last = np.array([end], "<u4").tobytes()
        for b in batches:
            seen: dict[str, list] = {}
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                doc, text = _NULL if doc is None else doc, text or ""
                if text not in seen:
                    raw = encoder.encode(text) + last
                    seen[text] = [(p, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])) for p, (s, n) in enumerate(cut_points(len(raw) // 4, most))]
                rows += [(doc, *x) for x in seen[text]]
        if rows:
            all_rows = np.array(rows, np.int64)
            done, up = pack(all_rows, False, grp << 28, most, slack)
            for i in range(0, max(1, len(done)), 50_000):
                yield _batch(grp, done[i : i + 50_000], up if i == 0 else up[:0])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    level = common.stash(rows.mapInArrow(local, SCHEMA), "level0")
    levels, depth = [level], 0
    groups = level.agg(F.max("grp") + 1).first()[0]
    while groups is not None:
        depth += 1
        up = level.where("loose is not null").select("grp", "loose")
        pieces = (up.agg(F.sum(F.octet_length("loose").cast("long"))).first()[0] or 0) // 40
        nodes = max(-(-groups // fanout), -(-pieces // node))
        final = nodes == 1 or nodes >= groups
        dealt = up.mapInArrow(_deal(nodes), "node int, loose binary")
        level = common.stash(dealt.groupBy("node").applyInArrow(_merge(depth, final, most, slack), SCHEMA), f"level{depth}")
        levels.append(level)
        groups = None if final else nodes
    out = levels[0]
    for x in levels[1:]:
        out = out.unionAll(x)
    return out.where("loose is null").drop("loose", "grp")


def sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, **options) -> DataFrame:
    """(sequence_id, ids array<int>, doc_ids array<long>): the packed sequences themselves. Ids of ``docs`` must be unique."""
    packed = pack_documents(docs, id_col, text_col, tokenizer, **options)
    path, end = tokenizer or default_tokenizer(), options.get("end", END)

    def ids(batches):
        encoder = Encoder.of(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[*np.frombuffer(encoder.encode(t or ""), "<u4").tolist(), end] for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    tokens = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(ids, "doc_id long, ids array<int>")
    parts = packed.join(tokens, "doc_id").select("sequence_id", F.struct("offset", "doc_id", F.expr("slice(ids, cast(start as int) + 1, cast(length as int))").alias("ids")).alias("part"))
    lists = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return lists.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))


def op1_packing(spark, sf_dir: str) -> DataFrame:
    out = pack_documents(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
