"""Gradient boosting of logistic trees by distributed histograms.

Rows stay where they are, as bytes of bin numbers in a written table. A level of all groups' trees is one aggregate: a task applies
the trees so far to its rows and adds up gradients and Hessians by (group, depth, node, feature, bin). Only these sums reach the
driver, and their number hangs on groups, depths, nodes, features and bins alone. Sums are whole numbers of 1e-9, so that trees do
not depend on the partitions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import drop, stash
from .ladders import deployable

UNIT = 1e9
#: After so many rounds rows are written anew with their scores, so that a task never applies more trees than that.
CARRY = 25


@dataclass
class Tree:
    """A binary tree as a heap: the children of node i are 2i + 1 (bin <= cut) and 2i + 2."""

    depth: int
    feature: np.ndarray = field(init=False)
    cut: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)

    def __post_init__(self):
        n = 2 ** (self.depth + 1) - 1
        self.feature, self.cut, self.value = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n)

    def node(self, bins: np.ndarray) -> np.ndarray:
        """The leaf that each row reaches so far."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(self.depth):
            f = self.feature[at]
            at = np.where(f >= 0, 2 * at + 1 + (bins[rows, np.maximum(f, 0)] > self.cut[at]), at)
        return at


def whole(x: np.ndarray) -> np.ndarray:
    return np.floor(x * UNIT + 0.5)


def edges(train: DataFrame, group: str, cols: list[str], bins: int, digits: int = 3) -> DataFrame:
    """(group, feature, edge): quantiles of each group's values, to ``digits`` digits: the least value with k / bins of the rows at
    or below it. Values are counted before they are ordered, so no task orders rows."""
    v = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), (F.floor(F.col(c).cast("double") * 10.0**digits + 0.5) / 10.0**digits).alias("v")) for i, c in enumerate(cols)]))
    n = train.select(group, v.alias("x")).select(group, "x.*").groupBy(group, "feature", "v").agg(F.count("*").alias("c"))
    w = Window.partitionBy(group, "feature")
    x = n.withColumn("upto", F.sum("c").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("c").over(w))
    k = F.expr(f"least({bins - 1}, upto * {bins} div all) >= (upto - c) * {bins} div all + 1")
    return x.where(k).select(group, "feature", F.col("v").alias("edge"))


def binned(rows: DataFrame, group: str, cols: list[str], label: str, cuts: dict, keep: list[str]) -> DataFrame:
    """(group, train, y, bins, keep...): a byte per feature, the number of the group's edges below the value; null is the lowest."""

    def run(batches):
        for b in batches:
            g, out = b.column(group).to_numpy(zero_copy_only=False), np.zeros((b.num_rows, len(cols)), np.uint8)
            for k in np.unique(g):
                at = np.flatnonzero(g == k)
                for i, c in enumerate(cols):
                    x = b.column(c).to_numpy(zero_copy_only=False)[at].astype(np.float64)
                    out[at, i] = np.where(np.isnan(x), 0, np.searchsorted(cuts.get((int(k), i), np.zeros(0)), x, "left"))
            bins = pa.array([r.tobytes() for r in out], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(group), b.column("train"), b.column("y"), bins, *[b.column(c) for c in keep]], [group, "train", "y", "bins", *keep])

    types = dict(rows.dtypes)
    src = rows.select(group, "train", F.col(label).cast("int").alias("y"), *keep, *[c for c in cols if c not in keep])
    return src.mapInArrow(run, f"{group} {types[group]}, train boolean, y int, bins binary" + "".join(f", {c} {types[c]}" for c in keep))


def _bins(column: pa.Array, n_features: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), n_features).astype(np.int64)


def best_split(n: np.ndarray, g: np.ndarray, h: np.ndarray, min_leaf: int, l2: float) -> tuple[float, int, int]:
    """(gain, feature, cut) of the best split of a node by its histograms (features x bins); ties to the first feature and cut."""
    n_l, g_l, h_l = (np.cumsum(x, axis=1)[:, :-1] for x in (n, g, h))
    n_r, g_r, h_r = n[0].sum() - n_l, g[0].sum() - g_l, h[0].sum() - h_l
    score = lambda g, h: g * g / (h + l2)
    gain = np.where((n_l >= min_leaf) & (n_r >= min_leaf), score(g_l, h_l) + score(g_r, h_r) - score(g[0].sum(), h[0].sum()), -np.inf)
    at = int(np.argmax(np.round(gain, 9)))
    f, cut = divmod(at, gain.shape[1])
    return float(gain[f, cut]), f, cut


@dataclass
class Boosted:
    """The fitted trees: ``trees[group, depth]`` in order, and each group's starting score."""

    group: str
    cols: list[str]
    base: dict
    cuts: dict
    rate: float
    trees: dict

    def scores(self, k: int, depth: int, bins: np.ndarray, counts: list[int]) -> dict[int, np.ndarray]:
        """Raw scores after each number of trees in ``counts``."""
        raw, out = np.full(len(bins), self.base[k]), {}
        for i, tree in enumerate(self.trees[k, depth][: max(counts)], 1):
            raw = raw + tree.value[tree.node(bins)]
            if i in counts:
                out[i] = raw
        return out


def fit(table: DataFrame, group: str, cols: list[str], cuts: dict, bins: int, rounds: int, depths: list[int], rate: float = 0.05, min_leaf: int = 20, l2: float = 1.0) -> Boosted:
    """Trees of every group and depth from the rows of ``table`` (from ``binned``) with ``train``.

    A round takes as many jobs as the deepest tree has levels, however many groups there are. A node splits where the gain is
    positive and both sides have ``min_leaf`` rows; a leaf's value is -rate G / (H + l2).
    """
    sums = table.where("train").groupBy(group).agg(F.sum("y").alias("s"), F.count("*").alias("n")).collect()  # a row per group
    base = {r[group]: float(np.log(max(r.s, 0.5) / max(r.n - r.s, 0.5))) for r in sums}
    model, n_features = Boosted(group, cols, base, cuts, rate, {(k, d): [] for k in base for d in depths}), len(cols)
    started = F.array(*[F.lit(None).cast("double") for _ in depths])
    rows, first = stash(table.where("train").select(group, "y", "bins", started.alias("raw")), "boosting"), 0
    for r in range(rounds):
        growing = {(k, d): Tree(d) for k in base for d in depths}
        for level in range(max(depths)):
            recent = {key: (t[first:], growing[key]) for key, t in model.trees.items()}

            def histogram(batches, recent=recent, level=level):
                total: dict = {}
                for b in batches:
                    g, y, x = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(), _bins(b.column(2), n_features)
                    held = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(g), len(depths))
                    for k in np.unique(g):
                        at = np.flatnonzero(g == k)
                        for j, d in enumerate(depths):
                            if level >= d:
                                continue
                            done, tree = recent[int(k), d]
                            raw = np.where(np.isnan(held[at, j]), base[int(k)], held[at, j])
                            for t in done:
                                raw = raw + t.value[t.node(x[at])]
                            p = 1 / (1 + np.exp(-raw))
                            local = tree.node(x[at]) - (2**level - 1)
                            open_ = local >= 0  # rows whose node closed above this level stay there
                            if not open_.any():
                                continue
                            h = total.setdefault((int(k), d), np.zeros((3, 2**level, n_features, bins)))
                            for f in range(n_features):
                                place = local[open_] * bins + x[at][open_, f]
                                for s, v in enumerate((np.ones(len(at)), whole(p - y[at]), whole(p * (1 - p)))):
                                    h[s, :, f] += np.bincount(place, v[open_], 2**level * bins).reshape(2**level, bins)
                for (k, d), h in total.items():
                    node, f, b_ = np.nonzero(h[0])
                    col = lambda v, t=pa.int32(): pa.array(np.asarray(v), t)
                    yield pa.RecordBatch.from_arrays([col(np.full(len(node), k)), col(np.full(len(node), d)), col(node), col(f), col(b_), *[pa.array(h[s, node, f, b_].astype(np.int64)) for s in range(3)]], ["k", "d", "node", "feature", "bin", "n", "g", "h"])

            got = rows.mapInArrow(histogram, "k int, d int, node int, feature int, bin int, n long, g long, h long").groupBy("k", "d", "node", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow().to_pandas()
            for (k, d), own in got.groupby(["k", "d"]):
                tree, h = growing[int(k), int(d)], np.zeros((3, 2**level, n_features, bins))
                h[:, own.node, own.feature, own.bin] = own[["n", "g", "h"]].to_numpy(np.float64).T
                h[1:] /= UNIT
                for node in np.flatnonzero(h[0].sum(axis=(1, 2))):
                    at, (n, g, hs) = 2**level - 1 + node, h[:, node]
                    if level == 0:
                        tree.value[at] = -rate * g[0].sum() / (hs[0].sum() + l2)
                    gain, f, cut = best_split(n, g, hs, min_leaf, l2)
                    if gain > 1e-9:
                        tree.feature[at], tree.cut[at] = f, cut
                        for child, part in ((2 * at + 1, np.s_[: cut + 1]), (2 * at + 2, np.s_[cut + 1 :])):
                            tree.value[child] = -rate * g[f, part].sum() / (hs[f, part].sum() + l2)
        for key, tree in growing.items():
            model.trees[key].append(tree)
        if (r + 1) % CARRY == 0 and r + 1 < rounds:
            rows, first = _carried(rows, model, group, depths, first, n_features), r + 1
    drop(rows)
    return model


def _carried(rows: DataFrame, model: Boosted, group: str, depths: list[int], first: int, n_features: int) -> DataFrame:
    """The rows with the scores of all trees so far."""
    recent = {key: t[first:] for key, t in model.trees.items()}

    def run(batches):
        for b in batches:
            g, x = b.column(0).to_numpy(zero_copy_only=False), _bins(b.column(2), n_features)
            held = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(g), len(depths)).copy()
            for k in np.unique(g):
                at = np.flatnonzero(g == k)
                for j, d in enumerate(depths):
                    raw = np.where(np.isnan(held[at, j]), model.base[int(k)], held[at, j])
                    for t in recent[int(k), d]:
                        raw = raw + t.value[t.node(x[at])]
                    held[at, j] = raw
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(list(held), pa.list_(pa.float64()))], [group, "y", "bins", "raw"])

    out = stash(rows.mapInArrow(run, rows.schema), "boosting")
    drop(rows)
    return out


def predict(table: DataFrame, model: Boosted, counts: list[int], keep: list[str]) -> DataFrame:
    """(group, depth, trees, y, p, keep...) of the rows of ``table`` without ``train``, for every depth and number of trees."""
    depths = sorted({d for _, d in model.trees})

    def run(batches):
        for b in batches:
            g, x = b.column(model.group).to_numpy(zero_copy_only=False), _bins(b.column("bins"), len(model.cols))
            for k in np.unique(g):
                if int(k) not in model.base:
                    continue
                at = np.flatnonzero(g == k)
                for d in depths:
                    for n, raw in model.scores(int(k), d, x[at], counts).items():
                        same = lambda v: pa.array(np.full(len(at), v, np.int32))
                        yield pa.RecordBatch.from_arrays([b.column(model.group).take(pa.array(at)), same(d), same(n), b.column("y").take(pa.array(at)), pa.array(1 / (1 + np.exp(-raw))), *[b.column(c).take(pa.array(at)) for c in keep]], [model.group, "depth", "trees", "y", "p", *keep])

    types = dict(table.dtypes)
    return table.where("not train").select(model.group, "y", "bins", *keep).mapInArrow(run, f"{model.group} {types[model.group]}, depth int, trees int, y int, p double" + "".join(f", {c} {types[c]}" for c in keep))


def boost(rows: DataFrame, group: str, cols: list[str], label: str, keep: list[str], bins: int = 32, counts: tuple[int, ...] = (50, 100, 200), depths: tuple[int, ...] = (2, 3), **options) -> DataFrame:
    """Predictions of every group's rows without ``train`` by trees fitted on those with it: see ``predict``.

    ``group`` is a whole number. Values are cut at quantiles of the group's own training rows. Nulls count as lowest. A group
    without training rows has no predictions; an empty table gives an empty result.
    """
    deployable(cols)
    train = rows.where("train")
    cuts: dict = {}
    for r in edges(train, group, cols, bins).orderBy(group, "feature", "edge").collect():  # bins a feature and group
        cuts.setdefault((r[group], r.feature), []).append(r.edge)
    cuts = {k: np.array(v) for k, v in cuts.items()}
    table = stash(binned(rows, group, cols, label, cuts, keep), "binned")
    model = fit(table, group, cols, cuts, bins, max(counts), sorted(depths), **options)
    return predict(table, model, sorted(counts), keep)
