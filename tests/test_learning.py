"""Boosting against a plain grower, sparse and robust fits against numpy, calibration by hand, linkage cases, derived tables."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skirmish.operators import boosting as T
from skirmish.operators import calibration as K
from skirmish.operators import history as H
from skirmish.operators import inference as I
from skirmish.operators import ladders as L
from skirmish.operators import linkage as N
from skirmish.operators import sparse as S
from skirmish.plans import registry
from skirmish.sources import adapter as A
from skirmish.sources import store


def grow(x, y, depth, rounds, cuts, rate=0.05, min_leaf=5, l2=1.0):
    """A plain grower: recursive, over sorted values, one tree after the other; returns the raw score of any row."""
    base = math.log(y.sum() / (len(y) - y.sum()))
    raw, trees = np.full(len(y), base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = np.floor((p - y) * 1e9 + 0.5) / 1e9, np.floor(p * (1 - p) * 1e9 + 0.5) / 1e9

        def node(rows, level):
            value = -rate * g[rows].sum() / (h[rows].sum() + l2)
            best = (0.0,)
            if level < depth:
                for f in range(x.shape[1]):
                    for cut in cuts[f]:
                        left = rows[x[rows, f] <= cut]
                        right = rows[x[rows, f] > cut]
                        if len(left) < min_leaf or len(right) < min_leaf:
                            continue
                        part = lambda r: g[r].sum() ** 2 / (h[r].sum() + l2)
                        gain = part(left) + part(right) - part(rows)
                        if gain > best[0] + 1e-9:
                            best = (gain, f, cut, left, right)
            if len(best) == 1:
                return value
            return best[1], best[2], node(best[3], level + 1), node(best[4], level + 1)

        trees.append(node(np.arange(len(y)), 0))
        raw = raw + np.array([walk(trees[-1], r) for r in x])
    return lambda r: base + sum(walk(t, r) for t in trees)


def walk(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def boost_rows(spark, n=240):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(n, 2)), 2)
    y = (rng.random(n) < 1 / (1 + np.exp(-2 * np.sign(x[:, 0]) * (x[:, 1] > 0.3)))).astype(int)
    fold = np.arange(n) % 2 + 1
    data = [(int(i), int(f), bool(i % 5), float(a), float(b), int(v)) for i, (f, (a, b), v) in enumerate(zip(fold, x, y))]
    return spark.createDataFrame(data, "series_id long, fold int, train boolean, u double, v double, y int"), data


def test_boosting_equals_a_plain_grower(spark, monkeypatch):
    monkeypatch.setattr(T, "CARRY", 2)
    df, data = boost_rows(spark)
    got = {(r.fold, r.depth, r.trees, r.series_id): r.p for r in T.boost(df.repartition(3), "fold", ["u", "v"], "y", ["series_id"], 8, (2, 5), (2, 3), min_leaf=5).collect()}
    for fold in (1, 2):
        train = [r for r in data if r[1] == fold and r[2]]
        x, y = np.array([r[3:5] for r in train]), np.array([r[5] for r in train])
        cuts = [sorted({sorted(x[:, f])[math.ceil(k * len(x) / 8) - 1] for k in range(1, 8)}) for f in range(2)]
        for depth in (2, 3):
            for rounds in (2, 5):
                score = grow(x, y, depth, rounds, cuts)
                for r in data:
                    if r[1] == fold and not r[2]:
                        assert got[fold, depth, rounds, r[0]] == pytest.approx(1 / (1 + math.exp(-score(r[3:5]))), abs=1e-9)


def test_boosting_does_not_depend_on_partitions_and_takes_empty_tables(spark):
    df, _ = boost_rows(spark, 120)
    run = lambda d: sorted((r.fold, r.depth, r.trees, r.series_id, r.p) for r in T.boost(d, "fold", ["u", "v"], "y", ["series_id"], 8, (3,), (2,), min_leaf=5).collect())
    assert run(df.repartition(1)) == run(df.repartition(5))
    assert run(df.limit(0)) == []


def test_models_refuse_what_is_not_known_before(spark):
    df = spark.createDataFrame([(1, 1, True, 0.0, 1)], "series_id long, fold int, train boolean, oracle_rating double, y int")
    with pytest.raises(ValueError, match="oracle_rating"):
        L.ladder(df, {"m": ["oracle_rating"]}, "y")
    with pytest.raises(ValueError, match="oracle_rating"):
        T.boost(df, "fold", ["oracle_rating"], "y", ["series_id"])
    assert L.deployable(["rate"]) == ["rate"]


def test_sparse_steps_equal_dense_ones(spark):
    rng = np.random.default_rng(2)
    rows = [(1, i, [int(a) for a in rng.choice(12, 3, replace=False)], [int(b) for b in rng.choice(12, 3, replace=False)], int(rng.random() < 0.6)) for i in range(60)]
    df = spark.createDataFrame(rows, "g int, row long, pa array<int>, pb array<int>, y int")
    e = S.entries(df, ["g", "row"], "pa", "pb")
    lam = e.select("key").distinct().withColumn("lam", F.lit(2.0))
    got = {r.key: r.w for r in S.fit(e, df.select("g", "row", "y"), "g", "row", lam, 7).collect()}
    x = np.zeros((60, 12))
    for _, i, a, b, _ in rows:
        np.add.at(x[i], a, 1)
        np.add.at(x[i], b, -1)
    y, w = np.array([r[4] for r in rows]), np.zeros(12)
    d = (np.abs(x) * np.abs(x).sum(axis=1)[:, None]).sum(axis=0) / 4 + 2
    losses = []
    for _ in range(7):
        p = 1 / (1 + np.exp(-x @ w))
        losses.append(-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum() + (w**2).sum())
        w = w - (x.T @ (p - y) + 2 * w) / d
    assert losses == sorted(losses, reverse=True)
    assert all(abs(got[f"p{j}"] - w[j]) < 1e-9 for j in range(12) if f"p{j}" in got)


def test_cluster_errors_equal_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 3))
    y = (rng.random(200) < 1 / (1 + np.exp(-x[:, 0]))).astype(int)
    c = np.arange(200) // 4
    df = spark.createDataFrame([(1, int(k), *map(float, r), int(v)) for k, r, v in zip(c, x, y)], "g int, c int, u double, v double, w double, y int")
    got = {r.term: r for r in I.cluster_logit(df.repartition(3), "g", ["u", "v", "w"], "y", "c").collect()}
    z = np.column_stack([np.ones(200), x])
    b = np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ b))
        h = z.T @ (z * (p * (1 - p))[:, None])
        b = b + np.linalg.solve(h, z.T @ (y - p))
    s = np.stack([(z[c == k] * (y - p)[c == k, None]).sum(axis=0) for k in range(50)])
    se = np.sqrt(np.diag(np.linalg.inv(h) @ (s.T @ s) @ np.linalg.inv(h)))
    for i, term in enumerate(["intercept", "u", "v", "w"]):
        r = got[term]
        assert (r.n, r.clusters) == (200, 50) and abs(r.coef - b[i]) < 1e-6 and abs(r.se - se[i]) < 1e-6
        assert abs(r.p_value - math.erfc(abs(b[i] / se[i]) / math.sqrt(2))) < 1e-5


def test_permutation_is_a_permutation_and_a_constant_feature_costs_nothing(spark):
    df = spark.createDataFrame([(1 + i % 2, i, i % 2, 0.1, float(i % 2) * 4 - 2, 0.0) for i in range(101)], "fold int, series_id long, y int, w0 double, u double, v double")
    x = I.hash_order(df, ["fold"], F.md5(F.col("series_id").cast("string")), "series_id", "i", 7).collect()
    for fold in (1, 2):
        own = [r for r in x if r.fold == fold]
        import hashlib

        assert [r.series_id for r in sorted(own, key=lambda r: r.i)] == sorted((r.series_id for r in own), key=lambda s: hashlib.md5(str(s).encode()).hexdigest())
        assert sorted(r.i for r in own) == list(range(1, len(own) + 1))
    r = {(r.fold, r.feature): r.mean_increase for r in I.permutation_importance(df.withColumn("fold", F.lit(1)), "fold", "series_id", "y", "w0", ["u", "v"], 4).collect()}
    again = {(r.fold, r.feature): r.mean_increase for r in I.permutation_importance(df.withColumn("fold", F.lit(1)).repartition(5), "fold", "series_id", "y", "w0", ["u", "v"], 4).collect()}
    assert r == again and r[1, "v"] == 0.0 and r[1, "u"] > 0.5


def test_poisson_bootstrap_is_near_the_plain_one(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(0.1, 1.0, 800)
    u = spark.createDataFrame([(i % 4, i, int(x * 1e9), 1_000_000_000) for i, x in enumerate(v)], "st int, id long, s long, k long")
    s = I.summary(I.poisson_bootstrap(u, F.col("id").cast("string"), "st", 300, "x")).first()
    assert s.draws == 300 and abs(s["mean"] - v.mean()) < 0.01 and abs(s.se - v.std() / 800**0.5) < 0.006 and s.low < s["mean"] < s.high
    assert I.POISSON[:3] == [24109, 48218, 60273] or abs(I.POISSON[0] - 24109) <= 1


def test_cluster_bootstrap_draws_as_many_clusters_as_a_season_has(spark, monkeypatch):
    """Hand draws: seasons of one and two clusters are in every draw, and a draw's mean is over the rows that it holds."""
    import hashlib
    import math

    from skirmish.plans import ladders

    rng = np.random.default_rng(4)
    rows = [("A", 1, 1, 0.9), ("B", 1, 0, 0.7), ("B", 2, 1, 0.6), *[("C", int(t), int(rng.random() < 0.5), float(rng.integers(20, 80)) / 100) for t in rng.integers(0, 5, 30)]]
    monkeypatch.setattr(ladders, "win_predictions", lambda *a: spark.createDataFrame(rows, "season string, t long, y int, p double"))
    sums = {}
    for season, t, y, p in rows:
        c = sums.setdefault(season, {}).setdefault(t, [0, 0])
        c[0] += math.floor((-math.log(p if y else 1 - p) - math.log(2)) * 1e9 + 0.5)
        c[1] += 1
    means = []
    for draw in range(200):
        got = [c[sorted(c)[int(int(hashlib.md5(f"{draw}|{s}|{i}|2".encode()).hexdigest()[:8], 16) / 2**32 * len(c))]] for s, c in sums.items() for i in range(len(c))]
        means.append(sum(g[0] for g in got) / sum(g[1] for g in got) / 1e9)
    r = ladders.m16(spark, "").first()
    assert r.draws == 200
    assert np.allclose([r["mean"], r.se, r.low, r.high], [np.mean(means), np.std(means, ddof=1), *np.quantile(means, [0.025, 0.975])], atol=2e-6)


def test_isotonic_blocks_do_not_depend_on_ranges(spark):
    rng = np.random.default_rng(6)
    p = np.round(rng.random(500), 3)
    y = (rng.random(500) < p * 0.6 + 0.2).astype(int)
    df = spark.createDataFrame([(1, float(a), int(b)) for a, b in zip(p, y)], "g int, p double, y int")
    runs = [sorted((r.lo, r.hi, r.s, r.n) for r in K.isotonic(df, "g", "p", "y", 3, n).collect()) for n in (1, 7, 64)]
    assert runs[0] == runs[1] == runs[2]
    means = [s / n for _, _, s, n in runs[0]]
    assert means == sorted(means) and sum(n for *_, n in runs[0]) == 500
    xs = np.unique(p)
    total = np.array([y[p == x].sum() for x in xs]), np.array([(p == x).sum() for x in xs])
    cum = [np.concatenate([[0], np.cumsum(t)]) for t in total]
    brute = [max(min((cum[0][k] - cum[0][i]) / (cum[1][k] - cum[1][i]) for k in range(j + 1, len(xs) + 1)) for i in range(j + 1)) for j in range(len(xs))]
    fit = [next(s / n for lo, hi, s, n in runs[0] if lo <= x <= hi) for x in xs]
    assert np.allclose(brute, fit)
    assert K.pool([1, 2, 3, 4], [1, 2, 3, 4], [0, 1, 0, 1], [1, 1, 1, 1]) == [[1, 1, 0, 1], [2, 3, 1, 2], [4, 4, 1, 1]]


def test_isotonic_is_linear_between_blocks(spark):
    blocks = spark.createDataFrame([(1, 0.2, 0.4, 1, 4), (1, 0.6, 0.8, 3, 4)], "g int, lo double, hi double, s long, n long")
    rows = spark.createDataFrame([(1, x) for x in (0.1, 0.3, 0.5, 0.7, 0.9)] + [(2, 0.5)], "g int, p double")
    got = {(r.g, r.p): r.f for r in K.apply_isotonic(rows, blocks, "g", "p", "f").collect()}
    assert {k: v and round(v, 9) for k, v in got.items()} == {(1, 0.1): 0.25, (1, 0.3): 0.25, (1, 0.5): 0.5, (1, 0.7): 0.75, (1, 0.9): 0.75, (2, 0.5): None}


def test_penalties_draw_slopes_to_one(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-0.3 * z))).astype(int)
    df = spark.createDataFrame([(5, 1 + i // 200 + 1, i < 200, float(a), int(b)) for i, (a, b) in enumerate(zip(z, y))], "best_of int, fold int, train boolean, z double, y int").withColumn("fold", F.lit(2))
    slopes = K.slope_path(df, "best_of")
    b = {r.candidate: r.beta for r in slopes.collect()}
    assert b["C1"] < b["C2"] < b["C3"] < b["C4"] < 1
    first = K.temporal(df, slopes, "best_of").first()
    assert first.selected == "C4" and first.n == 200


def test_linkage_outcomes(spark):
    five = lambda k: [k * 10 + i for i in range(5)]
    schema = "{} long, team1 string, team2 string, winner string, heroes1 array<int>, heroes2 array<int>"
    games = spark.createDataFrame([(1, "A", "B", "A", five(1), five(2)), (2, "A", "B", "B", five(3), five(4)), (3, "B", "A", None, five(4), five(3)), (4, "C", "D", "C", five(1), five(2)), (5, "C", "D", "D", five(5), five(6)), (6, "A", "C", None, five(5), five(6))], schema.format("game_id"))
    rows = spark.createDataFrame(
        [(10, "B", "A", "A", five(2), five(1)), (11, "A", "B", "B", five(3), five(4)), (12, "C", "D", "D", five(1), five(2)), (13, None, "D", "D", five(1), five(2)), (14, "C", "D", None, five(5), five(6)), (15, "D", "C", "D", five(6), five(5)), (16, "C", "D", "C", five(7), five(8)), (17, "A", "B", "A", five(1)[:4], five(2)), (18, "C", "A", "A", five(6), five(5))], schema.format("row_id")
    )
    got = {r.row_id: r for r in N.link(rows, games).collect()}
    assert {k: r.status for k, r in got.items()} == {10: "UNIQUE_EXACT_MATCH", 11: "MULTIPLE_EXACT_MATCHES", 12: "SOURCE_CONFLICT", 13: "UNRESOLVED_TEAM_IDENTITY", 14: "SOURCE_CONFLICT", 15: "SOURCE_CONFLICT", 16: "NO_MATCH", 17: "NO_MATCH", 18: "UNIQUE_EXACT_MATCH"}
    assert (got[10].game_id, got[10].winner_agreement, got[10].n_f1, got[10].level) == (1, "AGREE", 3, "F2_pair_hero_sides")
    assert (got[18].level, got[18].winner_agreement) == ("F1_team_pair", "DATED_WINNER_MISSING")
    assert got[12].flags == "WINNER_CONTRADICTION" and got[14].flags == "GAME_CLAIMED_BY_MULTIPLE_ROWS" and got[17].flags == "TEAM_HERO_COUNT_NOT_5"
    sure = {r.row_id: r.confidence for r in N.identified(N.link(rows, games), rows, games.select("game_id")).collect()}
    assert sure == {10: "HIGH_UNIQUE_WINNER_AGREES", 18: "MEDIUM_UNIQUE_DATED_WINNER_MISSING"}
    level = {r.level: (r.tested, r.unique_match, r.multiple, r.no_match) for r in N.feasibility(N.keyed(games, "game_id", N.LEVELS), N.keyed(rows, "row_id", N.LEVELS), 9).collect()}
    assert level["F1_team_pair"] == (8, 1, 7, 0) and level["D2_hero_sides"] == (8, 0, 7, 1)


def test_prior_state_excludes_ties_and_crosses_buckets(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, 1, 1), (25, 1, 0), (2, 2, 1), (30, 1, 1)], "t long, k long, w long")
    got = sorted((r.t, r.k, r.n, r.s) for r in H.prior_sums(df, ["k"], "t", {"n": F.lit(1).cast("long"), "s": F.col("w")}, 10).collect())
    assert got == [(1, 1, 0, 0), (1, 1, 0, 0), (2, 1, 2, 1), (2, 2, 0, 0), (25, 1, 3, 2), (30, 1, 4, 2)]


@pytest.mark.parametrize(("name", "most"), [("w03_player_hero_state", 10), ("w04_draft_state", 5), ("j03_canonical_series", 20), ("j07_refresh_diff", 25), ("p10_game_flags", 15)])
def test_plans_read_their_tables_a_few_times(spark, sf, name, most):
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan", plan)) <= most


def test_derived_tables_follow_their_inputs(spark, tmp_path):
    path, made = str(tmp_path / "in.parquet"), []

    def make():
        made.append(1)
        return spark.read.parquet(path).select((F.col("id") * 2).alias("x"))

    spark.range(3).write.parquet(path)
    read = lambda: sorted(r.x for r in store.derived(spark, "twice", [path], make).collect())
    assert read() == read() == [0, 2, 4] and len(made) == 1
    spark.range(4).write.mode("append").parquet(path)
    assert read() == [0, 0, 2, 2, 4, 4, 6] and len(made) == 2
    assert A.series(spark, registry_sf()).count() == A.series(spark, registry_sf()).count()


def registry_sf():
    return "/root/testdata/sf0.001"
