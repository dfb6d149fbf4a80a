"""Hand values of the rating folds and laws of the simulated finals."""

import numpy as np
import pandas as pd
import pytest

from skirmish.operators import brackets as K
from skirmish.operators import ladders as L
from skirmish.operators import leagues as G
from skirmish.operators import ratings as R
from skirmish.plans import benchmark, finals, registry


def batch(*rows):
    return [{"series_id": i, "a": a, "b": b, "y": y} for i, a, b, y in rows]


def test_plain_fold_sees_rows_of_the_same_time():
    pdf = pd.DataFrame({"t": [1], "season": ["S"], "b": [batch((1, "A", "B", 1), (2, "A", "C", 1))]})
    out = G.plain_fold(pdf, "x", {"k": 24.0})
    assert out.before_a.tolist() == [1500.0, 1512.0]


def test_slot_fold_takes_the_predecessors_share_until_the_first_update():
    pdf = pd.DataFrame({"t": [1, 2, 3], "season": ["S"] * 3, "b": [batch((1, "A", "B", 1)), batch((2, "N", "B", 1)), batch((3, "N", "A", 1))]})
    out = G.slot_fold(pdf, "x", {"k": 24.0, "share": 0.5, "predecessors": {"N": "A"}})
    assert out.before_a[1] == 1506.0 and out.before_a[2] == 1506.0 + 24 * (1 - out.p[1])


def test_final_fold_resets_once_more():
    pdf = pd.DataFrame({"t": [1], "season": ["S"], "b": [batch((1, "A", "B", 1))]})
    out = G.final_fold(pdf, "x", {"k": 24.0, "rho": 0.5}).set_index("team")
    assert out.before_reset["A"] == 1512.0 and out.rating["A"] == 1506.0 and out.n["B"] == 1


def test_player_fold_by_hand():
    games = [{"game_number": 1, "la": [1, 2], "lb": [3, 4], "y": 1}, {"game_number": 2, "la": [1, 2], "lb": [3, 4], "y": None}]
    pdf = pd.DataFrame({"t": [1, 2], "series_id": [1, 2], "y": [1, 0], "games": [games, games]})
    c = {"name": "P2", "variant": "P2", "mode": "game", "k": 16.0, "m": 0.0}
    out = G.player_fold(pdf, "x", c)
    assert out.strength_a.tolist() == [1500.0, 1508.0] and out.strength_b[1] == 1492.0 and out.gap[1] == 16.0
    drawn = G.player_fold(pdf, "x", {**c, "m": 10.0})
    assert drawn.strength_a[1] == pytest.approx(1500 + 8 / 11)
    whole = G.player_fold(pdf, "x", {**c, "mode": "series", "variant": "P1"})
    assert whole.strength_a[1] == 1508.0


def test_game_fold_live_sees_the_series_and_pre_does_not():
    pdf = pd.DataFrame({"t": [1], "season": ["S"], "a": ["A"], "b_team": ["B"], "series_id": [1], "games": [[{"game_number": 1, "y": 1}, {"game_number": 2, "y": None}, {"game_number": 3, "y": 1}]]})
    out = G.game_fold(pdf, "x", {"name": "G", "k": 16.0})
    assert out.p_pre.tolist() == [0.5, 0.5] and out.p_live[1] > 0.5 and out.wins_a.tolist() == [0, 1]
    assert G.game_fold(pdf, "x", {"name": "G", "k": 16.0, "series_aware": True}).p_live.tolist() == [0.5, 0.5]


@pytest.mark.parametrize("name", ["T3", "random_choice", "any_pool", "K2", "K3"])
def test_every_rule_keeps_the_laws(spark, name):
    sims = K.finals(spark, 60, finals.RATINGS, **finals.VARIANTS[name])
    assert all(K.invariants(K.team_rows(sims)).first())


def test_seeds_stay_apart_in_the_draw(spark):
    base = K.breakthrough(K.ranked(K.ranked(K.stage1(spark, 60, finals.RATINGS), "master", K.MASTER), "elite", K.ELITE), finals.RATINGS)
    for scenario, halves in (("K1", True), ("K2", False)):
        for r in K.draw(base, scenario).select("master", "slots").collect():
            a, b = (r.slots.index(t) for t in r.master[:2])
            assert sorted(set(r.slots)) == sorted(r.slots) and a // 2 != b // 2 and (not halves or a // 4 != b // 4)


def test_grouped_logistic_is_each_groups_own_fit(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(x), int(rng.random() < 1 / (1 + np.exp(-(0.5 + g * x))))) for g in (1, 2) for x in rng.normal(size=300)]
    got = {r[0]: r[1:] for r in L.grouped_logistic(spark.createDataFrame(rows, "g int, x double, y int"), "g", ["x"], "y", 1.0, 12).collect()}
    for g in (1, 2):
        x, y = np.array([r[1] for r in rows if r[0] == g]), np.array([r[2] for r in rows if r[0] == g])
        p = 1 / (1 + np.exp(-(got[g][0] + got[g][1] * x)))
        assert abs((p - y).sum()) < 1e-6 and abs(((p - y) * x).sum() + got[g][1]) < 1e-6


def test_folds_do_not_depend_on_how_rows_arrive(spark):
    """A task reads its rows batch by batch; ratings, open batches of equal time and line-ups go from one to the next."""
    rng = np.random.default_rng(5)
    games = [[{"game_number": j + 1, "la": sorted(rng.choice(9, 5).tolist()), "lb": sorted(rng.choice(9, 5).tolist()), "y": None if rng.random() < 0.2 else int(rng.random() < 0.6)} for j in range(3)] for _ in range(60)]
    pdf = pd.DataFrame({"t": [i // 4 for i in range(60)], "season": [f"S{i // 20}" for i in range(60)], "series_id": range(60), "a": rng.integers(0, 4, 60), "b_team": rng.integers(4, 8, 60), "y": rng.integers(0, 2, 60), "games": games})
    columns = "t long, season string, series_id long, a long, b_team long, y int, games array<struct<game_number:int,la:array<long>,lb:array<long>,y:int>>"
    rows = spark.createDataFrame(pdf.to_dict("records"), columns)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        for step, fold, configs, schema in (
            (G.player_step, G.player_fold, benchmark.PLAYER_MODELS, "name string, league string, series_id long, " + ", ".join(f"{c} double" for c in G.PLAYER_COLUMNS)), (G.game_step, G.game_fold, [*benchmark.GAME_MODELS, {"name": "G9", "k": 9.0, "half": 9.0, "rho": 0.5}], benchmark._GAME),
        ):
            got = G.in_order(rows, configs, step, schema).toPandas()
            for c in configs:
                own = got[got.name == c["name"]].reset_index(drop=True)
                pd.testing.assert_frame_equal(own, fold(pdf, "all", c), check_dtype=False)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    flat = rows.select("series_id", "t", "season", "a", rows.b_team.alias("b"), "y")
    whole = R.fold(pdf.rename(columns={"b_team": "b"}), 20.0, half=9.0, rho=0.5)[0]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert R.rate(flat, [{"name": "x", "k": 20, "half": 9.0, "rho": 0.5}]).toPandas().p.tolist() == whole.tolist()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_ratings_gather_no_league_in_a_group(spark, sf):
    for name in ("r07_game_elo_g1", "r07_game_elo_g2", "r07_game_elo_g3", "r07_game_elo_g4", "r08_player_elo", "m09_benchmark"):
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().toString()
        assert "FlatMapGroupsIn" not in plan and "MapInArrow" in plan, name
