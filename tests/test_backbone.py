"""Labels, identity, ranks, folds and refresh on hand-made rows."""

from pyspark.sql import functions as F

from skirmish.functions import columns as C
from skirmish.operators import backbone as B
from skirmish.operators import evaluate as E
from skirmish.operators import ratings as R

SERIES = "series_id long, season string, stage string, t long, team_a string, team_b string, score_a int, score_b int, status int"


def make(spark, rows):
    return spark.createDataFrame(rows, SERIES)


def test_label_rules(spark):
    rows = [(1, "S1", "x", 1, "A", "B", 3, 1, 4), (2, "S1", "x", 1, "A", "B", 2, 0, 3), (3, "S1", "x", 1, "A", "B", 0, 0, 1), (4, "S1", "x", 1, "A", "B", 1, 1, 4), (5, "S1", "x", 1, "A", "B", None, 1, 4)]
    got = {r.series_id: (r.label_flag, r.winner_team) for r in B.labelled(make(spark, rows)).collect()}
    assert got == {1: ("COMPLETED", "A"), 2: ("STATUS_SCORE_CONFLICT", None), 3: ("NOT_FINISHED", None), 4: ("FINISHED_NO_DECISIVE_SCORE", None), 5: ("FINISHED_NO_DECISIVE_SCORE", None)}


def test_identity_status(spark):
    rows = [(1, "S1", "x", 1, "A1", "B", 2, 0, 4), (2, "S1", "x", 50, "A2", "B", 2, 0, 4), (3, "S1", "x", 60, "A1", "C", 2, 0, 4), (4, "S1", "x", 70, "B", "C", 2, 0, 4), (5, "S1", "x", 70, "B", "D", 0, 2, 4), (6, "S1", "x", 90, "D", "U", 0, 2, 4), (7, "S1", "x", 95, "D", "B", 0, 2, 4)]
    reg = spark.createDataFrame([("A1", "a", "VERIFIED"), ("A2", "a", "VERIFIED"), ("B", "b", "VERIFIED"), ("C", "c", "VERIFIED"), ("D", "d", "VERIFIED"), ("U", "u", "UNREVIEWED")], "observed_name string, canonical_id string, review_status string")
    got = {r.series_id: r.identity_status for r in B.canonical(make(spark, rows), reg).collect()}
    assert got == {1: "CONFLICT", 2: "CONFLICT", 3: "CONFLICT", 4: "CONFLICT", 5: "CONFLICT", 6: "UNRESOLVED", 7: "RESOLVED"}


def test_ranks_do_not_depend_on_partitions(spark):
    rows = [(i, "S1", "x", i // 3, "A", "B", 1, 0, 4) for i in range(50)]
    for n in (1, 7):
        got = sorted((r.series_id, r.batch, r.chronological) for r in B.ranked(make(spark, rows).repartition(n)).collect())
        assert got == [(i, i // 3 + 1, i + 1) for i in range(50)]


def test_refresh_classes(spark):
    day = 24
    old = make(spark, [(1, "S", "x", 1, "A", "B", 1, 0, 4), (2, "S", "x", 2, "A", "B", 1, 0, 4), (3, "S", "x", 3 * day, "A", "B", 1, 0, 4), (4, "S", "x", 4 * day, "A", "B", 1, 0, 4), (5, "S", "x", 5, "A", "B", 1, 0, 4), (6, "S", "x", 6, "A", "B", 0, 0, 1), (7, "S", "x", 7, "A", "B", 0, 0, 1), (8, "S", "x", 8, "A", "C", 1, 0, 4), (9, "S", "x", 9, "A", "B", 1, 0, 4)])
    new = make(spark, [(1, "S", "y", 1, "A", "B", 1, 0, 4), (2, "S", "x", 2, "A", "B", 2, 0, 4), (30, "S", "x", 3 * day + 1, "B", "A", 1, 0, 4), (50, "S", "x", 99 * day, "A", "B", 1, 0, 4), (5, "S", "x", 5, "A", "B", 1, 0, 2), (6, "S", "x", 6, "A", "B", 2, 1, 4), (7, "S", "x", 7, "A", "B", 0, 0, 3), (8, "S", "x", 8, "A", "D", 1, 0, 4), (9, "S", "x", 10, "A", "B", 1, 0, 4)])
    d = {(r.series_id, r.o_series_id): r for r in B.diff_classes(old, new).collect()}
    assert {k: r.diff_class for k, r in d.items()} == {(1, 1): "EXACT_EXISTING", (2, 2): "SCORE_CONFLICT", (30, 3): "TEAM_NAME_CONFLICT", (50, None): "NEW_SERIES", (None, 4): "UNMATCHED", (5, 5): "SCORE_CONFLICT", (6, 6): "RESULT_UPDATED", (7, 7): "STATUS_UPDATED", (8, 8): "TEAM_NAME_CONFLICT", (9, 9): "DATE_CONFLICT"}
    assert d[1, 1].detail == "stage x -> y" and d[5, 5].detail == "completed result retracted: status 4 -> 2" and d[2, 2].detail == "score 1-0 -> 2-0"
    assert d[30, 3].match_method == "FALLBACK_COMPETITION_DATE_TEAMPAIR" and d[50, None].match_method == ""
    kept = {r.series_id: (r.stage, r.status, r.score_a) for r in B.refreshed(old, new).collect()}
    assert kept == {1: ("y", 4, 1), 2: ("x", 4, 1), 3: ("x", 4, 1), 4: ("x", 4, 1), 5: ("x", 4, 1), 6: ("x", 4, 2), 7: ("x", 3, 0), 8: ("x", 4, 1), 9: ("x", 4, 1), 50: ("x", 4, 1)}


def rows_of(results):
    return [(i, t, s, a, b, y) for i, (t, s, a, b, y) in enumerate(results)]


RATED = "series_id long, t long, season string, a long, b long, y int"


def test_elo_ties_use_the_state_before_the_batch(spark):
    df = spark.createDataFrame(rows_of([(1, "S", 1, 2, 1), (1, "S", 1, 3, 1), (2, "S", 1, 4, 0)]), RATED)
    got = {r.series_id: (r.p, r.before_a) for r in R.rate(df, [{"name": "x", "k": 32}]).collect()}
    assert got[0][0] == got[1][0] == 0.5 and got[2][1] == 1500 + 16 + 16


def test_season_reset_and_decay():
    import pandas as pd
    import pytest

    rows = pd.DataFrame(rows_of([(0, "S1", 1, 2, 1), (10 * 24, "S2", 1, 2, 1)]), columns=["series_id", "t", "season", "a", "b", "y"])
    _, ra, rb, _ = R.fold(rows, k=200, rho=0.25)
    assert (ra[1], rb[1]) == (1525, 1475)
    same = rows.assign(season="S1")
    _, ra, rb, _ = R.fold(same, k=200, half=240.0)
    assert (ra[1], rb[1]) == (1550, 1450)
    with pytest.raises(ValueError):
        R.fold(rows, k=1, rho=2)


def test_later_results_never_change_earlier_predictions(spark):
    base = [(i // 2, "S1" if i < 20 else "S2", i % 5, (i * 3 + 1) % 5 + 5, i % 2) for i in range(40)]
    configs = [{"name": "e", "k": 24}, {"name": "d", "k": 24, "half": 48.0}, {"name": "r", "k": 24, "rho": 0.5}]

    def run(results):
        df = spark.createDataFrame(rows_of(results), RATED)
        out = {(r.config, r.series_id): r.p for r in R.rate(df, configs).collect()}
        return out | {("w", r.series_id): r.p for r in R.smoothed_win_rates(df).collect()}

    first = run(base)
    for flip in (10, 31):
        changed = [(t, s, a, b, 1 - y if i == flip else y) for i, (t, s, a, b, y) in enumerate(base)]
        second = run(changed)
        same_time = base[flip][0]
        assert all(first[k] == second[k] for k in first if base[k[1]][0] <= same_time)
        assert first != second


def test_series_mathematics(spark):
    r = spark.range(1).select(*[C.series_prob(F.lit(0.6), n).alias(f"b{n}") for n in (3, 5, 7)], C.game_prob(F.lit(0.68256), 5).alias("g")).first()
    assert [round(r.b3, 6), round(r.b5, 6), round(r.b7, 6), round(r.g, 9)] == [0.648, 0.68256, 0.710208, 0.6]


def test_metrics_by_hand(spark):
    p = spark.createDataFrame([("m", 0.9, 1), ("m", 0.4, 0), ("m", 0.4, 1), ("m", 0.2, 0)], "g string, p double, y int")
    r = E.metrics(p, "g").first()
    assert (r.n, r.auc, r.accuracy, r.brier) == (4, 0.875, 0.75, round((0.01 + 0.16 + 0.36 + 0.04) / 4, 6))
    one = E.metrics(p.where("y = 1"), "g").first()
    assert one.auc is None
    bins = E.reliability(p).collect()
    assert len(bins) == 10 and sum(b.n for b in bins) == 4 and bins[5].mean_p is None
