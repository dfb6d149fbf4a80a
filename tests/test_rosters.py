"""Names, roster features and one-pass checks by hand."""

import pytest
from pyspark.sql import functions as F

from skirmish.operators import checks as K
from skirmish.operators import names as N
from skirmish.operators import rosters as R


def test_matching_blocks_and_runs():
    assert N.matched("abcd", "bcde") == 0.75 and N.matched("", "") == 1.0
    assert N.common_run("北京龙之队 x", "上海龙之谷") == "龙之" and N.common_run("北京队", "ABC") == ""


def test_name_evidence(spark):
    pairs = [("北京龙之队", "上海龙之队"), ("北京狼人", "北京虎牙"), ("Star AG", "star"), ("KZ", "ZK")]
    got = {(r.old_name, r.new_name): r for r in N.name_features(spark.createDataFrame(pairs, "old_name string, new_name string")).collect()}
    r = got["北京龙之队", "上海龙之队"]
    assert (r.shared_cjk_substring, r.shared_prefix_only, r.strong_name_evidence, r.similar_string_flag) == ("龙之队", False, True, True)
    r = got["北京狼人", "北京虎牙"]
    assert (r.shared_cjk_substring, r.shared_prefix_only, r.strong_name_evidence) == ("北京", True, False)
    assert got["Star AG", "star"].shared_latin_tokens == "star" and not got["KZ", "ZK"].strong_name_evidence


def test_gap_rules_meet_every_allowed_pair_once(spark):
    day = 24
    inv = [("A", 0, 10 * day, 1), ("B", 5 * day, 20 * day, 1), ("C", 15 * day, 400 * day, 1), ("D", 600 * day, 700 * day, 2), ("E", 545 * day, 546 * day, 2), ("F", 551 * day, 552 * day, 2), ("G", 0, 1, 1)]
    df = spark.createDataFrame(inv, "team string, first_t long, last_t long, k int")
    got = [(r.old_name, r.new_name) for r in N.gap_pairs(df).collect()]
    want = [(a[0], b[0]) for a in inv for b in inv if (a[1], a[0]) < (b[1], b[0]) and b[1] - a[2] <= N.NAMED]
    assert sorted(got) == sorted(want) and ("A", "E") in got and ("A", "F") not in got


LINE = "team long, t long, season string, series_id long, side int, game_number int, player long"


def line_rows(plan):
    return [(1, t, season, sid, 0, g, p) for t, season, sid, games in plan for g, players in enumerate(games, 1) for p in players]


def test_roster_features_by_hand(spark):
    plan = [(0, "S1", 1, [[1, 2, 3, 4, 5], [1, 2, 3, 4, 6]]), (24, "S1", 2, [[1, 2, 3, 4, 5]]), (48, "S2", 3, [[1, 2, 3, 6, 7]]), (48, "S2", 4, [[1, 2, 3, 4, 5]]), (96, "S2", 5, [[1, 2, 3, 4, 5]])]
    a = spark.createDataFrame(line_rows(plan), LINE)
    y = spark.createDataFrame([(i, i % 2) for i in range(1, 6)], "series_id long, y int")
    got = {r.series_id: r for r in R.features(R.records(a, y), a).collect()}
    assert got[1].is_first_series_of_season == 1.0 and got[1].new_player_count is None and got[1].core == ""
    r = got[2]
    assert (r.new_player_count, r.returning_players_from_previous_series, r.rolling_unique_players_used, r.rolling_lineup_changes, r.core) == (6.0, None, 6.0, 1.0, "1|2|3|4|5")
    assert r.historical_performance_when_rotating == pytest.approx((1 + 2.5) / 6, abs=1e-6) and r.is_first_series_of_season == 0.0
    assert got[3].is_first_series_of_season == 1.0 and got[3].days_since_team_last_series == got[4].days_since_team_last_series == 1.0  # equal times do not see each other
    r = got[5]  # the last series are 3 and 4, in that order
    assert (r.returning_players_from_previous_series, r.new_player_count, r.recently_returned_player_count, r.days_since_team_last_series, r.days_since_player_last_appearance) == (3.0, 0.0, 0.0, 2.0, 2.0)
    assert r.roster_stability_3_series == pytest.approx((3 + 3 + 3 + 2 + 2) / 15)


def test_players_who_left_are_not_of_the_pool(spark):
    a = spark.createDataFrame(line_rows([(0, "S", 1, [[1, 2, 3, 4, 5]]), (50, "S", 3, [[1, 2, 3, 4, 5]])]) + [(2, 10, "S", 2, 1, 1, p) for p in (5, 11, 12, 13, 14)], LINE)
    y = spark.createDataFrame([(i, 1) for i in range(1, 4)], "series_id long, y int")
    got = {(r.team, r.series_id): r for r in R.features(R.records(a, y), a).collect()}
    assert got[1, 3].core == "1|2|3|4" and got[1, 3].core5_overlap_previous_series == 4.0


def test_one_pass_keeps_the_first_examples_of_many(spark):
    rows = spark.range(0, 5000, 1, 7)
    checks = {"odd": (F.lit(1), F.when(F.col("id") % 2 == 1, F.array(F.format_string("%05d", "id")))), "never": (F.lit(2), F.lit(None).cast("array<string>")), "twice": (F.lit(1), F.when(F.col("id") == 7, F.array(F.lit("b"), F.lit("a"))))}
    got = {r.check: (r.n_checked, r.n_flagged, r.examples) for r in K.one_pass(rows, checks).collect()}
    assert got == {"odd": (5000, 2500, "00001; 00003; 00005; 00007; 00009"), "never": (10000, 0, ""), "twice": (5000, 2, "a; b")}
    assert {r.n_checked for r in K.one_pass(rows.limit(0), checks).collect()} == {0}


def test_layers(spark):
    rows = spark.createDataFrame([("S1", 2, 2), ("S1", 1, 1), ("S2", 0, 3), ("S3", 1, 3), ("S4", 0, 0)], "season string, n int, d int")
    c = K.coverage(rows, "season", {"x": (F.col("n"), F.col("d"))})
    assert {r.season: (r.numerator, r.denominator, r.coverage_pct) for r in c.collect()} == {"S1": (3, 3, 100.0), "S2": (0, 3, 0.0), "S3": (1, 3, 33.33), "S4": (0, 0, None)}
    assert {r.season: r.classification for r in K.classified(c, "season").collect()} == {"S1": "FULL", "S2": "NONE", "S3": "PARTIAL", "S4": "UNKNOWN", "EARLIEST_AVAILABLE": "S1"}
