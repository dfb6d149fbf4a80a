"""Queries of prior state, rosters, drafts and linkage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rounding import rounded_sql
from ..operators import backbone as B
from ..operators import history as H
from ..sources import adapter as A
from .backbone import LABEL
from .base import query

PRIOR = "PARTITION BY {k} ORDER BY {t} RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _rates(k, name, t="clock"):
    w = f"({PRIOR.format(k=k, t=t)})"
    rate = rounded_sql(f"count(*) FILTER (won) OVER {w} / count(won) OVER {w}")
    return f"count(*) OVER {w} AS {name}_games, count(*) FILTER (won) OVER {w} AS {name}_wins, CASE WHEN count(won) OVER {w} > 0 THEN {rate} END AS {name}_rate"


@query("w03_player_hero_state", "appearances", f"SELECT series_id, game_number, side, position, {_rates('player, hero', 'pair')}, {_rates('player', 'player')}, {_rates('hero', 'hero')}, {_rates('team, hero', 'team_hero')} FROM (SELECT *, t * 1000 + game_number AS clock FROM appearances)")
def w03(spark, sf):
    cols = [f"{n}_{c}" for n in H.STATE_KEYS for c in ("games", "wins", "rate")]
    return H.player_hero_state(A.appearances(spark, sf)).select("series_id", "game_number", "side", "position", *cols)


@query("w03_preseries_state", "appearances", f"""
WITH p AS (SELECT player, t, count(*) AS g, count(*) FILTER (won) AS w, count(won) AS d FROM appearances GROUP BY 1, 2)
SELECT player, t, CAST(coalesce(sum(g) OVER x, 0) AS BIGINT) AS games, CAST(coalesce(sum(w) OVER x, 0) AS BIGINT) AS wins, CAST(coalesce(sum(d) OVER x, 0) AS BIGINT) AS decided FROM p WINDOW x AS ({PRIOR.format(k='player', t='t')})""")
def w03b(spark, sf):
    return H.preseries_state(A.appearances(spark, sf))


_SHRUNK = "(count(*) FILTER (kind = 'P' AND won) OVER {w} + 5.0) / (count(*) FILTER (kind = 'P' AND won IS NOT NULL) OVER {w} + 10.0)"


@query("w04_draft_state", "draft_events", f"""
SELECT draft, seq, hero, kind, count(*) FILTER (kind = 'P') OVER x AS prior_picks, count(*) FILTER (kind = 'B') OVER x AS prior_bans,
 {rounded_sql(_SHRUNK.format(w='x'))} AS prior_rate, {rounded_sql(_SHRUNK.format(w='y'))} AS team_prior_rate, count(*) FILTER (kind = 'P' AND won IS NOT NULL) OVER y >= 5 AS team_min_sample
FROM draft_events WINDOW x AS ({PRIOR.format(k='hero', t='t')}), y AS ({PRIOR.format(k='team, hero', t='t')})""")
def w04(spark, sf):
    return H.draft_state(A.draft_events(spark, sf))


_PAIR_STATE = """
h AS (SELECT DISTINCT series_id, t, game_number, side, won, hero, t * 1000 + game_number AS clock FROM appearances),
p AS (SELECT a.series_id, a.t, a.game_number, a.side, a.won, a.clock, a.hero AS a, b.hero AS b FROM h a JOIN h b ON a.series_id = b.series_id AND a.game_number = b.game_number AND {on})
SELECT series_id, t, game_number, side, a, b, count(*) OVER w AS prior_games, count(won) OVER w AS prior_decided, {rate} AS prior_rate FROM p WINDOW w AS ({w})"""
_PAIR = {"rate": rounded_sql("(count(*) FILTER (won) OVER w + 5.0) / (count(won) OVER w + 10.0)"), "w": PRIOR.format(k="a, b", t="clock")}


@query("w04_synergy_state", "appearances", "WITH " + _PAIR_STATE.format(on="a.side = b.side AND a.hero < b.hero", **_PAIR))
def w04s(spark, sf):
    return H.pair_state(A.appearances(spark, sf))[0]


@query("w04_counter_state", "appearances", "WITH " + _PAIR_STATE.format(on="a.side <> b.side", **_PAIR))
def w04c(spark, sf):
    return H.pair_state(A.appearances(spark, sf))[1]


SIDES = f"""
l AS (SELECT series_id, t, 'a' AS side, team_a AS team, score_a > score_b AS won FROM series WHERE ({LABEL}) = 'COMPLETED' UNION ALL SELECT series_id, t, 'b', team_b, score_b > score_a FROM series WHERE ({LABEL}) = 'COMPLETED')"""


def _sides(spark, sf):
    s = B.labelled(A.series(spark, sf)).where("labelled")
    x = F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("team_a").alias("team"), (F.col("score_a") > F.col("score_b")).alias("won")), F.struct(F.lit("b").alias("side"), F.col("team_b").alias("team"), (F.col("score_b") > F.col("score_a")).alias("won"))))
    return s.select("series_id", "t", x.alias("x")).select("series_id", "t", "x.*")


@query("w06_rolling_form", "series", f"""
WITH {SIDES}, n AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY t, series_id, side) AS n FROM l)
SELECT series_id, side, team, n, count(*) OVER x AS seen, CAST(coalesce(sum(CAST(won AS INTEGER)) OVER x, 0) AS BIGINT) AS wins FROM n WINDOW x AS (PARTITION BY team ORDER BY n RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING)""")
def w06(spark, sf):
    return H.rolling_form(_sides(spark, sf)).withColumn("n", F.col("n").cast("long"))


@query("w07_decayed_players", "appearances", """
WITH p AS (SELECT team, t, player, count(*) AS games FROM appearances GROUP BY 1, 2, 3), o AS (SELECT team, t, row_number() OVER (PARTITION BY team ORDER BY t DESC) - 1 AS s FROM (SELECT DISTINCT team, t FROM appearances)),
x AS (SELECT team, player, CAST(sum(games) AS BIGINT) AS games, round(sum(games * pow(0.5, s / 3.0)), 6) AS score FROM p JOIN o USING (team, t) WHERE s < 20 GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY score DESC, games DESC, player) AS place FROM x) WHERE place <= 5""")
def w07(spark, sf):
    return H.decayed_players(A.appearances(spark, sf)).withColumn("place", F.col("place").cast("long"))


@query("a35_rotation_summary", "appearances", """
WITH l AS (SELECT series_id, side, team, game_number, list_sort(list(player)) AS line FROM appearances GROUP BY ALL),
x AS (SELECT *, lag(line) OVER w AS before, first_value(line) OVER w AS fst FROM l WINDOW w AS (PARTITION BY series_id, side ORDER BY game_number))
SELECT series_id, side, team, CAST(len(list_distinct(flatten(list(line)))) AS INTEGER) AS players, count(*) FILTER (before <> line) AS changes, count(DISTINCT line) AS lineups,
 round(coalesce(avg(len(list_intersect(line, fst)) / len(fst)) FILTER (before IS NOT NULL), 1.0), 6) AS continuity FROM x GROUP BY 1, 2, 3""")
def a35(spark, sf):
    return H.rotation(A.appearances(spark, sf))


@query("a36_series_hero_usage", "appearances", """
WITH g AS (SELECT series_id, side, game_number, list(DISTINCT hero) AS heroes FROM appearances GROUP BY 1, 2, 3),
x AS (SELECT *, list_distinct(flatten(coalesce(list(heroes) OVER (PARTITION BY series_id, side ORDER BY game_number RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []))) AS used FROM g)
SELECT series_id, side, game_number, CAST(len(used) AS INTEGER) AS n_used, CAST(len(list_intersect(used, heroes)) AS INTEGER) AS n_repeated FROM x""")
def a36(spark, sf):
    return H.hero_usage(A.appearances(spark, sf))


def _handles(spark, sf):
    return A.appearances(spark, sf).withColumn("handle", F.col("player") % 997)


@query("a33_transfers", "appearances", """
WITH x AS (SELECT player % 997 AS handle, t, series_id, game_number, side, team, position, lag(team) OVER (PARTITION BY player % 997 ORDER BY t, series_id, game_number, side) AS last_team FROM appearances)
SELECT handle, count(*) AS games, min(t) AS first_t, max(t) AS last_t, count(*) FILTER (last_team IS NULL OR last_team <> team) - 1 AS transfers,
 string_agg(CAST(team AS VARCHAR), '>' ORDER BY t, series_id, game_number, side) FILTER (last_team IS NULL OR last_team <> team) AS teams FROM x GROUP BY handle""")
def a33(spark, sf):
    return H.transfers(_handles(spark, sf))


@query("a41_hero_roles", "appearances", """
WITH n AS (SELECT hero, position, count(*) AS n FROM appearances GROUP BY 1, 2), q AS (SELECT *, n / sum(n) OVER (PARTITION BY hero) AS q FROM n)
SELECT hero, CAST(sum(n) AS BIGINT) AS games, round(abs(sum(-q * ln(q))) / ln(5.0), 6) AS flex, CAST(arg_max(position, n * 10 - position) AS INTEGER) AS "primary" FROM q GROUP BY hero""")
def a41(spark, sf):
    return H.roles(A.appearances(spark, sf)).withColumn("primary", F.col("primary").cast("int"))


@query("a42_synergy", "appearances", """
WITH h AS (SELECT DISTINCT series_id, game_number, side, won, hero FROM appearances WHERE won IS NOT NULL)
SELECT a.hero AS hero_a, b.hero AS hero_b, count(*) AS games, count(*) FILTER (a.won) AS wins, round((count(*) FILTER (a.won) + 10.0) / (count(*) + 20.0), 6) AS rate
FROM h a JOIN h b ON a.series_id = b.series_id AND a.game_number = b.game_number AND a.side = b.side AND a.hero < b.hero GROUP BY 1, 2""")
def a42(spark, sf):
    return H.synergy(A.appearances(spark, sf))


@query("a43_counters", "appearances", """
WITH h AS (SELECT series_id, game_number, side, won, hero FROM appearances WHERE won IS NOT NULL)
SELECT a.hero, b.hero AS against, count(*) AS games, count(*) FILTER (a.won) AS wins, round((count(*) FILTER (a.won) + 10.0) / (count(*) + 20.0), 6) AS rate
FROM h a JOIN h b ON a.series_id = b.series_id AND a.game_number = b.game_number AND a.side <> b.side GROUP BY 1, 2""")
def a43(spark, sf):
    return H.counters(A.appearances(spark, sf))


@query("w11_sequential_draft", "draft_events", """
SELECT d.draft, CAST(j AS INTEGER) AS j, CAST(count(*) FILTER (seq <= j AND kind = 'B' AND side = 0) AS INTEGER) AS bans_a, CAST(count(*) FILTER (seq <= j AND kind = 'B' AND side = 1) AS INTEGER) AS bans_b,
 CAST(count(*) FILTER (seq <= j AND kind = 'P' AND side = 0) AS INTEGER) AS picks_a, CAST(count(*) FILTER (seq <= j AND kind = 'P' AND side = 1) AS INTEGER) AS picks_b FROM draft_events d, range(19) r(j) GROUP BY 1, 2""")
def w11(spark, sf):
    return H.sequential_draft(A.drafts(spark, sf))


@query("p06_draft_quality", "draft_events", """
SELECT draft, count(*) AS n, string_agg(kind, '' ORDER BY seq) AS shape, arg_min(side, seq) FILTER (kind = 'P') AS first_pick, count(*) - count(DISTINCT hero) AS repeated, string_agg(kind, '' ORDER BY seq) = 'BBBBPPPPPPBBBBPPPP' AS standard FROM draft_events GROUP BY 1""")
def p06(spark, sf):
    return H.draft_quality(A.drafts(spark, sf))


@query("p05_draft_phase", "draft_events", "SELECT CASE WHEN seq <= 4 THEN 'BAN_1' WHEN seq <= 10 THEN 'PICK_1' WHEN seq <= 14 THEN 'BAN_2' ELSE 'PICK_2' END AS phase, kind, count(*) AS n, count(DISTINCT hero) AS heroes FROM draft_events GROUP BY 1, 2")
def p05(spark, sf):
    phase = F.when(F.col("seq") <= 4, "BAN_1").when(F.col("seq") <= 10, "PICK_1").when(F.col("seq") <= 14, "BAN_2").otherwise("PICK_2")
    return A.draft_events(spark, sf).groupBy(phase.alias("phase"), "kind").agg(F.count("*").alias("n"), F.countDistinct("hero").alias("heroes"))


@query("w10_recency_strength", "appearances", """
WITH p AS (SELECT hero, t, count(*) AS g, count(*) FILTER (won) AS w FROM appearances WHERE won IS NOT NULL GROUP BY 1, 2),
u AS (SELECT *, pow(2.0, (t - min(t) OVER (PARTITION BY hero)) / 2160.0) AS u FROM p),
s AS (SELECT hero, t, u, coalesce(sum(g * u) OVER x, 0.0) / u AS sg, coalesce(sum(w * u) OVER x, 0.0) / u AS sw FROM u WINDOW x AS (PARTITION BY hero ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT hero, t, round(sg, 6) AS weight, round((sw + 5) / (sg + 10), 6) AS strength FROM s""")
def w10(spark, sf):
    return H.recency_strength(A.appearances(spark, sf))


@query("a34_series_usage", "appearances", "SELECT series_id, team, player, count(*) AS games, count(*) FILTER (won) AS wins, min(game_number) AS first_game FROM appearances GROUP BY 1, 2, 3")
def a34(spark, sf):
    return A.appearances(spark, sf).groupBy("series_id", "team", "player").agg(F.count("*").alias("games"), F.count_if("won").alias("wins"), F.min("game_number").alias("first_game"))


@query("a44_season_games", "games", "SELECT season, count(*) AS games, count(winner) AS known, count(*) FILTER (winner = 'a') AS wins_a FROM games GROUP BY season")
def a44(spark, sf):
    return A.games(spark, sf).groupBy("season").agg(F.count("*").alias("games"), F.count("winner").alias("known"), F.count_if(F.col("winner") == "a").alias("wins_a"))


@query("j21_hero_id_map", "", "SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name HAVING count(DISTINCT p_partkey) = 1")
def j21(spark, sf):
    return A.table(spark, sf, "part").groupBy("p_name").agg(F.countDistinct("p_partkey").alias("n"), F.min("p_partkey").alias("p_partkey")).where("n = 1").drop("n")


@query("j23_shared_handles", "appearances", """
WITH p AS (SELECT DISTINCT player, player % 97 AS handle, team FROM appearances), g AS (SELECT player, count(DISTINCT series_id) AS n FROM appearances GROUP BY 1)
SELECT a.player AS x, b.player AS y, any_value(a.handle) AS handle, any_value(ga.n) AS series_x, any_value(gb.n) AS series_y FROM p a JOIN p b ON a.handle = b.handle AND a.player < b.player AND abs(a.player - b.player) <= 200 JOIN g ga ON ga.player = a.player JOIN g gb ON gb.player = b.player GROUP BY 1, 2""")
def j23(spark, sf):
    a = A.appearances(spark, sf)
    n = a.groupBy("player").agg(F.countDistinct("series_id").alias("n"))
    p = n.withColumn("handle", F.col("player") % 97)  # a row per player
    x, y = p.alias("x"), p.alias("y")
    return x.join(y, (F.col("x.handle") == F.col("y.handle")) & (F.col("x.player") < F.col("y.player")) & (F.abs(F.col("x.player") - F.col("y.player")) <= 200)).select(F.col("x.player").alias("x"), F.col("y.player").alias("y"), F.col("x.handle").alias("handle"), F.col("x.n").alias("series_x"), F.col("y.n").alias("series_y"))


def _shr(w, d):
    return f"CASE WHEN {d} >= 5 THEN ({w} + 5.0::DOUBLE) / ({d} + 10.0::DOUBLE) - 0.5::DOUBLE ELSE 0.0::DOUBLE END"


_STATIC = f"""
gn AS (SELECT t, count(DISTINCT draft) AS n FROM draft_events GROUP BY t), gb AS (SELECT t, coalesce(sum(n) OVER (ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS games FROM gn),
es AS (SELECT series_id, game_number, side, kind, t, count(*) FILTER (kind = 'P') OVER x AS pp, count(*) FILTER (kind = 'P' AND won) OVER x AS w, count(*) FILTER (kind = 'P' AND won IS NOT NULL) OVER x AS d,
 count(*) FILTER (kind = 'P') OVER y AS tg, count(*) FILTER (kind = 'P' AND won) OVER y AS tw, count(*) FILTER (kind = 'P' AND won IS NOT NULL) OVER y AS td FROM draft_events WINDOW x AS ({PRIOR.format(k='hero', t='t')}), y AS ({PRIOR.format(k='team, hero', t='t')})),
dr AS (SELECT series_id, game_number, side, avg({_shr('w', 'd')}) FILTER (kind = 'P') AS hero_strength, avg(CASE WHEN d >= 5 THEN CAST(w AS DOUBLE) / d - 0.5::DOUBLE ELSE 0.0::DOUBLE END) FILTER (kind = 'P') AS hero_winrate_raw, CAST(sum(pp) FILTER (kind = 'P') AS DOUBLE) / (count(*) FILTER (kind = 'P') * greatest(max(games), 1)) AS hero_pick_rate,
 avg(ln(1.0::DOUBLE + tg)) FILTER (kind = 'P') AS team_hero_familiarity, avg({_shr('tw', 'td')}) FILTER (kind = 'P') AS team_hero_strength, avg({_shr('w', 'd')}) FILTER (kind = 'B') AS ban_strength FROM es JOIN gb USING (t) GROUP BY 1, 2, 3),
hh AS (SELECT DISTINCT series_id, t, game_number, side, won, hero, t * 1000 + game_number AS clock FROM appearances),
p1 AS (SELECT a.series_id, a.game_number, a.side, a.won, a.clock, a.hero AS a, b.hero AS b FROM hh a JOIN hh b ON a.series_id = b.series_id AND a.game_number = b.game_number AND a.side = b.side AND a.hero < b.hero),
p2 AS (SELECT a.series_id, a.game_number, a.side, a.won, a.clock, a.hero AS a, b.hero AS b FROM hh a JOIN hh b ON a.series_id = b.series_id AND a.game_number = b.game_number AND a.side <> b.side),
q1 AS (SELECT *, count(*) OVER w AS g, count(*) FILTER (won) OVER w AS w, count(won) OVER w AS d FROM p1 WINDOW w AS ({PRIOR.format(k='a, b', t='clock')})), q2 AS (SELECT *, count(*) FILTER (won) OVER w AS w, count(won) OVER w AS d FROM p2 WINDOW w AS ({PRIOR.format(k='a, b', t='clock')})),
sy AS (SELECT series_id, game_number, side, avg({_shr('w', 'd')}) AS synergy, avg(CAST(g = 0 AS INTEGER)) AS pair_novelty FROM q1 GROUP BY 1, 2, 3), cn AS (SELECT series_id, game_number, side, avg({_shr('w', 'd')}) AS counter FROM q2 GROUP BY 1, 2, 3),
sd AS (SELECT * FROM dr LEFT JOIN sy USING (series_id, game_number, side) LEFT JOIN cn USING (series_id, game_number, side)),
wd AS (SELECT series_id, game_number, {', '.join(f"max({f}) FILTER (side = {i}) AS {f}_{x}" for f in H.STATIC for i, x in enumerate("ab"))} FROM sd GROUP BY 1, 2)"""


@query("j26_static_features", "appearances draft_events", f"WITH {_STATIC} SELECT series_id, game_number, {', '.join(rounded_sql(f'{f}_{x}') + f' AS {f}_{x}' for f in H.STATIC for x in 'ab')}, {', '.join(rounded_sql(f'{f}_a - {f}_b') + f' AS {f}_diff' for f in H.STATIC)} FROM wd")
def j26(spark, sf):
    """Of every game, both sides' draft features before it and their differences."""
    return H.static_features(A.draft_events(spark, sf), A.appearances(spark, sf))
