"""Queries of raw responses: JSON bodies made from the tables are parsed again; the SQL reads the tables themselves."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import backbone as B
from ..operators import checks as K
from ..operators import roster as R
from ..sources import adapter as A
from .base import query

#: What the bodies lack on purpose, as SQL conditions on a slot: no list of players, no positions, no hero, no player id.
NO_PLAYERS, NO_POSITIONS, NO_HERO, NO_ID = "series_id % 41 = 0", "series_id % 37 = 0", "(series_id % 43 = 0 AND position = 5)", "(series_id % 47 = 0 AND position = 1 AND side = 0)"
_HERO, _ID = f"CASE WHEN NOT {NO_HERO} THEN hero + 1 END", f"CASE WHEN {NO_ID} THEN '' ELSE CAST(player AS STRING) END"


def details(spark, sf):
    """(scheduleid, body): a detail response per series. A row per series is shuffled; its games' players are made after."""
    s = A.packed_games(spark, sf).groupBy("series_id").agg(F.collect_list(F.struct("nation_a", "nation_b", "games")).alias("rows"))
    win = lambda r, g: F.when(g["winner"] == "a", F.concat(F.lit("S"), r["nation_a"])).when(g["winner"] == "b", F.concat(F.lit("S"), r["nation_b"]))
    game = lambda r: lambda g: F.struct(g["game_number"].alias("round"), win(r, g).alias("win_team"), A.slots(g, r["nation_a"], r["nation_b"]).alias("slots"))
    s = s.select("series_id", F.flatten(F.transform("rows", lambda r: F.transform(r["games"], game(r)))).alias("games"))
    of = lambda text: re.sub(r"\b(position|side|player|hero)\b", r"x.\1", text)
    player = f"named_struct('playerid', {of(_ID)}, 'position', CASE WHEN {NO_POSITIONS} THEN 0 ELSE x.position END, 'hero_id', {of(_HERO)}, 'hero_name', CASE WHEN NOT {of(NO_HERO)} THEN concat('H', x.hero) END)"
    rounds = F.expr(f"sort_array(transform(games, g -> named_struct('round', g.round, 'win_team', g.win_team, 'vid', 'v', 'players', CASE WHEN NOT ({NO_PLAYERS}) THEN transform(g.slots, x -> {player}) END)))")
    listed = F.expr(f"CASE WHEN NOT ({NO_PLAYERS}) THEN sort_array(array_distinct(flatten(transform(games, g -> transform(g.slots, x -> named_struct('playerid', {of(_ID)}, 'team_id', concat('S', x.team), 'player_name', concat('P', x.player), 'player_name_short', '', 'position', 0)))))) END")
    return s.select(F.col("series_id").alias("scheduleid"), F.to_json(F.struct(F.lit(0).alias("result"), F.struct(listed.alias("players"), rounds.alias("round_details")).alias("data"))).alias("body"))


_ID_SQL = _ID.replace("STRING", "VARCHAR")
LISTED = f"listed AS (SELECT DISTINCT series_id AS scheduleid, {_ID_SQL} AS playerid, 'S' || team AS team_slot, 'P' || player AS player_name FROM appearances WHERE NOT ({NO_PLAYERS}))"
ROUNDS = "rounds AS (SELECT series_id AS scheduleid, game_number AS round, CASE winner WHEN 'a' THEN 'S' || nation_a WHEN 'b' THEN 'S' || nation_b ELSE '' END AS win_team_slot, nation_a, nation_b FROM games)"
PLAYED = f"""{LISTED}, slots AS (SELECT scheduleid, playerid, CASE WHEN count(DISTINCT team_slot) = 1 THEN min(team_slot) ELSE 'UNKNOWN' END AS team_slot FROM listed GROUP BY 1, 2),
played AS (SELECT series_id AS scheduleid, game_number AS round, CAST(side * 5 + position AS INTEGER) AS place, {_ID_SQL} AS playerid, CAST(CASE WHEN {NO_POSITIONS} THEN 0 ELSE position END AS INTEGER) AS position, CAST({_HERO} AS INTEGER) AS hero_id, CASE WHEN NOT {NO_HERO} THEN 'H' || hero ELSE '' END AS hero_name FROM appearances WHERE NOT ({NO_PLAYERS})),
gp AS (SELECT p.*, s.team_slot FROM played p JOIN slots s USING (scheduleid, playerid))"""


@query("s18_series_players", "appearances", f"WITH {LISTED} SELECT scheduleid, playerid, team_slot, player_name, '' AS handle, CAST(0 AS INTEGER) AS position FROM listed")
def s18a(spark, sf):
    return R.series_players(details(spark, sf))


@query("s18_detail_games", "appearances", f"WITH {ROUNDS} SELECT scheduleid, round, win_team_slot, TRUE AS has_game_vid, CAST(CASE WHEN scheduleid % 41 = 0 THEN 0 ELSE 10 END AS INTEGER) AS n_players FROM rounds")
def s18b(spark, sf):
    return R.detail_games(details(spark, sf))


@query("s18_game_players", "appearances", f"WITH {PLAYED} SELECT scheduleid, round, place, playerid, team_slot, position, hero_id, hero_name FROM gp")
def s18c(spark, sf):
    return R.game_players(details(spark, sf))


FLAGS = f"""{PLAYED}, {ROUNDS},
team AS (SELECT scheduleid, round, team_slot, count(*) AS n, bool_and(position = 0) AS blank, list_sort(list(position)) = [1, 2, 3, 4, 5] AS right_order FROM gp GROUP BY 1, 2, 3),
tt AS (SELECT scheduleid, round, count(*) FILTER (team_slot <> 'UNKNOWN') AS teams, count(*) FILTER (team_slot <> 'UNKNOWN' AND n <> 5) AS uneven, count(*) FILTER (team_slot <> 'UNKNOWN' AND blank) AS blank, count(*) FILTER (team_slot <> 'UNKNOWN' AND NOT blank AND NOT right_order) AS odd FROM team GROUP BY 1, 2),
oo AS (SELECT scheduleid, round, count(*) AS n, count(DISTINCT playerid) AS ids, count(DISTINCT coalesce(hero_id, -1)) AS heroes, count(*) FILTER (team_slot = 'UNKNOWN') AS lost, count(*) FILTER (playerid = '') AS no_id, count(*) FILTER (hero_id IS NULL) AS no_hero FROM gp GROUP BY 1, 2),
ff AS (SELECT r.*, no_id, no_hero, CASE WHEN n IS NULL THEN ['NO_LINEUP'] ELSE list_sort(list_filter([CASE WHEN n <> 10 THEN 'PLAYER_COUNT_' || n END, CASE WHEN ids <> n THEN 'DUPLICATE_PLAYER_IN_GAME' END, CASE WHEN heroes <> n THEN 'DUPLICATE_HERO_IN_GAME' END, CASE WHEN lost > 0 THEN 'PLAYER_TEAM_UNKNOWN' END,
 CASE WHEN teams <> 2 OR uneven > 0 THEN 'NOT_5V5' END, CASE WHEN blank > 0 THEN 'POSITION_UNLABELED' END, CASE WHEN odd > 0 THEN 'POSITION_NOT_1_TO_5' END], lambda x: x IS NOT NULL)) END AS list
 FROM rounds r LEFT JOIN oo USING (scheduleid, round) LEFT JOIN tt USING (scheduleid, round))"""


def flagged(spark, sf):
    """Every response, parsed once, with what is wrong with its games."""
    return K.parsed_responses(details(spark, sf), R.DETAIL, R.UNKNOWN, by_number=True)


@query("p09_lineup_flags", "appearances", f"WITH {FLAGS} SELECT scheduleid, round, array_to_string(list, '|') AS flags FROM ff")
def p09(spark, sf):
    return K.lineup_flags(flagged(spark, sf)).select("scheduleid", "round", "flags")


@query("p10_game_flags", "appearances", f"""
WITH {FLAGS}, m AS (SELECT DISTINCT scheduleid, team_slot FROM (SELECT scheduleid, 'S' || nation_a AS team_slot FROM rounds UNION ALL SELECT scheduleid, 'S' || nation_b FROM rounds) WHERE scheduleid % 29 <> 0)
SELECT ff.scheduleid, round, 'C' || m.team_slot AS winner, array_to_string(list_sort(list_distinct(list_concat(CASE WHEN no_hero > 0 THEN list_filter(list, lambda x: x <> 'DUPLICATE_HERO_IN_GAME') ELSE list END,
 list_filter([CASE WHEN win_team_slot = '' THEN 'WINNER_MISSING' WHEN m.team_slot IS NULL THEN 'WINNER_SLOT_UNMAPPED' END, CASE WHEN no_id > 0 THEN 'PLAYER_ID_MISSING' END, CASE WHEN no_hero > 0 THEN 'HERO_MISSING' END], lambda x: x IS NOT NULL)))), '|') AS flags
FROM ff LEFT JOIN m ON m.scheduleid = ff.scheduleid AND m.team_slot = ff.win_team_slot""")
def p10(spark, sf):
    """The map from slots to teams is unknown for some series."""
    s = A.series(spark, sf).where("series_id % 29 <> 0").select(F.col("series_id").alias("scheduleid"), F.explode(F.array_distinct(F.array(F.concat(F.lit("S"), F.col("nation_a")), F.concat(F.lit("S"), F.col("nation_b"))))).alias("team_slot"))
    return R.game_flags(K.lineup_flags(flagged(spark, sf)), s.withColumn("canonical_id", F.concat(F.lit("C"), F.col("team_slot"))))


@query("s16_latest_across_stores", "", """
WITH r AS (SELECT user_id AS key, event_id AS id, ts, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS store FROM events WHERE event_type <> 'error')
SELECT key, id, store FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, store, id) AS n FROM r) WHERE n = 1""")
def s16(spark, sf):
    e = A.table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").alias("at"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("http"), F.lit(0).alias("result"))
    return R.latest_across(e.where("id % 3 <> 0"), e.where("id % 3 = 0")).select("key", "id", "store")


def _team_bodies(spark, sf):
    s = A.table(spark, sf, "supplier").join(A.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    p = F.struct(F.col("s_suppkey").cast("string").alias("playerid"), F.when(F.col("s_suppkey") % 5 > 0, F.col("s_name")).alias("player_name"), (F.col("s_suppkey") % 5 + 1).cast("int").alias("position"))
    t = s.groupBy("n_regionkey", "n_nationkey", "n_name").agg(F.array_sort(F.collect_list(p)).alias("player_list"))
    t = t.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").cast("string").alias("teamid"), F.col("n_name").alias("team_name"), "player_list"))).alias("data"))
    return t.select(F.col("n_regionkey").alias("season"), F.to_json(F.struct(F.lit(0).alias("result"), "data")).alias("body"))


@query("s19_team_lists", "", "SELECT n_regionkey AS season, CAST(n_nationkey AS VARCHAR) AS team_slot, n_name AS team_name, CAST(s_suppkey AS VARCHAR) AS playerid, CASE WHEN s_suppkey % 5 > 0 THEN s_name ELSE '' END AS player_name, CAST(s_suppkey % 5 + 1 AS INTEGER) AS position FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def s19(spark, sf):
    return R.team_lists(_team_bodies(spark, sf))


def _combo_bodies(spark, sf):
    e = A.draft_events(spark, sf).where("kind = 'P' and side = 0")
    m = e.groupBy("team", "series_id", "game_number", "draft").agg(F.array_sort(F.collect_list(F.struct(F.col("seq").alias("order"), F.col("hero").alias("hero_id")))).alias("p"))
    m = m.select("team", F.struct(F.concat(F.col("draft"), F.lit("_0")).alias("battle_id"), F.col("series_id").cast("string").alias("schedule_id"), F.col("game_number").alias("match_num"), F.transform("p", lambda x: F.struct(x["hero_id"].alias("hero_id"), x["order"].alias("order"))).alias("bp_picks_left")).alias("m"), F.floor(F.col("draft") / 100_000).alias("page"))  # a thousand series a page
    t = m.groupBy("team", "page").agg(F.collect_list("m").alias("matches"))
    return t.select(F.to_json(F.struct(F.lit(0).alias("result"), F.array(F.struct(F.col("team").cast("string").alias("team_id"), "matches")).alias("data"))).alias("body"))


@query("s19_combo_matches", "draft_events", "SELECT CAST(team AS VARCHAR) AS team_slot, draft || '_0' AS battle_id, CAST(series_id AS VARCHAR) AS scheduleid, CAST(game_number AS INTEGER) AS match_num, string_agg(hero || ':' || seq, '|' ORDER BY seq) AS picks FROM draft_events WHERE kind = 'P' AND side = 0 GROUP BY team, series_id, game_number, draft")
def s19b(spark, sf):
    """Pages of matches per team: JSON bodies of bounded size."""
    return R.combo_matches(_combo_bodies(spark, sf))


@query("s20_routed_tables", "draft_events", "SELECT 'getTeamList' AS endpoint, count(*) AS rows FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'getSeasonHeroComboMatches', count(*) FROM (SELECT DISTINCT draft FROM draft_events)")
def s20(spark, sf):
    """One store with responses of several endpoints; each goes to its parser."""
    store = _team_bodies(spark, sf).select(F.lit("getTeamList").alias("endpoint"), F.col("season").cast("string").alias("season"), "body").unionByName(_combo_bodies(spark, sf).select(F.lit("getSeasonHeroComboMatches").alias("endpoint"), F.lit("").alias("season"), "body"))
    parts = {"getTeamList": R.team_lists, "getSeasonHeroComboMatches": R.combo_matches}
    out = None
    for endpoint, parse in parts.items():
        n = parse(store.where(F.col("endpoint") == endpoint)).agg(F.count("*").alias("rows")).select(F.lit(endpoint).alias("endpoint"), "rows")
        out = n if out is None else out.unionByName(n)
    return out


_STAGE = "CASE WHEN series_id % 31 = 0 THEN '' ELSE stage END"


def schedules(spark, sf):
    """(name, body): pages of schedule records per season; one response reports an error."""
    s = A.series(spark, sf)
    rec = F.struct(F.col("series_id").cast("string").alias("scheduleid"), F.col("season").alias("seasonid"), F.expr(_STAGE).alias("stage_name"), F.col("status").alias("schedule_status"), (F.col("t") * 3600).alias("start_timestamp"), F.col("team_a").alias("team_a_name"), F.col("team_b").alias("team_b_name"), F.col("score_a").alias("team_a_score"), F.col("score_b").alias("team_b_score"))
    pages = s.groupBy("season", (F.col("series_id") % 16).alias("page")).agg(F.collect_list(rec).alias("list"))
    good = pages.select(F.concat_ws("_", F.lit("schedule"), "season", "page").alias("name"), F.to_json(F.struct(F.lit(0).alias("result"), F.lit("ok").alias("msg"), F.struct("list").alias("data"))).alias("body"))
    return good.unionByName(spark.range(1).select(F.lit("schedule_none").alias("name"), F.lit('{"result":10010001,"msg":"unknown season"}').alias("body")))


STAGED = f"""staged AS (SELECT CAST(series_id AS VARCHAR) AS series_id, season, {_STAGE} AS stage, t, strftime(TIMESTAMP '1970-01-01' + to_hours(CAST(t AS INTEGER)) + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS start_time_raw, CAST(status AS INTEGER) AS status,
 CASE WHEN status = 4 THEN 'COMPLETED' ELSE 'NOT_COMPLETED_STATUS_' || status END AS status_label, team_a AS raw_team_a, team_b AS raw_team_b, CASE WHEN status = 4 THEN score_a END AS score_a, CASE WHEN status = 4 THEN score_b END AS score_b,
 array_to_string(list_filter([CASE WHEN {_STAGE} = '' THEN 'STAGE_NAME_MISSING' END, CASE WHEN status = 4 AND score_a = score_b THEN 'COMPLETED_WITHOUT_DECISIVE_SCORE' END, CASE WHEN status <> 4 AND (score_a <> 0 OR score_b <> 0) THEN 'NONZERO_SCORE_BEFORE_COMPLETION' END], lambda x: x IS NOT NULL), '|') AS flags,
 sha256('{{"schedule_status":' || status || ',"scheduleid":"' || series_id || '","seasonid":"' || season || '","stage_name":"' || {_STAGE} || '","start_timestamp":' || (t * 3600) || ',"team_a_name":"' || team_a || '","team_a_score":' || score_a || ',"team_b_name":"' || team_b || '","team_b_score":' || score_b || '}}') AS raw_record_hash FROM series)"""


@query("s17_staging", "series", f"WITH {STAGED} SELECT series_id, season, stage, start_time_raw, status, status_label, raw_team_a, raw_team_b, score_a, score_b, raw_record_hash FROM staged")
def s17(spark, sf):
    return R.staging(schedules(spark, sf)).drop("name", "flags")


@query("s17_request_summary", "series", "SELECT 'schedule_' || season || '_' || series_id % 16 AS name, CAST(0 AS INTEGER) AS result, 'ok' AS msg, CAST(count(*) AS INTEGER) AS records FROM series GROUP BY season, series_id % 16 UNION ALL SELECT 'schedule_none', 10010001, 'unknown season', NULL")
def s17s(spark, sf):
    return R.request_summary(schedules(spark, sf))


@query("p11_staging_flags", "series", f"WITH {STAGED} SELECT series_id, flags FROM staged")
def p11(spark, sf):
    return R.staging(schedules(spark, sf)).select("series_id", "flags")


@query("x01_staging_series", "series", f"""
WITH {STAGED}, l AS (SELECT *, CASE WHEN status = 4 AND score_a <> score_b THEN 'COMPLETED' WHEN status = 4 THEN 'FINISHED_NO_DECISIVE_SCORE' ELSE 'NOT_FINISHED' END AS label_flag FROM staged)
SELECT series_id, season, stage, raw_team_a AS team_a, raw_team_b AS team_b, score_a, score_b, label_flag, CASE WHEN label_flag = 'COMPLETED' THEN CASE WHEN score_a > score_b THEN raw_team_a ELSE raw_team_b END END AS winner_team FROM l""")
def x01(spark, sf):
    return R.staging_as_series(R.staging(schedules(spark, sf)))


@query("j09_staging_merge", "series registry", f"""
WITH {STAGED}, n AS (SELECT observed_name, canonical_id FROM registry WHERE review_status = 'VERIFIED')
SELECT s.series_id, a.canonical_id AS cid_a, b.canonical_id AS cid_b, raw_record_hash, 'schedule_' || season || '_' || CAST(s.series_id AS BIGINT) % 16 AS raw_source_file FROM staged s LEFT JOIN n a ON a.observed_name = raw_team_a LEFT JOIN n b ON b.observed_name = raw_team_b""")
def j09(spark, sf):
    """Staged records with canonical ids, the file and the hash they come from."""
    s, n = R.staging(schedules(spark, sf)), A.registry(spark, sf).where("review_status = 'VERIFIED'")
    a, b = n.select(F.col("observed_name").alias("raw_team_a"), F.col("canonical_id").alias("cid_a")), n.select(F.col("observed_name").alias("raw_team_b"), F.col("canonical_id").alias("cid_b"))
    return s.join(a, "raw_team_a", "left").join(b, "raw_team_b", "left").select("series_id", "cid_a", "cid_b", "raw_record_hash", F.col("name").alias("raw_source_file"))


@query("s21_snapshot_schedules", "series", "SELECT CAST(series_id AS VARCHAR) AS scheduleid, min('schedule_' || season || '_' || series_id % 16) AS first_file FROM series GROUP BY 1")
def s21(spark, sf):
    """Records of all files, the first occurrence of each id by file name; a refreshed copy of half of the files is read as well."""
    s = schedules(spark, sf)
    again = s.withColumn("name", F.concat("name", F.lit("_again")))
    rows = s.unionByName(again).select("name", F.posexplode(F.from_json("body", R.SCHEDULE)["data"]["list"]).alias("place", "r"))
    return rows.groupBy(F.col("r.scheduleid").alias("scheduleid")).agg(F.min_by("name", F.struct("name", "place")).alias("first_file"))


@query("s28_team_lookups", "series registry", """
SELECT canonical_id AS team_id, count(*) AS fixtures, count(*) FILTER (flip) AS flipped FROM (
 SELECT r.canonical_id, FALSE AS flip FROM series s JOIN registry r ON r.observed_name = s.team_a UNION ALL SELECT r.canonical_id, TRUE FROM series s JOIN registry r ON r.observed_name = s.team_b) GROUP BY 1""")
def s28(spark, sf):
    """Fixtures of each team from its own side: sides are flipped where it is the second named."""
    s, r = B.long_form(A.series(spark, sf)), A.registry(spark, sf)
    return s.join(F.broadcast(r), F.col("team") == F.col("observed_name")).groupBy(F.col("canonical_id").alias("team_id")).agg(F.count("*").alias("fixtures"), F.count_if(F.col("side") == "b").alias("flipped"))  # the registry is a list of reviewed names
