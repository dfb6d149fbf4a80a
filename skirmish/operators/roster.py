"""Raw JSON responses to typed rows: games, players, line-up flags, schedules with their flags. Nested arrays are exploded with
explicit schemas; what belongs to one response is decided inside its row, without a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DETAIL = """result int, data struct<players: array<struct<playerid: string, team_id: string, player_name: string, player_name_short: string, position: int>>,
 round_details: array<struct<round: int, win_team: string, vid: string, players: array<struct<playerid: string, position: int, hero_id: int, hero_name: string>>>>>"""
TEAMS = "result int, data array<struct<teamid: string, team_name: string, player_list: array<struct<playerid: string, player_name: string, position: int>>>>"
COMBOS = "result int, data array<struct<team_id: string, matches: array<struct<battle_id: string, schedule_id: string, match_num: int, bp_picks_left: array<struct<hero_id: int, `order`: int>>>>>>"
SCHEDULE = "result int, msg string, data struct<list: array<struct<scheduleid: string, seasonid: string, stage_name: string, schedule_status: int, start_timestamp: bigint, team_a_name: string, team_b_name: string, team_a_score: int, team_b_score: int>>>"
UNKNOWN = "UNKNOWN"


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def latest_across(*stores: DataFrame) -> DataFrame:
    """The latest good response (http 200, result 0) of each key over several stores; of equal times the first store's."""
    rows = None
    for n, s in enumerate(stores):
        s = s.withColumn("store", F.lit(n))
        rows = s if rows is None else rows.unionByName(s)
    w = Window.partitionBy("key").orderBy(F.desc("at"), "store", "id")
    return rows.where("http = 200 and result = 0").withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def series_players(responses: DataFrame) -> DataFrame:
    """(scheduleid, playerid, team_slot, player_name, handle, position) of the players each detail response lists."""
    d = responses.select("scheduleid", F.explode(F.from_json("body", DETAIL)["data"]["players"]).alias("p")).select("scheduleid", "p.*")
    return d.select("scheduleid", _text("playerid").alias("playerid"), _text("team_id").alias("team_slot"), _text("player_name").alias("player_name"), _text("player_name_short").alias("handle"), "position")


def detail_games(responses: DataFrame) -> DataFrame:
    """(scheduleid, round, win_team_slot, has_game_vid, n_players): a row per round."""
    d = responses.select("scheduleid", F.explode(F.from_json("body", DETAIL)["data"]["round_details"]).alias("g")).select("scheduleid", "g.*")
    return d.select("scheduleid", "round", _text("win_team").alias("win_team_slot"), (_text("vid") != "").alias("has_game_vid"), F.coalesce(F.size("players"), F.lit(0)).alias("n_players"))


def game_players(responses: DataFrame) -> DataFrame:
    """A row per round and player; the team is the player's only one in the response's list, else UNKNOWN."""
    d = responses.select("scheduleid", F.from_json("body", DETAIL)["data"].alias("d")).select("scheduleid", F.col("d.players").alias("listed"), F.explode("d.round_details").alias("g"))
    d = d.select("scheduleid", "listed", "g.round", F.posexplode("g.players").alias("place", "p"))
    slots = F.array_distinct(F.transform(F.filter(F.coalesce("listed", F.expr("array()")), lambda x: F.coalesce(x["playerid"], F.lit("")) == F.coalesce(F.col("p.playerid"), F.lit(""))), lambda x: F.coalesce(x["team_id"], F.lit(""))))
    slot = F.when(F.size(slots) == 1, F.element_at(slots, 1)).otherwise(UNKNOWN)
    return d.select("scheduleid", "round", (F.col("place") + 1).alias("place"), F.coalesce("p.playerid", F.lit("")).alias("playerid"), slot.alias("team_slot"), "p.position", "p.hero_id", F.coalesce("p.hero_name", F.lit("")).alias("hero_name"))


def lineup_flags(games: DataFrame, players: DataFrame) -> DataFrame:
    """(scheduleid, round, flags): what is wrong with a game's line-up, sorted and joined by '|'; NO_LINEUP without players."""
    known = F.col("team_slot") != UNKNOWN
    team = players.groupBy("scheduleid", "round", "team_slot").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.coalesce("position", F.lit(0)))).alias("pos"))
    unlabelled = F.forall("pos", lambda x: x == 0)
    team = team.groupBy("scheduleid", "round").agg(
        F.count_if(known).alias("teams"), F.count_if(known & (F.col("n") != 5)).alias("uneven"), F.count_if(known & unlabelled).alias("blank"),
        F.count_if(known & ~unlabelled & (F.col("pos") != F.expr("array(1, 2, 3, 4, 5)"))).alias("odd"),
    )
    hero = F.coalesce(F.col("hero_id"), F.lit(-1))
    one = players.groupBy("scheduleid", "round").agg(F.count("*").alias("n"), F.countDistinct("playerid").alias("ids"), F.countDistinct(hero).alias("heroes"), F.count_if(~known).alias("lost"), F.count_if(F.col("playerid") == "").alias("no_id"), F.count_if((F.col("hero_name") == "") | (hero <= 0)).alias("no_hero"))
    x = games.select("scheduleid", "round", "win_team_slot").join(one.join(team, ["scheduleid", "round"]), ["scheduleid", "round"], "left")
    full = F.array(
        F.when(F.col("n") != 10, F.concat(F.lit("PLAYER_COUNT_"), F.col("n").cast("string"))), F.when(F.col("ids") != F.col("n"), "DUPLICATE_PLAYER_IN_GAME"), F.when(F.col("heroes") != F.col("n"), "DUPLICATE_HERO_IN_GAME"),
        F.when(F.col("lost") > 0, "PLAYER_TEAM_UNKNOWN"), F.when((F.col("teams") != 2) | (F.col("uneven") > 0), "NOT_5V5"), F.when(F.col("blank") > 0, "POSITION_UNLABELED"), F.when(F.col("odd") > 0, "POSITION_NOT_1_TO_5"),
    )
    flags = F.when(F.col("n").isNull(), F.array(F.lit("NO_LINEUP"))).otherwise(F.array_sort(F.array_compact(full)))
    return x.select("scheduleid", "round", "win_team_slot", "no_id", "no_hero", flags.alias("list"), F.array_join(flags, "|").alias("flags"))


def game_flags(flagged: DataFrame, slots: DataFrame) -> DataFrame:
    """(scheduleid, round, winner, flags): ``lineup_flags`` with what is missing of the winner, ids and heroes; where heroes are
    missing, equal ones are not reported. ``slots``: (scheduleid, team_slot, canonical_id), two a series."""
    x = flagged.join(slots.withColumnRenamed("team_slot", "win_team_slot"), ["scheduleid", "win_team_slot"], "left")
    more = F.array_compact(F.array(F.when(F.col("win_team_slot") == "", "WINNER_MISSING").when(F.col("canonical_id").isNull(), "WINNER_SLOT_UNMAPPED"), F.when(F.col("no_id") > 0, "PLAYER_ID_MISSING"), F.when(F.col("no_hero") > 0, "HERO_MISSING")))
    kept = F.when(F.col("no_hero") > 0, F.array_remove("list", "DUPLICATE_HERO_IN_GAME")).otherwise(F.col("list"))
    return x.select("scheduleid", "round", F.col("canonical_id").alias("winner"), F.array_join(F.array_sort(F.array_distinct(F.concat(kept, more))), "|").alias("flags"))


def team_lists(responses: DataFrame) -> DataFrame:
    """(season, team_slot, team_name, playerid, player_name, position) of team list responses."""
    t = responses.select("season", F.explode(F.from_json("body", TEAMS)["data"]).alias("t")).select("season", "t.teamid", "t.team_name", F.explode("t.player_list").alias("p"))
    return t.select("season", F.col("teamid").alias("team_slot"), "team_name", F.coalesce("p.playerid", F.lit("")).alias("playerid"), F.coalesce("p.player_name", F.lit("")).alias("player_name"), "p.position")


def combo_matches(responses: DataFrame) -> DataFrame:
    """(team_slot, battle_id, scheduleid, match_num, picks) of hero combination responses; picks are 'hero:order' in order of the list."""
    t = responses.select(F.explode(F.from_json("body", COMBOS)["data"]).alias("t")).select("t.team_id", F.explode("t.matches").alias("m"))
    picks = F.array_join(F.transform(F.coalesce("m.bp_picks_left", F.expr("array()")), lambda x: F.concat_ws(":", x["hero_id"], x["order"])), "|")
    return t.select(F.col("team_id").alias("team_slot"), "m.battle_id", F.col("m.schedule_id").alias("scheduleid"), "m.match_num", picks.alias("picks"))


def staging(responses: DataFrame) -> DataFrame:
    """Schedule responses (name, body) to a row per record with status label, scores only of finished series, flags, and the
    SHA-256 of the record's canonical JSON (keys sorted, no spaces, nulls left out)."""
    r = responses.select("name", F.from_json("body", SCHEDULE).alias("j")).where("j.result = 0").select("name", F.explode("j.data.list").alias("r")).select("name", "r.*")
    done = F.coalesce(F.col("schedule_status") == 4, F.lit(False))
    flags = F.array_compact(F.array(
        F.when(F.trim(_text("stage_name")) == "", "STAGE_NAME_MISSING"), F.when(done & F.col("team_a_score").eqNullSafe(F.col("team_b_score")), "COMPLETED_WITHOUT_DECISIVE_SCORE"),
        F.when(~done & ((F.coalesce("team_a_score", F.lit(0)) != 0) | (F.coalesce("team_b_score", F.lit(0)) != 0)), "NONZERO_SCORE_BEFORE_COMPLETION"),
    ))
    keys = sorted(["scheduleid", "seasonid", "stage_name", "schedule_status", "start_timestamp", "team_a_name", "team_b_name", "team_a_score", "team_b_score"])
    return r.select(
        "name", F.col("scheduleid").alias("series_id"), F.col("seasonid").alias("season"), _text("stage_name").alias("stage"), F.date_format(F.timestamp_seconds(F.col("start_timestamp") + 8 * 3600), "yyyy-MM-dd HH:mm:ss").alias("start_time_raw"),
        F.col("schedule_status").alias("status"), F.when(done, "COMPLETED").otherwise(F.concat(F.lit("NOT_COMPLETED_STATUS_"), F.col("schedule_status").cast("string"))).alias("status_label"),
        F.col("team_a_name").alias("raw_team_a"), F.col("team_b_name").alias("raw_team_b"), F.when(done, F.col("team_a_score")).alias("score_a"), F.when(done, F.col("team_b_score")).alias("score_b"),
        F.array_join(flags, "|").alias("flags"), F.sha2(F.to_json(F.struct(*keys)), 256).alias("raw_record_hash"),
    )


def request_summary(responses: DataFrame) -> DataFrame:
    """(name, result, msg, records): a row per response; records is null where the source reported an error."""
    j = F.from_json("body", SCHEDULE)
    return responses.select("name", j["result"].alias("result"), j["msg"].alias("msg"), F.when(j["result"] == 0, F.coalesce(F.size(j["data"]["list"]), F.lit(0))).alias("records"))


def staging_as_series(staged: DataFrame) -> DataFrame:
    """Staged records in the shape of series; a score before completion is not a conflict here, for such scores are null."""
    a, b = F.col("score_a"), F.col("score_b")
    label = F.when((F.col("status") == 4) & F.coalesce(a != b, F.lit(False)), "COMPLETED").when(F.col("status") == 4, "FINISHED_NO_DECISIVE_SCORE").otherwise("NOT_FINISHED")
    return staged.select("series_id", "season", "stage", F.col("raw_team_a").alias("team_a"), F.col("raw_team_b").alias("team_b"), "score_a", "score_b", label.alias("label_flag"), F.when(label == "COMPLETED", F.when(a > b, F.col("raw_team_a")).otherwise(F.col("raw_team_b"))).alias("winner_team"))
