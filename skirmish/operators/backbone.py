"""The dated backbone: labels, identity resolution, conflicts, inventories, membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def labelled(series: DataFrame) -> DataFrame:
    """Adds decisive, label_flag, labelled and the winner's observed name."""
    a, b = F.col("score_a"), F.col("score_b")
    out = series.withColumn("decisive", C.decisive(a, b)).withColumn("label_flag", C.label_flag(a, b, F.col("status")))
    return out.withColumn("labelled", F.col("label_flag") == "COMPLETED").withColumn("winner_team", F.when(F.col("labelled"), F.when(a > b, F.col("team_a")).otherwise(F.col("team_b"))))


def long_form(series: DataFrame, *extra: str) -> DataFrame:
    """A row per side, in one pass over the input."""
    sides = F.array(F.struct(F.lit("a").alias("side"), F.col("team_a").alias("team"), F.col("team_b").alias("opponent")), F.struct(F.lit("b").alias("side"), F.col("team_b").alias("team"), F.col("team_a").alias("opponent")))
    return series.select("series_id", "season", "t", *extra, F.explode(sides).alias("s")).select("series_id", "season", "t", *extra, "s.side", "s.team", "s.opponent")


def resolved(series: DataFrame, registry: DataFrame) -> DataFrame:
    """Joins canonical ids (VERIFIED names only, one row per name). The registry has a row per name; Spark broadcasts it if small."""
    names = registry.where("review_status = 'VERIFIED' and canonical_id <> ''").groupBy("observed_name").agg(F.max("canonical_id").alias("cid"))
    a = names.select(F.col("observed_name").alias("team_a"), F.col("cid").alias("cid_a"))
    b = names.select(F.col("observed_name").alias("team_b"), F.col("cid").alias("cid_b"))
    return series.join(a, "team_a", "left").join(b, "team_b", "left")


def canonical(series: DataFrame, registry: DataFrame) -> DataFrame:
    """status RESOLVED / UNRESOLVED / CONFLICT. Conflicts: a team twice at one time, or names of one team whose date ranges overlap."""
    s = resolved(labelled(series), registry)
    ids = s.select("series_id", "t", F.explode(F.array(F.struct(F.col("cid_a").alias("cid"), F.col("team_a").alias("name")), F.struct(F.col("cid_b").alias("cid"), F.col("team_b").alias("name")))).alias("x")).select("series_id", "t", "x.*").where("cid is not null")
    twice = ids.groupBy("t", "cid").agg(F.count("*").alias("n")).where("n > 1").select("t", "cid")
    same_time = ids.join(twice, ["t", "cid"], "left_semi").select("series_id").distinct()
    spans = ids.groupBy("cid", "name").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    x, y = spans.alias("x"), spans.alias("y")
    met = x.join(y, (F.col("x.cid") == F.col("y.cid")) & (F.col("x.name") != F.col("y.name")) & (F.col("x.first") <= F.col("y.last")) & (F.col("y.first") <= F.col("x.last")))
    overlapping = met.select(F.col("x.cid").alias("cid"), F.col("x.name").alias("name")).distinct()
    aliased = ids.join(overlapping, ["cid", "name"], "left_semi").select("series_id").distinct()
    out = s.join(same_time.withColumn("simultaneous", F.lit(True)), "series_id", "left").join(aliased.withColumn("overlap", F.lit(True)), "series_id", "left")
    conflict = C.yes(F.col("simultaneous")) | C.yes(F.col("overlap")) | C.yes(F.col("cid_a") == F.col("cid_b"))
    status = F.when(conflict, "CONFLICT").when(F.col("cid_a").isNull() | F.col("cid_b").isNull(), "UNRESOLVED").otherwise("RESOLVED")
    reasons = F.array_compact(F.array(F.col("label_flag"), F.when(C.yes(F.col("simultaneous")), "SIMULTANEOUS_TEAM"), F.when(C.yes(F.col("overlap")), "ALIAS_OVERLAP"), F.when(C.yes(F.col("cid_a") == F.col("cid_b")), "SELF_PLAY")))
    out = out.withColumn("identity_status", status).withColumn("quality", F.array_join(reasons, "|"))
    out = out.withColumn("eligible", F.col("labelled") & (F.col("identity_status") == "RESOLVED"))
    return out.withColumn("y", F.when(F.col("eligible"), (F.col("score_a") > F.col("score_b")).cast("int"))).drop("simultaneous", "overlap")


def ranked(df: DataFrame, time: str = "t", key: str = "series_id") -> DataFrame:
    """Adds batch (dense rank of time) and chronological (1..n by time, key): ranks come from counts per time, so only one row per
    distinct time is ranked in one task."""
    per = df.groupBy(time).agg(F.count("*").alias("n"))
    w = Window.orderBy(time)
    per = per.select(time, F.row_number().over(w).alias("batch"), F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = F.row_number().over(Window.partitionBy(time).orderBy(key))
    return df.withColumn("within", inner).join(per, time).withColumn("chronological", F.col("before") + F.col("within")).drop("before", "within")


def inventory(series: DataFrame) -> DataFrame:
    """Per observed name: series, wins, first and last time, seasons in order of first use."""
    rows = long_form(labelled(series), "winner_team")
    first = rows.groupBy("team", "season").agg(F.min("t").alias("at"))
    seasons = first.groupBy("team").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "season"))), lambda x: x["season"]), "|").alias("seasons"))
    stats = rows.groupBy("team").agg(F.count("*").alias("n_series"), F.count_if(F.col("winner_team") == F.col("team")).alias("wins"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    return stats.join(seasons, "team")


def presence(series: DataFrame) -> DataFrame:
    return long_form(series).groupBy("season", "team").agg(F.count("*").alias("n"), F.countDistinct("opponent").alias("opponents"))


def matrix(series: DataFrame, seasons: list[str]) -> DataFrame:
    """Team by season counts, a fixed list of columns."""
    return presence(series).groupBy("team").pivot("season", seasons).agg(F.sum("n")).na.fill(0)


def season_order(series: DataFrame) -> DataFrame:
    s = series.groupBy("season").agg(F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.count("*").alias("n"))
    return s.withColumn("ordinal", F.row_number().over(Window.orderBy("start_t", "season")))


def boundary_ledger(series: DataFrame) -> DataFrame:
    """Teams that left and arrived between consecutive seasons."""
    sets = presence(series).groupBy("season").agg(F.array_sort(F.collect_set("team")).alias("teams"))
    s = season_order(series).select("season", "ordinal").join(sets, "season")
    w = Window.orderBy("ordinal")
    s = s.withColumn("next_season", F.lead("season").over(w)).withColumn("after", F.lead("teams").over(w)).where("next_season is not null")
    return s.select("season", "next_season", F.array_join(F.array_except("teams", "after"), "|").alias("left_teams"), F.array_join(F.array_except("after", "teams"), "|").alias("arrived_teams"), F.size(F.array_intersect("teams", "after")).alias("stayed"))


def gaps(series: DataFrame) -> DataFrame:
    """Seasons that a name misses between its first and its last."""
    order = season_order(series).select("season", "ordinal")
    has = presence(series).join(order, "season").groupBy("team").agg(F.collect_set("ordinal").alias("have"), F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"))
    miss = F.array_sort(F.array_except(F.sequence("lo", "hi"), "have"))
    return has.select("team", "lo", "hi", F.size(miss).alias("n_missing"), F.array_join(F.transform(miss, lambda x: x.cast("string")), "|").alias("missing"))


def membership(series: DataFrame) -> DataFrame:
    """Season x team: NEW, RETURNING (seen before, not last season) or CONTINUING."""
    order = season_order(series).select("season", "ordinal")
    p = presence(series).join(order, "season")
    w = Window.partitionBy("team").orderBy("ordinal")
    last = F.max("ordinal").over(w.rangeBetween(Window.unboundedPreceding, -1))
    return p.select("season", "team", F.when(last.isNull(), "NEW").when(last == F.col("ordinal") - 1, "CONTINUING").otherwise("RETURNING").alias("entry"), last.alias("previous"))


def rename_candidates(series: DataFrame, max_gap: int = 270 * 24) -> DataFrame:
    """Ordered pairs of names (old ends, new begins within the gap) with the number of opponents they share.

    Names of the registry are few: pairs are made from one row per name, bounded by the gap; they never see series rows.
    """
    inv = long_form(series).groupBy("team").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.collect_set("opponent").alias("met"))
    old = inv.select(F.col("team").alias("old_name"), F.col("last_t").alias("ended"), F.col("met").alias("old_met"), F.floor(F.col("last_t") / max_gap).alias("cell"))
    new = inv.select(F.col("team").alias("new_name"), F.col("first_t").alias("began"), F.col("met").alias("new_met"), F.explode(F.array(F.floor(F.col("first_t") / max_gap), F.floor(F.col("first_t") / max_gap) - 1)).alias("cell"))
    pairs = old.join(new, "cell").where((F.col("began") > F.col("ended")) & (F.col("began") - F.col("ended") <= max_gap) & (F.col("old_name") != F.col("new_name")))
    shared = F.size(F.array_intersect("old_met", "new_met"))
    return pairs.select("old_name", "new_name", (F.col("began") - F.col("ended")).alias("gap"), shared.alias("shared_opponents"), C.yes(F.array_contains("old_met", F.col("new_name"))).alias("played_each_other"))


def coverage(series: DataFrame) -> DataFrame:
    """Per season: pairs of teams that met against all pairs."""
    pairs = series.where("team_a <> team_b").select("season", F.least("team_a", "team_b").alias("x"), F.greatest("team_a", "team_b").alias("y")).distinct().groupBy("season").agg(F.count("*").alias("met"))
    teams = presence(series).groupBy("season").agg(F.count("*").alias("n_teams"))
    expected = F.expr("n_teams * (n_teams - 1) div 2")
    return teams.join(pairs, "season", "left").select("season", "n_teams", expected.alias("expected"), F.coalesce("met", F.lit(0)).alias("met"), F.when(F.coalesce("met", F.lit(0)) == expected, "COMPLETE").otherwise("PARTIAL").alias("coverage"))


def side_diagnostic(series: DataFrame) -> DataFrame:
    """Win rate of side a by season, stage, both, and in all: one pass with grouping sets."""
    s = labelled(series).where("labelled").withColumn("a", (F.col("score_a") > F.col("score_b")).cast("int"))
    out = s.groupingSets([[F.col("season"), F.col("stage")], [F.col("season")], [F.col("stage")], []], F.col("season"), F.col("stage")).agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.sum("a").alias("wins_a"), F.round(F.avg("a"), 6).alias("rate_a"))
    return out.select(F.col("level").cast("int").alias("level"), "season", "stage", "n", "wins_a", "rate_a")


#: The classes of a refreshed row, in order of precedence, and those that a merge takes without a review.
CLASSES = ["TEAM_NAME_CONFLICT", "DATE_CONFLICT", "SCORE_CONFLICT", "RESULT_UPDATED", "STATUS_UPDATED", "EXACT_EXISTING", "NEW_SERIES", "UNMATCHED"]
ACCEPTED = ["RESULT_UPDATED", "STATUS_UPDATED", "EXACT_EXISTING", "NEW_SERIES"]
DIFFED = ["series_id", "season", "stage", "t", "team_a", "team_b", "score_a", "score_b", "status"]


def diff_classes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(series_id, o_series_id, match_method, diff_class, detail, season): a refresh (``new``) against the existing rows (``old``).

    Rows match by id, then by season, day and unordered pair of teams where one row is left on either side. Of matched rows the
    first that holds counts: other teams; another time; both finished with other scores, or a finished one that no longer is; a new
    result; another status; else the row is as it was. The detail says what changed, a changed stage included. Each side is split
    into matched and left rows by one flag join; ids are unique on both sides.
    """
    o, n = old.select(*[F.col(c).alias(f"o_{c}") for c in DIFFED]), new.select(*DIFFED)
    flagged_n = n.join(o.select("o_series_id"), n.series_id == F.col("o_series_id"), "left")
    flagged_o = o.join(n.select("series_id"), o.o_series_id == F.col("series_id"), "left")
    rest_n, rest_o = flagged_n.where("o_series_id is null").drop("o_series_id"), flagged_o.where("series_id is null").drop("series_id")
    key = lambda p: [F.col(f"{p}season").alias("k0"), F.floor(F.col(f"{p}t") / 24).alias("k1"), F.least(f"{p}team_a", f"{p}team_b").alias("k2"), F.greatest(f"{p}team_a", f"{p}team_b").alias("k3")]
    ks = [f"k{i}" for i in range(4)]
    # one row of each side or none: the group's only rows
    both = rest_n.select(*key(""), F.struct(*DIFFED).alias("n"), F.lit(None).cast(f"struct<{', '.join(f'o_{c}:{dict(old.dtypes)[c]}' for c in DIFFED)}>").alias("o")).unionAll(rest_o.select(*key("o_"), F.lit(None).cast(f"struct<{', '.join(f'{c}:{dict(new.dtypes)[c]}' for c in DIFFED)}>"), F.struct(*[f"o_{c}" for c in DIFFED])))
    one = both.groupBy(*ks).agg(F.count("n").alias("cn"), F.count("o").alias("co"), F.max("n").alias("n"), F.max("o").alias("o")).where("cn = 1 and co = 1")
    by_key = one.select("n.*", "o.*", F.lit("FALLBACK_COMPETITION_DATE_TEAMPAIR").alias("match_method"))
    by_id = n.join(o, n.series_id == o.o_series_id).select(*DIFFED, *[f"o_{c}" for c in DIFFED], F.lit("SOURCE_SERIES_ID").alias("match_method"))
    paired = by_id.unionByName(by_key)
    fresh = rest_n.join(by_key.select("series_id"), "series_id", "left_anti").select(*DIFFED, *[F.lit(None).cast(dict(old.dtypes)[c]).alias(f"o_{c}") for c in DIFFED], F.lit("").alias("match_method"))
    gone = rest_o.join(by_key.select("o_series_id"), "o_series_id", "left_anti").select(*[F.lit(None).cast(dict(new.dtypes)[c]).alias(c) for c in DIFFED], *[f"o_{c}" for c in DIFFED], F.lit("").alias("match_method"))
    x = paired.unionByName(fresh).unionByName(gone)
    same = lambda *cs: F.concat_ws("\u001f", *[F.col(c) for c in cs]) == F.concat_ws("\u001f", *[F.col(f"o_{c}") for c in cs])
    was, done, score = C.yes(F.col("o_status") == 4), C.yes(F.col("status") == 4), same("score_a", "score_b")
    text = lambda *parts: F.concat(*[F.lit(p[1:]) if p[0] == "'" else F.col(p).cast("string") for p in parts])
    matched = F.col("match_method") != ""
    rules = [
        ("NEW_SERIES", F.col("o_series_id").isNull(), F.lit("")), ("UNMATCHED", F.col("series_id").isNull(), F.lit("existing row not returned by the refreshed source")),
        ("TEAM_NAME_CONFLICT", ~same("team_a", "team_b"), text("'teams ", "o_team_a", "' vs ", "o_team_b", "' -> ", "team_a", "' vs ", "team_b")), ("DATE_CONFLICT", ~same("t"), text("'start ", "o_t", "' -> ", "t")),
        ("SCORE_CONFLICT", was & done & ~score, text("'score ", "o_score_a", "'-", "o_score_b", "' -> ", "score_a", "'-", "score_b")), ("SCORE_CONFLICT", was & ~done, text("'completed result retracted: status ", "o_status", "' -> ", "status")),
        ("RESULT_UPDATED", ~was & done, text("'status ", "o_status", "' -> 4, score ", "score_a", "'-", "score_b")), ("STATUS_UPDATED", ~same("status"), text("'status ", "o_status", "' -> ", "status")),
    ]
    kind, detail = F.lit("EXACT_EXISTING"), F.lit("")
    for name, holds, says in reversed(rules):
        kind, detail = F.when(holds, name).otherwise(kind), F.when(holds, says).otherwise(detail)
    stage = F.when(matched & ~same("stage"), text("'stage ", "o_stage", "' -> ", "stage"))
    return x.select("series_id", "o_series_id", "match_method", kind.alias("diff_class"), F.concat_ws("; ", F.when(detail != "", detail), stage).alias("detail"), F.coalesce("season", "o_season").alias("season"))


def refreshed(old: DataFrame, new: DataFrame) -> DataFrame:
    """The existing rows with what a refresh may change without a review: new series, results and statuses; conflicts leave the old row."""
    d = diff_classes(old, new).where(F.col("diff_class").isin(ACCEPTED)).select(F.col("series_id").alias("n_id"), "o_series_id")
    take = new.select(*DIFFED).join(d, F.col("series_id") == F.col("n_id")).drop("n_id")
    return old.select(*DIFFED).join(take.select(F.col("o_series_id").alias("series_id")), "series_id", "left_anti").unionByName(take.drop("o_series_id"))


def merged(old: DataFrame, new: DataFrame, season: str) -> DataFrame:
    """Replaces a season: existing rows of other seasons and the refreshed rows of this one."""
    return old.where(F.col("season") != season).unionByName(new.where(F.col("season") == season))


def expanding_folds(series: DataFrame, min_train: int = 1) -> DataFrame:
    """A fold per season: it trains on the labelled rows strictly before the season's first row."""
    order = season_order(series).select("season", "start_t", "ordinal")
    per = labelled(series).where("labelled").groupBy("t", "season").agg(F.count("*").alias("n"))
    train = order.join(per.select(F.col("t").alias("tt"), F.col("n").alias("m")), F.col("tt") < F.col("start_t"), "left").groupBy("season").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n_train"))
    valid = per.groupBy("season").agg(F.sum("n").alias("n_valid"))
    return order.join(train, "season").join(valid, "season", "left").where(F.col("n_train") >= min_train).select("season", "ordinal", "start_t", "n_train", F.coalesce("n_valid", F.lit(0)).alias("n_valid"))
