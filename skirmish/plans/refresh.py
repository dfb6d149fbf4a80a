"""Queries of a refresh's audit: inventory of seasons, what is missing, venues, comparisons before and after, problems of the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.rounding import exact_mean, exact_mean_sql, rounded, rounded_sql
from ..operators import backbone as B
from ..sources import adapter as A
from . import design as D
from .backbone import DIFF, LABEL, LONG, _refreshed
from .base import query
from .names import CITIES, _list

PROSPECTIVE = 262_968


@query("a18_season_inventory", "series", f"""
SELECT season, min(t) AS earliest, max(t) AS latest, count(*) AS total_series, count(*) FILTER (status = 4) AS completed_series, count(*) FILTER (status <> 4) AS scheduled_unplayed_series, array_to_string(list_sort(list(DISTINCT stage)), '|') AS stages_present,
 (SELECT count(DISTINCT team) FROM ({LONG}) l WHERE l.season = s.season) AS unique_teams, (SELECT string_agg(DISTINCT team, '|' ORDER BY team) FROM ({LONG}) l WHERE l.season = s.season) AS teams,
 concat_ws('; ', CASE WHEN count(*) FILTER (status <> 4) > 0 AND max(t) FILTER (status = 4) > min(t) FILTER (status <> 4) THEN 'unplayed series lie before played ones' END, CASE WHEN max(t) - min(t) < 150 * 24 THEN 'season is shorter than its half-year' END) AS metadata_conflict FROM series s GROUP BY season""")
def a18(spark, sf):
    """A row per season: extent, counts, stages, teams, and what contradicts itself. Teams are a season's, which the registry bounds."""
    s = A.series(spark, sf)
    done = F.col("status") == 4
    early = F.when((F.count_if(~done) > 0) & (F.max(F.when(done, F.col("t"))) > F.min(F.when(~done, F.col("t")))), "unplayed series lie before played ones")
    short = F.when(F.max("t") - F.min("t") < 150 * 24, "season is shorter than its half-year")
    own = s.groupBy("season").agg(F.min("t").alias("earliest"), F.max("t").alias("latest"), F.count("*").alias("total_series"), F.count_if(done).alias("completed_series"), F.count_if(~done).alias("scheduled_unplayed_series"), F.array_join(F.array_sort(F.collect_set("stage")), "|").alias("stages_present"), F.concat_ws("; ", early, short).alias("metadata_conflict"))
    teams = B.long_form(s).groupBy("season").agg(F.array_sort(F.collect_set("team")).alias("x"))
    return own.join(teams, "season").select(*own.columns, F.size("x").cast("long").alias("unique_teams"), F.array_join("x", "|").alias("teams"))


_NAMES = "un AS (SELECT team AS name, l.season, l.t FROM ({LONG}) l JOIN registry r ON r.observed_name = l.team AND r.review_status <> 'VERIFIED')".replace("{LONG}", LONG)


@query("a20_missing_manifest", "series registry", f"""
WITH {_NAMES}, pr AS (SELECT season, count(DISTINCT (least(team_a, team_b), greatest(team_a, team_b))) AS met FROM series WHERE team_a <> team_b GROUP BY 1), tm AS (SELECT season, count(DISTINCT team) AS n FROM ({LONG}) GROUP BY 1)
SELECT season, 'ALL' AS stage, min(t) AS first_t, max(t) AS last_t, '' AS team, 'result' AS missing_field, count(*) AS n, 'not yet played: prospective, never a label' AS reason FROM series WHERE t >= {PROSPECTIVE} GROUP BY season
UNION ALL SELECT season, 'ALL', NULL, NULL, '', 'series', n * (n - 1) // 2 - coalesce(met, 0), 'pairs of teams that have not met' FROM tm LEFT JOIN pr USING (season) WHERE n * (n - 1) // 2 > coalesce(met, 0)
UNION ALL SELECT season, stage, min(t), max(t), '', 'stage_name', count(*), 'stage is not specified in the source; not filled' FROM series WHERE stage = '4-NOT SPECIFIED' GROUP BY season, stage
UNION ALL SELECT string_agg(DISTINCT season, '|' ORDER BY season), 'ALL', min(t), max(t), name, 'canonical team identity', count(*), 'observed name is not reviewed' FROM un GROUP BY name
UNION ALL SELECT season, 'ALL', min(t), max(t), '', 'decisive score', count(*), 'finished without a decisive score' FROM series WHERE ({LABEL}) = 'FINISHED_NO_DECISIVE_SCORE' GROUP BY season
UNION ALL SELECT season, 'ALL', min(t), max(t), '', 'not ingested', count(*), 'before the benchmark universe' FROM series WHERE season < 'L1993' GROUP BY season""")
def a20(spark, sf):
    """What a reader of the table must know to be missing: six kinds of gaps, each an aggregate, in one table."""
    s = A.series(spark, sf)
    cols = lambda stage, team, field, n, reason, lo=F.min("t"), hi=F.max("t"): [stage.alias("stage"), lo.alias("first_t"), hi.alias("last_t"), team.alias("team"), F.lit(field).alias("missing_field"), n.cast("long").alias("n"), F.lit(reason).alias("reason")]
    every, none, some, nothing = F.lit("ALL"), F.lit(""), F.count("*"), F.lit(None).cast("long")
    by = lambda rows, field, reason: rows.groupBy("season").agg(*cols(every, none, field, some, reason))
    open_ = by(s.where(F.col("t") >= PROSPECTIVE), "result", "not yet played: prospective, never a label")
    c = B.coverage(s).where("met < expected").select("season", *cols(every, none, "series", F.col("expected") - F.col("met"), "pairs of teams that have not met", nothing, nothing))
    stage = s.where("stage = '4-NOT SPECIFIED'").groupBy("season", F.col("stage").alias("st")).agg(*[x for x in cols(F.max("stage"), none, "stage_name", some, "stage is not specified in the source; not filled")]).drop("st")
    unknown = A.registry(spark, sf).where("review_status <> 'VERIFIED'").select(F.col("observed_name").alias("team"))
    names = B.long_form(s).join(unknown, "team").groupBy(F.col("team").alias("nm")).agg(F.array_join(F.array_sort(F.collect_set("season")), "|").alias("season"), *cols(every, F.max("team"), "canonical team identity", some, "observed name is not reviewed")).drop("nm")
    draws = by(B.labelled(s).where("label_flag = 'FINISHED_NO_DECISIVE_SCORE'"), "decisive score", "finished without a decisive score")
    older = by(s.where("season < 'L1993'"), "not ingested", "before the benchmark universe")
    out = open_
    for x in (c, stage, names, draws, older):
        out = out.unionByName(x)
    return out


_CITY = lambda n: f"{_list(CITIES)}[{n} % 5 + 1]"


@query("j11_venue_relation", "series", f"""
WITH v AS (SELECT season, CAST(score_a > score_b AS INTEGER) AS won, {_CITY('nation_a')} AS ca, {_CITY('nation_b')} AS cb, CASE WHEN series_id % 6 = 5 THEN NULL ELSE {_CITY('series_id')} END AS place FROM series WHERE ({LABEL}) = 'COMPLETED')
SELECT season, CASE WHEN place IS NULL THEN 'VENUE_NOT_RECORDED' WHEN ca = place AND cb <> place THEN 'TEAM_A_CITY_HOSTS' WHEN cb = place AND ca <> place THEN 'TEAM_B_CITY_HOSTS' WHEN ca = place AND cb = place THEN 'BOTH_SAME_CITY' ELSE 'NEITHER_CITY_HOSTS' END AS venue_relation,
 count(*) AS n, CAST(sum(won) AS BIGINT) AS team_a_wins, {exact_mean_sql('won')} AS team_a_win_rate FROM v GROUP BY 1, 2""")
def j11(spark, sf):
    """Whose city a series was played in, and how side a did."""
    city = lambda n: F.element_at(F.array(*map(F.lit, CITIES)), (n % 5 + 1).cast("int"))
    s = B.labelled(A.series(spark, sf)).where("labelled").select("season", (F.col("score_a") > F.col("score_b")).cast("int").alias("won"), city(F.col("nation_a")).alias("ca"), city(F.col("nation_b")).alias("cb"), F.when(F.col("series_id") % 6 != 5, city(F.col("series_id"))).alias("place"))
    a, b = F.col("ca") == F.col("place"), F.col("cb") == F.col("place")
    kind = F.when(F.col("place").isNull(), "VENUE_NOT_RECORDED").when(a & ~b, "TEAM_A_CITY_HOSTS").when(b & ~a, "TEAM_B_CITY_HOSTS").when(a & b, "BOTH_SAME_CITY").otherwise("NEITHER_CITY_HOSTS")
    return s.groupBy("season", kind.alias("venue_relation")).agg(F.count("*").alias("n"), F.sum("won").alias("team_a_wins"), exact_mean(F.col("won")).alias("team_a_win_rate"))


_RATE = lambda t: f"SELECT season, count(*) AS n, {exact_mean_sql('CAST(score_a > score_b AS INTEGER)')} AS rate FROM {t} WHERE ({LABEL}) = 'COMPLETED' AND season <> '{{}}' GROUP BY season"


@query("j14_before_after", "series", f"""
WITH {DIFF}, b AS ({_RATE('series').format('L1998S2')}), f AS ({_RATE('neu').format('L1992S1')})
SELECT coalesce(b.season, f.season) AS season, b.n AS n_before, f.n AS n_after, b.rate AS rate_before, f.rate AS rate_after, {rounded_sql('f.rate - b.rate')} AS change, CASE WHEN b.season IS NULL THEN 'ADDED' WHEN f.season IS NULL THEN 'REMOVED' WHEN b.n IS NOT DISTINCT FROM f.n AND b.rate IS NOT DISTINCT FROM f.rate THEN 'UNCHANGED' ELSE 'CHANGED' END AS status FROM b FULL JOIN f ON b.season = f.season""")
def j14(spark, sf):
    """A benchmark's table before and after a refresh, aligned by season from both sides."""
    s = A.series(spark, sf)

    def table(rows, out, suffix):
        per = B.labelled(rows).where("labelled").where(F.col("season") != out).groupBy("season").agg(F.count("*").alias(f"n_{suffix}"), exact_mean((F.col("score_a") > F.col("score_b")).cast("int")).alias(f"rate_{suffix}"))
        return per.withColumn(f"in_{suffix}", F.lit(True))

    x = table(s, "L1998S2", "before").join(table(_refreshed(s), "L1992S1", "after"), "season", "full")
    same = F.col("n_before").eqNullSafe(F.col("n_after")) & F.col("rate_before").eqNullSafe(F.col("rate_after"))
    status = F.when(F.col("in_before").isNull(), "ADDED").when(F.col("in_after").isNull(), "REMOVED").when(same, "UNCHANGED").otherwise("CHANGED")
    return x.select("season", "n_before", "n_after", "rate_before", "rate_after", rounded(F.col("rate_after") - F.col("rate_before")).alias("change"), status.alias("status"))


@query("a15_registry_problems", "series registry", """
WITH r AS (SELECT * FROM registry UNION ALL SELECT observed_name, canonical_id, 'PENDING' FROM registry WHERE observed_name LIKE '%.B'), p AS (SELECT 'review_status has disallowed values' AS problem, review_status AS what FROM r WHERE review_status NOT IN ('VERIFIED', 'UNREVIEWED', 'REJECTED') UNION SELECT 'duplicate observed_name rows', observed_name FROM r GROUP BY observed_name HAVING count(*) > 1
 UNION SELECT 'UNREVIEWED rows with canonical_team_id', observed_name FROM r WHERE review_status = 'UNREVIEWED' AND canonical_id <> '' UNION SELECT 'names of series without a row', team FROM (SELECT team_a AS team FROM series UNION SELECT team_b FROM series) WHERE team NOT IN (SELECT observed_name FROM r))
SELECT problem, count(*) AS n, array_to_string((list(what ORDER BY what))[1:5], '; ') AS examples FROM p GROUP BY problem""")
def a15(spark, sf):
    """Problems of a registry of names, each with its first five examples; a name is a row, so examples are few names."""
    reg = A.registry(spark, sf)
    r = reg.unionByName(reg.where("observed_name like '%.B'").withColumn("review_status", F.lit("PENDING")))
    say = lambda rows, problem, what: rows.select(F.lit(problem).alias("problem"), F.col(what).alias("what"))
    names = A.series(spark, sf).select(F.explode(F.array("team_a", "team_b")).alias("observed_name")).distinct()
    p = say(r.where("review_status not in ('VERIFIED', 'UNREVIEWED', 'REJECTED')"), "review_status has disallowed values", "review_status").unionAll(say(r.groupBy("observed_name").count().where("count > 1"), "duplicate observed_name rows", "observed_name"))
    p = p.unionAll(say(r.where("review_status = 'UNREVIEWED' and canonical_id <> ''"), "UNREVIEWED rows with canonical_team_id", "observed_name")).unionAll(say(names.join(r, "observed_name", "left_anti"), "names of series without a row", "observed_name"))
    return p.distinct().groupBy("problem").agg(F.count("*").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_list("what")), 1, 5), "; ").alias("examples"))


@query("a50_team_diagnostic", "series", f"""
WITH {D.DESIGN}, o AS (SELECT series_id, t, a AS team, y AS won, p FROM design UNION ALL SELECT series_id, t, b, 1 - y, 1 - p FROM design)
SELECT team, count(*) AS n, CAST(sum(won) AS BIGINT) AS wins, {exact_mean_sql('won')} AS win_rate, {exact_mean_sql('p')} AS mean_p, {rounded_sql('arg_min(p, (t, series_id))')} AS first_p, {rounded_sql('arg_max(p, (t, series_id))')} AS last_p, {exact_mean_sql('(-ln(greatest(1e-6, least(1 - 1e-6, CASE WHEN won = 1 THEN p ELSE 1 - p END))))')} AS log_loss FROM o GROUP BY team""")
def a50(spark, sf):
    """Per team: its record, what was forecast for it, first and last, and the forecasts' loss."""
    d = D.design(spark, sf)
    side = F.explode(F.array(F.struct(F.col("a").alias("team"), F.col("y").alias("won"), F.col("p").alias("p")), F.struct(F.col("b").alias("team"), (1 - F.col("y")).alias("won"), (1 - F.col("p")).alias("p"))))
    o = d.select("series_id", "t", side.alias("x")).select("series_id", "t", "x.*")
    at = F.struct("t", "series_id")
    return o.groupBy("team").agg(F.count("*").alias("n"), F.sum("won").alias("wins"), exact_mean(F.col("won")).alias("win_rate"), exact_mean(F.col("p")).alias("mean_p"), rounded(F.min_by("p", at)).alias("first_p"), rounded(F.max_by("p", at)).alias("last_p"), exact_mean(-F.ln(C.clip(F.when(F.col("won") == 1, F.col("p")).otherwise(1 - F.col("p"))))).alias("log_loss"))
