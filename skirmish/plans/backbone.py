"""Queries of the dated backbone."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import backbone as B
from ..sources import adapter as A
from ..streaming import jobs
from .base import query

LABEL = """CASE WHEN coalesce(score_a <> score_b, FALSE) AND coalesce(status = 4, FALSE) THEN 'COMPLETED' WHEN coalesce(status = 4, FALSE) THEN 'FINISHED_NO_DECISIVE_SCORE'
 WHEN coalesce(score_a <> score_b, FALSE) THEN 'STATUS_SCORE_CONFLICT' ELSE 'NOT_FINISHED' END"""
LONG = "SELECT series_id, season, t, 'a' AS side, team_a AS team, team_b AS opponent FROM series UNION ALL SELECT series_id, season, t, 'b', team_b, team_a FROM series"
PRESENCE = f"SELECT season, team, count(*) AS n, count(DISTINCT opponent) AS opponents FROM ({LONG}) GROUP BY season, team"
ORDER = "SELECT season, min(t) AS start_t, max(t) AS end_t, count(*) AS n, row_number() OVER (ORDER BY min(t), season) AS ordinal FROM series GROUP BY season"
SEASONS = [f"L{y}S{h}" for y in range(1995, 2002) for h in (1, 2)]


@query("p01_series_labels", "series", f"SELECT series_id, season, t, team_a, team_b, score_a, score_b, status, {LABEL} AS label_flag, CASE WHEN ({LABEL}) = 'COMPLETED' THEN CASE WHEN score_a > score_b THEN team_a ELSE team_b END END AS winner_team FROM series")
def p01(spark, sf):
    return B.labelled(A.series(spark, sf)).select("series_id", "season", "t", "team_a", "team_b", "score_a", "score_b", "status", "label_flag", "winner_team")


@query("p14_split_universe", "series", f"SELECT CASE WHEN t >= 262968 THEN 'HOLDOUT' ELSE 'DEV' END AS part, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM series WHERE ({LABEL}) = 'COMPLETED' GROUP BY 1")
def p14(spark, sf):
    s = B.labelled(A.series(spark, sf)).where("labelled")
    return s.groupBy(F.when(F.col("t") >= 262968, "HOLDOUT").otherwise("DEV").alias("part")).agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query("p15_mask_prospective", "series", "SELECT series_id, CASE WHEN t < 262968 THEN score_a END AS score_a, CASE WHEN t < 262968 THEN score_b END AS score_b, t >= 262968 AS prospective FROM series")
def p15(spark, sf):
    late = F.col("t") >= 262968
    return A.series(spark, sf).select("series_id", F.when(~late, F.col("score_a")).alias("score_a"), F.when(~late, F.col("score_b")).alias("score_b"), late.alias("prospective"))


@query("p17_series_format", "series", "SELECT stage, CASE WHEN stage = '1-URGENT' THEN 7 WHEN stage IN ('2-HIGH', '3-MEDIUM') THEN 5 ELSE 3 END AS best_of, count(*) AS n, max(greatest(score_a, score_b)) AS top_score FROM series GROUP BY 1, 2")
def p17(spark, sf):
    return A.series(spark, sf).groupBy("stage", C.best_of(F.col("stage")).alias("best_of")).agg(F.count("*").alias("n"), F.max(F.greatest("score_a", "score_b")).alias("top_score"))


@query("p21_season_warnings", "series", """
SELECT season, regexp_extract(season, '^L(\\d{4})S(\\d)$', 1) AS year, regexp_extract(season, '^L(\\d{4})S(\\d)$', 2) AS half, count(*) AS n, max(t) - min(t) < 150 * 24 AS partial FROM series GROUP BY season""")
def p21(spark, sf):
    pat = r"^L(\d{4})S(\d)$"
    return A.series(spark, sf).groupBy("season").agg(F.count("*").alias("n"), (F.max("t") - F.min("t") < 150 * 24).alias("partial")).select("season", F.regexp_extract("season", pat, 1).alias("year"), F.regexp_extract("season", pat, 2).alias("half"), "n", "partial")


RESOLVED = f"""
reg AS (SELECT observed_name, max(canonical_id) AS cid FROM registry WHERE review_status = 'VERIFIED' AND canonical_id <> '' GROUP BY 1),
res AS (SELECT s.*, {LABEL} AS label_flag, a.cid AS cid_a, b.cid AS cid_b FROM series s LEFT JOIN reg a ON a.observed_name = team_a LEFT JOIN reg b ON b.observed_name = team_b)"""
CANONICAL = RESOLVED + """,
ids AS (SELECT series_id, t, cid_a AS cid, team_a AS name FROM res WHERE cid_a IS NOT NULL UNION ALL SELECT series_id, t, cid_b, team_b FROM res WHERE cid_b IS NOT NULL),
sim AS (SELECT DISTINCT series_id FROM (SELECT series_id, count(*) OVER (PARTITION BY t, cid) AS n FROM ids) WHERE n > 1),
sp AS (SELECT cid, name, min(t) AS lo, max(t) AS hi FROM ids GROUP BY 1, 2),
ov AS (SELECT DISTINCT x.cid, x.name FROM sp x JOIN sp y ON x.cid = y.cid AND x.name <> y.name AND x.lo <= y.hi AND y.lo <= x.hi),
al AS (SELECT DISTINCT series_id FROM ids JOIN ov USING (cid, name)),
canon AS (SELECT res.*, res.series_id IN (SELECT series_id FROM sim) AS simultaneous, res.series_id IN (SELECT series_id FROM al) AS overlap, coalesce(cid_a = cid_b, FALSE) AS self_play FROM res),
canonical AS (SELECT *, CASE WHEN simultaneous OR overlap OR self_play THEN 'CONFLICT' WHEN cid_a IS NULL OR cid_b IS NULL THEN 'UNRESOLVED' ELSE 'RESOLVED' END AS identity_status,
 label_flag || CASE WHEN simultaneous THEN '|SIMULTANEOUS_TEAM' ELSE '' END || CASE WHEN overlap THEN '|ALIAS_OVERLAP' ELSE '' END || CASE WHEN self_play THEN '|SELF_PLAY' ELSE '' END AS quality FROM canon)"""


@query("j01_name_resolution", "series registry", f"WITH {RESOLVED} SELECT series_id, team_a, cid_a, team_b, cid_b FROM res")
def j01(spark, sf):
    return B.resolved(B.labelled(A.series(spark, sf)), A.registry(spark, sf)).select("series_id", "team_a", "cid_a", "team_b", "cid_b")


@query("j03_canonical_series", "series registry", f"WITH {CANONICAL} SELECT series_id, cid_a, cid_b, identity_status, quality, label_flag = 'COMPLETED' AND identity_status = 'RESOLVED' AS eligible, CASE WHEN label_flag = 'COMPLETED' AND identity_status = 'RESOLVED' THEN CAST(score_a > score_b AS INTEGER) END AS y FROM canonical")
def j03(spark, sf):
    return B.canonical(A.series(spark, sf), A.registry(spark, sf)).select("series_id", "cid_a", "cid_b", "identity_status", "quality", "eligible", "y")


@query("a17_canonical_audit", "series registry", f"WITH {CANONICAL} SELECT identity_status, label_flag, count(*) AS n, count(DISTINCT cid_a) AS teams FROM canonical GROUP BY 1, 2")
def a17(spark, sf):
    return B.canonical(A.series(spark, sf), A.registry(spark, sf)).groupBy("identity_status", "label_flag").agg(F.count("*").alias("n"), F.countDistinct("cid_a").alias("teams"))


@query("w01_chronological_order", "series", "SELECT series_id, dense_rank() OVER (ORDER BY t) AS batch, row_number() OVER (ORDER BY t, series_id) AS chronological FROM series")
def w01(spark, sf):
    return B.ranked(A.series(spark, sf)).select("series_id", F.col("batch").cast("long").alias("batch"), F.col("chronological").cast("long").alias("chronological"))


@query("a04_season_order", "series", ORDER)
def a04(spark, sf):
    return B.season_order(A.series(spark, sf)).withColumn("ordinal", F.col("ordinal").cast("long"))


@query("a05_name_inventory", "series", f"""
WITH l AS ({LONG}), w AS (SELECT series_id, CASE WHEN ({LABEL}) = 'COMPLETED' THEN CASE WHEN score_a > score_b THEN team_a ELSE team_b END END AS winner FROM series),
s AS (SELECT team, string_agg(season, '|' ORDER BY began, season) AS seasons FROM (SELECT team, season, min(t) AS began FROM l GROUP BY 1, 2) GROUP BY team)
SELECT l.team, count(*) AS n_series, count(*) FILTER (w.winner = l.team) AS wins, min(l.t) AS first_t, max(l.t) AS last_t, any_value(s.seasons) AS seasons FROM l JOIN w USING (series_id) JOIN s ON s.team = l.team GROUP BY l.team""")
def a05(spark, sf):
    return B.inventory(A.series(spark, sf))


@query("a06_presence", "series", PRESENCE)
def a06(spark, sf):
    return B.presence(A.series(spark, sf))


@query("a07_season_matrix", "series", f"SELECT team, {', '.join(f'CAST(coalesce(sum(n) FILTER (season = {s!r}), 0) AS BIGINT) AS {chr(34)}{s}{chr(34)}' for s in SEASONS)} FROM ({PRESENCE}) GROUP BY team")
def a07(spark, sf):
    return B.matrix(A.series(spark, sf), SEASONS)


@query("a09_boundary_ledger", "series", f"""
WITH p AS ({PRESENCE}), o AS ({ORDER}), s AS (SELECT o.season, o.ordinal, list_sort(list(p.team)) AS teams FROM p JOIN o USING (season) GROUP BY 1, 2),
x AS (SELECT season, teams, lead(season) OVER (ORDER BY ordinal) AS next_season, lead(teams) OVER (ORDER BY ordinal) AS after FROM s)
SELECT season, next_season, array_to_string(list_sort(list_filter(teams, lambda v: NOT list_contains(after, v))), '|') AS left_teams,
 array_to_string(list_sort(list_filter(after, lambda v: NOT list_contains(teams, v))), '|') AS arrived_teams, CAST(len(list_filter(teams, lambda v: list_contains(after, v))) AS INTEGER) AS stayed FROM x WHERE next_season IS NOT NULL""")
def a09(spark, sf):
    return B.boundary_ledger(A.series(spark, sf))


@query("a10_noncontiguous_names", "series", f"""
WITH p AS ({PRESENCE}), o AS ({ORDER}), h AS (SELECT team, list(CAST(ordinal AS INTEGER)) AS have, CAST(min(ordinal) AS INTEGER) AS lo, CAST(max(ordinal) AS INTEGER) AS hi FROM p JOIN o USING (season) GROUP BY team),
m AS (SELECT team, lo, hi, list_sort(list_filter(range(lo, hi + 1), lambda v: NOT list_contains(have, CAST(v AS INTEGER)))) AS miss FROM h)
SELECT team, lo, hi, CAST(len(miss) AS INTEGER) AS n_missing, array_to_string(miss, '|') AS missing FROM m""")
def a10(spark, sf):
    return B.gaps(A.series(spark, sf))


@query("a13_membership", "series", f"""
WITH p AS ({PRESENCE}), o AS ({ORDER}), x AS (SELECT season, team, CAST(ordinal AS INTEGER) AS ordinal FROM p JOIN o USING (season)),
y AS (SELECT *, lag(ordinal) OVER (PARTITION BY team ORDER BY ordinal) AS previous FROM x)
SELECT season, team, CASE WHEN previous IS NULL THEN 'NEW' WHEN previous = ordinal - 1 THEN 'CONTINUING' ELSE 'RETURNING' END AS entry, previous FROM y""")
def a13(spark, sf):
    return B.membership(A.series(spark, sf))


@query("j05_rename_candidates", "series", f"""
WITH l AS ({LONG}), i AS (SELECT team, min(t) AS first_t, max(t) AS last_t, list(DISTINCT opponent) AS met FROM l GROUP BY team)
SELECT a.team AS old_name, b.team AS new_name, b.first_t - a.last_t AS gap, CAST(len(list_intersect(a.met, b.met)) AS INTEGER) AS shared_opponents, list_contains(a.met, b.team) AS played_each_other
FROM i a JOIN i b ON a.team <> b.team AND b.first_t > a.last_t AND b.first_t - a.last_t <= 6480""")
def j05(spark, sf):
    return B.rename_candidates(A.series(spark, sf))


@query("a19_coverage", "series", f"""
WITH p AS (SELECT season, count(*) AS n_teams FROM ({PRESENCE}) GROUP BY season), m AS (SELECT season, count(*) AS met FROM (SELECT DISTINCT season, least(team_a, team_b), greatest(team_a, team_b) FROM series WHERE team_a <> team_b) GROUP BY season)
SELECT season, n_teams, CAST(n_teams * (n_teams - 1) // 2 AS BIGINT) AS expected, coalesce(met, 0) AS met, CASE WHEN coalesce(met, 0) = n_teams * (n_teams - 1) // 2 THEN 'COMPLETE' ELSE 'PARTIAL' END AS coverage FROM p LEFT JOIN m USING (season)""")
def a19(spark, sf):
    return B.coverage(A.series(spark, sf))


@query("a23_side_grouping_sets", "series", f"""
SELECT CAST(grouping(season, stage) AS INTEGER) AS level, season, stage, count(*) AS n, CAST(sum(a) AS BIGINT) AS wins_a, round(avg(a), 6) AS rate_a
FROM (SELECT season, stage, CAST(score_a > score_b AS INTEGER) AS a FROM series WHERE ({LABEL}) = 'COMPLETED') GROUP BY GROUPING SETS ((season, stage), (season), (stage), ())""")
def a23(spark, sf):
    return B.side_diagnostic(A.series(spark, sf))


@query("a25_rollup", "series", "SELECT season, stage, count(*) AS n, CAST(sum(score_a + score_b) AS BIGINT) AS games FROM series GROUP BY ROLLUP (season, stage)")
def a25(spark, sf):
    return A.series(spark, sf).rollup("season", "stage").agg(F.count("*").alias("n"), F.sum(F.col("score_a") + F.col("score_b")).alias("games"))


def _refreshed(s):
    """A later pull of the source: some rows corrected, some under a new id, some missing, some finished, some retracted."""
    s = s.where("series_id % 41 <> 0")
    s = s.withColumn("score_a", F.when(F.col("series_id") % 17 == 0, (F.col("score_a") + 1) % 4).otherwise(F.col("score_a")))
    s = s.withColumn("t", F.when(F.col("series_id") % 19 == 0, F.col("t") + 24).otherwise(F.col("t"))).withColumn("team_b", F.when(F.col("series_id") % 23 == 0, F.concat("team_b", F.lit("!"))).otherwise(F.col("team_b")))
    s = s.withColumn("status", F.when(F.col("series_id") % 29 == 0, 4).when(F.col("series_id") % 37 == 0, 2).otherwise(F.col("status"))).withColumn("stage", F.when(F.col("series_id") % 43 == 0, "5-LOW").otherwise(F.col("stage")))
    return s.withColumn("series_id", F.when(F.col("series_id") % 31 == 0, F.col("series_id") + 10_000_000).otherwise(F.col("series_id")))


REFRESHED = """
neu AS (SELECT CASE WHEN series_id % 31 = 0 THEN series_id + 10000000 ELSE series_id END AS series_id, season, CASE WHEN series_id % 43 = 0 THEN '5-LOW' ELSE stage END AS stage, CASE WHEN series_id % 19 = 0 THEN t + 24 ELSE t END AS t, team_a,
  CASE WHEN series_id % 23 = 0 THEN team_b || '!' ELSE team_b END AS team_b, CASE WHEN series_id % 17 = 0 THEN (score_a + 1) % 4 ELSE score_a END AS score_a, score_b, CASE WHEN series_id % 29 = 0 THEN 4 WHEN series_id % 37 = 0 THEN 2 ELSE status END AS status
  FROM series WHERE series_id % 41 <> 0)"""
_COUNTED = "count(*) OVER (PARTITION BY season, floor(t / 24.0), least(team_a, team_b), greatest(team_a, team_b)) AS c"
DIFF = f"""{REFRESHED},
rn AS (SELECT *, {_COUNTED} FROM neu WHERE series_id NOT IN (SELECT series_id FROM series)), ro AS (SELECT *, {_COUNTED} FROM series WHERE series_id NOT IN (SELECT series_id FROM neu)),
mt AS (SELECT n.series_id, o.series_id AS o_id, 'SOURCE_SERIES_ID' AS via FROM neu n JOIN series o ON n.series_id = o.series_id UNION ALL SELECT n.series_id, o.series_id, 'FALLBACK_COMPETITION_DATE_TEAMPAIR' FROM rn n JOIN ro o ON n.c = 1 AND o.c = 1 AND n.season = o.season AND floor(n.t / 24.0) = floor(o.t / 24.0) AND least(n.team_a, n.team_b) = least(o.team_a, o.team_b) AND greatest(n.team_a, n.team_b) = greatest(o.team_a, o.team_b)),
mm AS (SELECT mt.*, n.season, n.stage <> o.stage AS restaged, CASE WHEN n.team_a <> o.team_a OR n.team_b <> o.team_b THEN 'TEAM_NAME_CONFLICT' WHEN n.t <> o.t THEN 'DATE_CONFLICT' WHEN o.status = 4 AND (n.status <> 4 OR n.score_a <> o.score_a OR n.score_b <> o.score_b) THEN 'SCORE_CONFLICT' WHEN o.status <> 4 AND n.status = 4 THEN 'RESULT_UPDATED' WHEN o.status <> n.status THEN 'STATUS_UPDATED' ELSE 'EXACT_EXISTING' END AS class,
 o.team_a AS oa, o.team_b AS ob, n.team_a AS na, n.team_b AS nb, o.t AS ot, n.t AS nt, o.score_a AS osa, o.score_b AS osb, n.score_a AS nsa, n.score_b AS nsb, o.status AS os, n.status AS ns, o.stage AS og, n.stage AS ng FROM mt JOIN neu n ON n.series_id = mt.series_id JOIN series o ON o.series_id = mt.o_id),
df AS (SELECT series_id, o_id AS o_series_id, via AS match_method, class AS diff_class, concat_ws('; ', CASE class WHEN 'TEAM_NAME_CONFLICT' THEN 'teams ' || oa || ' vs ' || ob || ' -> ' || na || ' vs ' || nb WHEN 'DATE_CONFLICT' THEN 'start ' || ot || ' -> ' || nt WHEN 'SCORE_CONFLICT' THEN CASE WHEN ns = 4 THEN 'score ' || osa || '-' || osb || ' -> ' || nsa || '-' || nsb ELSE 'completed result retracted: status ' || os || ' -> ' || ns END
  WHEN 'RESULT_UPDATED' THEN 'status ' || os || ' -> 4, score ' || nsa || '-' || nsb WHEN 'STATUS_UPDATED' THEN 'status ' || os || ' -> ' || ns END, CASE WHEN restaged THEN 'stage ' || og || ' -> ' || ng END) AS detail, season FROM mm
 UNION ALL SELECT series_id, NULL, '', 'NEW_SERIES', '', season FROM neu WHERE series_id NOT IN (SELECT series_id FROM mt) UNION ALL SELECT NULL, series_id, '', 'UNMATCHED', 'existing row not returned by the refreshed source', season FROM series WHERE series_id NOT IN (SELECT o_id FROM mt))"""


@query("j07_refresh_diff", "series", f"WITH {DIFF} SELECT * FROM df")
def j07(spark, sf):
    """Every row of a refresh and of the existing table with its class (J7, J8)."""
    s = A.series(spark, sf)
    return B.diff_classes(s, _refreshed(s))


@query("j08_refresh_classes", "series", f"WITH {DIFF} SELECT season, diff_class, match_method, count(*) AS n FROM df GROUP BY ROLLUP (season, diff_class, match_method)")
def j08(spark, sf):
    s = A.series(spark, sf)
    return B.diff_classes(s, _refreshed(s)).rollup("season", "diff_class", "match_method").agg(F.count("*").alias("n"))


@query("st3_refreshed_table", "series", f"""
WITH {DIFF}, ok AS (SELECT * FROM df WHERE diff_class IN ('RESULT_UPDATED', 'STATUS_UPDATED', 'EXACT_EXISTING', 'NEW_SERIES')), x AS (SELECT series_id, season, stage, t, status, score_a, score_b FROM series WHERE series_id NOT IN (SELECT o_series_id FROM ok WHERE o_series_id IS NOT NULL) UNION ALL SELECT neu.series_id, neu.season, stage, t, status, score_a, score_b FROM neu JOIN ok USING (series_id))
SELECT series_id, season, stage, t, status, score_a, score_b FROM x""")
def st3(spark, sf):
    """The table after a refresh that arrives as a stream of many micro-batches; conflicts leave the old rows."""
    s = A.series(spark, sf).select(*B.DIFFED)
    return jobs.refresh_stream(s, _refreshed(A.series(spark, sf)).select(*B.DIFFED)).select("series_id", "season", "stage", "t", "status", "score_a", "score_b")


@query("j02_raw_names_kept", "series registry", f"WITH {CANONICAL} SELECT count(*) AS n, count(*) FILTER (c.team_a = s.team_a AND c.team_b = s.team_b) AS kept FROM canonical c JOIN series s USING (series_id)")
def j02(spark, sf):
    """The canonical table keeps every series' names as they were observed."""
    s = A.series(spark, sf)
    c = B.canonical(s, A.registry(spark, sf)).select("series_id", F.col("team_a").alias("ca"), F.col("team_b").alias("cb"))
    x = c.join(s.select("series_id", "team_a", "team_b"), "series_id")
    return x.agg(F.count("*").alias("n"), F.count_if((F.col("ca") == F.col("team_a")) & (F.col("cb") == F.col("team_b"))).alias("kept"))


@query("p19_stage_family", "series", "SELECT CASE WHEN stage IN ('1-URGENT', '2-HIGH') THEN 'PLAYOFF' WHEN stage IN ('3-MEDIUM', '4-NOT SPECIFIED') THEN 'GROUP' ELSE 'OTHER' END AS family, season, count(*) AS n FROM series GROUP BY 1, 2")
def p19(spark, sf):
    """Stages by family."""
    family = F.when(F.col("stage").isin("1-URGENT", "2-HIGH"), "PLAYOFF").when(F.col("stage").isin("3-MEDIUM", "4-NOT SPECIFIED"), "GROUP").otherwise("OTHER")
    return A.series(spark, sf).groupBy(family.alias("family"), "season").agg(F.count("*").alias("n"))


@query("a02_anomalies", "series", f"SELECT series_id, season, status, score_a, score_b, {LABEL} AS label_flag FROM series WHERE ({LABEL}) <> 'COMPLETED'")
def a02(spark, sf):
    """The rows without a label, as they are, for a person."""
    return B.labelled(A.series(spark, sf)).where("label_flag <> 'COMPLETED'").select("series_id", "season", "status", "score_a", "score_b", "label_flag")


@query("so6_replace_season", "series", f"WITH {REFRESHED}, x AS (SELECT series_id, season, status FROM series WHERE season <> 'L1999S1' UNION ALL SELECT series_id, season, status FROM neu WHERE season = 'L1999S1') SELECT season, status, count(*) AS n, CAST(sum(series_id) AS BIGINT) AS id_sum FROM x GROUP BY 1, 2")
def so6(spark, sf):
    s = A.series(spark, sf).select(*B.DIFFED)
    return B.merged(s, _refreshed(s), "L1999S1").groupBy("season", "status").agg(F.count("*").alias("n"), F.sum("series_id").alias("id_sum"))


@query("w16_expanding_folds", "series", f"""
WITH o AS ({ORDER}), l AS (SELECT season, t FROM series WHERE ({LABEL}) = 'COMPLETED')
SELECT season, ordinal, start_t, (SELECT count(*) FROM l WHERE l.t < o.start_t) AS n_train, (SELECT count(*) FROM l WHERE l.season = o.season) AS n_valid FROM o WHERE (SELECT count(*) FROM l WHERE l.t < o.start_t) >= 1""")
def w16(spark, sf):
    return B.expanding_folds(A.series(spark, sf)).withColumn("ordinal", F.col("ordinal").cast("long"))


@query("so1_long_form", "series", LONG)
def so1(spark, sf):
    return B.long_form(A.series(spark, sf))


@query("f04_city_prefix", "series", """
WITH cities(city) AS (VALUES ('NATION'), ('NATION_1'), ('NATION_10'), ('NATION_2')), t AS (SELECT DISTINCT team_a AS team FROM series)
SELECT team, max_by(city, length(city)) AS city FROM t LEFT JOIN cities ON starts_with(team, city) GROUP BY team""")
def f04(spark, sf):
    cities = spark.createDataFrame([("NATION",), ("NATION_1",), ("NATION_10",), ("NATION_2",)], "city string")
    t = A.series(spark, sf).select(F.col("team_a").alias("team")).distinct()
    return t.join(F.broadcast(cities), F.startswith(t.team, F.col("city")), "left").groupBy("team").agg(F.max_by("city", F.length("city")).alias("city"))


@query("f08_row_hash", "series", "SELECT series_id, sha256(concat_ws(chr(31), CAST(series_id AS VARCHAR), season, team_a, team_b, CAST(score_a AS VARCHAR))) AS h FROM series")
def f08(spark, sf):
    return A.series(spark, sf).select("series_id", C.row_hash(*[F.col(c) for c in ("series_id", "season", "team_a", "team_b", "score_a")]).alias("h"))


@query("a03_duplicates", "", "SELECT count(*) AS n, CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS BIGINT) AS repeated FROM lineitem")
def a03(spark, sf):
    x = A.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("m"))
    return x.agg(F.sum("m").alias("n"), F.sum(F.col("m") - 1).alias("repeated"))


@query("a32_duplicate_ids", "", "SELECT l_orderkey, l_linenumber, count(*) AS n, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_partkey) > 1")
def a32(spark, sf):
    return A.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.countDistinct("l_partkey").alias("parts")).where("parts > 1")


@query("j22_orphan_parents", "", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def j22(spark, sf):
    o = A.table(spark, sf, "orders").select("o_orderkey")
    return o.join(A.table(spark, sf, "lineitem").select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
