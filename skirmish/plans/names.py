"""Queries of name similarity and of pairs of names that may be one team."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rounding import rounded_sql
from ..operators import backbone as B
from ..operators import names as N
from ..sources import adapter as A
from .backbone import LONG, ORDER
from .base import query

#: Parts of the teams' display names, chosen by the team's number.
CITIES, CORES, WORDS = ["北京", "上海", "广州", "成都", "西安"], ["龙之队", "狼人", "凤凰城", "虎牙", "龙之谷", "雄狮"], ["Star", "River", "Wolf", "Moon", "Iron", "Jade", "Storm"]


def display(team):
    """The name that a team shows: city, core and word by its number; a later name has another word behind, a variant an X."""
    k = F.regexp_extract(team, r"NATION_(\d+)", 1).cast("int")
    suffix = F.regexp_extract(team, r"\.(.)$", 1)
    part = lambda words, i: F.element_at(F.array(*map(F.lit, words)), i % len(words) + 1)
    return F.concat(part(CITIES, k), part(CORES, k), F.lit(" "), part(WORDS, k), F.when(suffix == "B", F.concat(F.lit(" "), part(WORDS, k + 3))).when(suffix == "X", F.lit(" X")).otherwise(""))


def appearances(spark, sf):
    long = B.long_form(A.series(spark, sf))
    return long.select(display(F.col("team")).alias("team"), display(F.col("opponent")).alias("opponent"), "season", "t")


def _candidates(spark, sf):
    a = appearances(spark, sf)
    return a, N.candidates(a, B.season_order(A.series(spark, sf)))


def _list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _display(team):
    k = f"CAST(regexp_extract({team}, 'NATION_(\\d+)', 1) AS INTEGER)"
    part = lambda words, k: f"{_list(words)}[({k}) % {len(words)} + 1]"
    return f"{part(CITIES, k)} || {part(CORES, k)} || ' ' || {part(WORDS, k)} || CASE regexp_extract({team}, '\\.(.)$', 1) WHEN 'B' THEN ' ' || {part(WORDS, f'{k} + 3')} WHEN 'X' THEN ' X' ELSE '' END"


def _longest(a, b):
    """The longest common run: the least (-length, place in a, place in b)."""
    return f"list_sort(list_filter(flatten(list_transform(range(1, length({a}) + 1), lambda i: list_transform(range(1, length({a}) - i + 2), lambda l: {{'n': -l, 'i': i, 'j': instr({b}, substr({a}, i, l))}}))), lambda s: s.j > 0))[1]"


_PAIRS = f"""
ap AS MATERIALIZED (SELECT {_display('team')} AS team, {_display('opponent')} AS opponent, season, t FROM ({LONG})), o AS ({ORDER}),
iv AS MATERIALIZED (SELECT team, min(t) AS first_t, max(t) AS last_t, arg_min(season, (t, season)) AS first_season, arg_max(season, (t, season)) AS last_season FROM ap GROUP BY team),
gp AS MATERIALIZED (SELECT a.team AS x, b.team AS y, a.last_t AS ended, b.first_t AS began, b.first_t - a.last_t AS gap, a.last_season, b.first_season FROM iv a JOIN iv b ON (a.first_t, a.team) < (b.first_t, b.team) AND b.first_t - a.last_t <= {N.NAMED}),
ro AS (SELECT x, y, lower(x) AS a, lower(y) AS b, {_longest('lower(x)', 'lower(y)')} AS m FROM gp UNION ALL
 SELECT x, y, a, b, {_longest('a', 'b')} FROM (SELECT x, y, unnest([substr(a, 1, m.i - 1), substr(a, m.i - m.n)]) AS a, unnest([substr(b, 1, m.j - 1), substr(b, m.j - m.n)]) AS b FROM ro WHERE m IS NOT NULL)),
si AS (SELECT x, y, coalesce(sum(-m.n), 0) * 2.0 / (length(x) + length(y)) AS similarity FROM ro GROUP BY x, y)"""


@query("f04_sequence_ratio", "series", f"WITH RECURSIVE {_PAIRS} SELECT x, y, {rounded_sql('similarity')} AS ratio FROM si")
def f04r(spark, sf):
    """Matching-block similarity of every pair of names that the gap rules allow, as no built-in has it: an Arrow function."""
    p = N.gap_pairs(N.inventory(appearances(spark, sf), B.season_order(A.series(spark, sf))))
    return N.name_features(p).select(F.col("old_name").alias("x"), F.col("new_name").alias("y"), F.col("string_similarity").alias("ratio"))


_TOKENS = "list_distinct(regexp_extract_all(lower({}), '[a-z]{{2,}}'))"
_CJK = "regexp_extract({}, '[一-鿿]+')"
_FEATURES = f"""{_PAIRS},
cj AS (SELECT x, y, coalesce(substr(cx, m.i, -m.n), '') AS run FROM (SELECT x, y, cx, {_longest('cx', 'cy')} AS m FROM (SELECT x, y, {_CJK.format('x')} AS cx, {_CJK.format('y')} AS cy FROM gp))),
nf AS (SELECT gp.*, {rounded_sql('similarity')} AS string_similarity, array_to_string(list_sort(list_intersect({_TOKENS.format('x')}, {_TOKENS.format('y')})), '|') AS shared_latin_tokens, run, length(run) = 2 AND starts_with(x, run) AND starts_with(y, run) AS prefix, similarity >= 0.6 AS similar_string_flag FROM gp JOIN si USING (x, y) JOIN cj USING (x, y)),
nn AS (SELECT *, CASE WHEN length(run) >= 2 THEN run ELSE '' END AS shared_cjk_substring, prefix AND shared_latin_tokens = '' AS shared_prefix_only, shared_latin_tokens <> '' OR (length(run) >= 2 AND NOT prefix) AS strong FROM nf)"""


@query("f03_longest_common_substring", "series", f"WITH RECURSIVE {_FEATURES} SELECT x, y, shared_cjk_substring AS common, shared_prefix_only, strong AS strong_name_evidence FROM nn")
def f03(spark, sf):
    """The longest common run of Chinese characters of every pair that the gap rules allow, and what it proves."""
    p = N.name_features(N.gap_pairs(N.inventory(appearances(spark, sf), B.season_order(A.series(spark, sf)))))
    return p.select(F.col("old_name").alias("x"), F.col("new_name").alias("y"), F.col("shared_cjk_substring").alias("common"), "shared_prefix_only", "strong_name_evidence")


_CANDIDATES = f"""{_FEATURES},
wh AS (SELECT *, concat_ws('|', CASE WHEN gap > 0 AND gap <= {N.BOUNDARY} THEN 'BOUNDARY_WITHIN_270D' END, CASE WHEN strong AND gap > 0 AND gap <= {N.NAMED} THEN 'SIMILAR_NAME_AFTER_DISAPPEARANCE' END, CASE WHEN (strong OR similar_string_flag) AND gap <= 0 THEN 'SIMILAR_NAME_COEXISTING' END) AS reason FROM nn),
mt AS (SELECT team, season, list(DISTINCT opponent) AS met, count(*) AS n FROM ap GROUP BY 1, 2),
sh AS (SELECT wh.*, list_filter(p.met, lambda e: e <> x AND e <> y) AS m1, list_filter(q.met, lambda e: e <> x AND e <> y) AS m2, p.n AS n1, q.n AS n2, ob.ordinal - oa.ordinal AS steps FROM wh JOIN mt p ON p.team = x AND p.season = last_season JOIN mt q ON q.team = y AND q.season = first_season JOIN o oa ON oa.season = last_season JOIN o ob ON ob.season = first_season WHERE reason <> ''),
sr AS (SELECT *, len(list_intersect(m1, m2)) AS shared, CASE WHEN least(len(m1), len(m2)) > 0 THEN CAST(len(list_intersect(m1, m2)) AS DOUBLE) / least(len(m1), len(m2)) ELSE 0.0 END AS ratio,
 CASE WHEN shared_latin_tokens <> '' THEN 1.0::DOUBLE ELSE greatest(least(string_similarity, 0.5), CASE WHEN shared_cjk_substring <> '' AND NOT shared_prefix_only THEN 0.8::DOUBLE ELSE 0 END, CASE WHEN shared_prefix_only THEN 0.3::DOUBLE ELSE 0 END) END AS strength FROM sh),
ca AS MATERIALIZED (SELECT x AS old_name, y AS new_name, ended AS old_last_seen, began AS new_first_seen, {rounded_sql('gap / 24.0::DOUBLE', 2)} AS days_between, last_season AS old_last_season, first_season AS new_first_season, CAST(steps AS INTEGER) AS season_index_gap, string_similarity, shared_latin_tokens, shared_cjk_substring, shared_prefix_only, strong AS strong_name_evidence, similar_string_flag,
 CAST(shared AS INTEGER) AS shared_opponents_before_after, {rounded_sql('ratio')} AS shared_opponent_ratio, n1 AS old_recent_series_count, n2 AS new_early_series_count,
 {rounded_sql('0.45::DOUBLE * strength + 0.25::DOUBLE * CASE WHEN gap > 0 THEN greatest(0.0::DOUBLE, 1 - (gap / 24.0::DOUBLE) / 540.0::DOUBLE) ELSE 0.0::DOUBLE END + 0.15::DOUBLE * ratio + 0.15::DOUBLE * CASE WHEN gap > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END', 4)} AS transition_score, reason AS candidate_reason FROM sr)"""


@query("j05_transition_candidates", "series", f"WITH RECURSIVE {_CANDIDATES} SELECT * FROM ca")
def j05(spark, sf):
    """Pairs of names for a review, with the reasons and the score."""
    return _candidates(spark, sf)[1]


@query("j06_overlap_checks", "series", f"""
WITH RECURSIVE {_CANDIDATES}, ow AS (SELECT team, list(DISTINCT season) AS seasons, list(DISTINCT t // 24) AS days, min(t) AS lo, max(t) AS hi FROM ap GROUP BY team),
ov AS (SELECT old_name, new_name, season_index_gap, len(list_intersect(a.seasons, b.seasons)) > 0 AS season, len(list_intersect(a.days, b.days)) > 0 AS day, a.lo <= b.hi AND b.lo <= a.hi AS span, EXISTS (SELECT 1 FROM ap WHERE ap.team = old_name AND ap.opponent = new_name) AS played FROM ca JOIN ow a ON a.team = old_name JOIN ow b ON b.team = new_name)
SELECT old_name, new_name, season AS same_season, span AS date_ranges_overlap, played AS played_each_other, day AS same_day_presence, season_index_gap IN (0, 1) AND NOT span AS adjacent_transition, season AND NOT span AS mid_season_change, played OR day OR span AS identity_conflict_flag,
 concat_ws('|', CASE WHEN played THEN 'PLAYED_EACH_OTHER' END, CASE WHEN day THEN 'SAME_DAY_PRESENCE' END, CASE WHEN span THEN 'DATE_RANGES_OVERLAP' END) AS conflict_reasons FROM ov""")
def j06(spark, sf):
    """What speaks against each pair."""
    a, c = _candidates(spark, sf)
    return N.overlap_checks(a, c)
