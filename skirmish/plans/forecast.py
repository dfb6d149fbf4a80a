"""Queries of ratings, evaluation, series mathematics and tournaments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rounding import exact_mean, exact_mean_sql, rounded_sql
from ..operators import backbone as B
from ..operators import evaluate as E
from ..operators import ratings as R
from ..operators import tournament as T
from ..sources import adapter as A
from .backbone import LABEL, ORDER
from .base import query
from .fitsql import newton

ROWS = f"rows AS (SELECT series_id, t, season, CAST(nation_a AS BIGINT) AS a, CAST(nation_b AS BIGINT) AS b, CAST(score_a > score_b AS INTEGER) AS y FROM series WHERE ({LABEL}) = 'COMPLETED' AND nation_a <> nation_b)"
#: The recursive SQL walks one row per batch of equal times; it carries all ratings in a map.
ELO = """
WITH RECURSIVE {rows},
k AS (SELECT *, dense_rank() OVER (ORDER BY t) AS g FROM rows),
gs AS MATERIALIZED (SELECT g, any_value(t) AS t, any_value(season) AS season, list(struct_pack(i := series_id, a := a, b := b, y := y) ORDER BY series_id) AS rs FROM k GROUP BY g),
f AS (
  SELECT 0::BIGINT AS g, MAP {{}}::MAP(BIGINT, DOUBLE) AS m, ''::VARCHAR AS season, []::STRUCT(i BIGINT, p DOUBLE, ra DOUBLE, rb DOUBLE)[] AS o
  UNION ALL
  SELECT g, map_concat(m, map_from_entries(list_transform(teams, lambda x: {{'k': x, 'v': coalesce(m[x], 1500.0) + coalesce(list_sum(list_transform(list_filter(os, lambda r: r.a = x), lambda r: r.d)), 0.0) - coalesce(list_sum(list_transform(list_filter(os, lambda r: r.b = x), lambda r: r.d)), 0.0)}}))),
    season, list_transform(os, lambda r: struct_pack(i := r.i, p := r.p, ra := r.ra, rb := r.rb))
  FROM (
    SELECT g, m, season, list_distinct(flatten(list_transform(rs, lambda r: [r.a, r.b]))) AS teams,
      list_transform(rs, lambda r: struct_pack(i := r.i, a := r.a, b := r.b, ra := coalesce(m[r.a], 1500.0), rb := coalesce(m[r.b], 1500.0), p := 1 / (1 + pow(10.0, (coalesce(m[r.b], 1500.0) - coalesce(m[r.a], 1500.0)) / 400.0)),
        d := {k} * (r.y - 1 / (1 + pow(10.0, (coalesce(m[r.b], 1500.0) - coalesce(m[r.a], 1500.0)) / 400.0))))) AS os
    FROM (SELECT gs.g, gs.season, gs.rs, CASE WHEN f.season <> '' AND f.season <> gs.season THEN map_from_entries(list_transform(map_entries(f.m), lambda e: {{'k': e.key, 'v': 1500.0 + {rho} * (e.value - 1500.0)}})) ELSE f.m END AS m FROM f JOIN gs ON gs.g = f.g + 1)))
SELECT r.i AS series_id, round(r.p, 6) AS p, round(r.ra, 4) AS before_a, round(r.rb, 4) AS before_b FROM (SELECT unnest(o) AS r FROM f)"""


def labelled_rows(spark, sf):
    s = B.labelled(A.series(spark, sf)).where("labelled and nation_a <> nation_b")
    return s.select("series_id", "t", "season", F.col("nation_a").cast("long").alias("a"), F.col("nation_b").cast("long").alias("b"), (F.col("score_a") > F.col("score_b")).cast("int").alias("y"))


def _one(df):
    return df.select("series_id", F.round("p", 6).alias("p"), F.round("before_a", 4).alias("before_a"), F.round("before_b", 4).alias("before_b"))


def _elo_sql(k, rho):
    return ELO.format(rows=ROWS, k=k, rho=rho)


@query("r03_elo", "series", _elo_sql("32.0", "1.0"))
def r03(spark, sf):
    return _one(R.rate(labelled_rows(spark, sf), [{"name": "B3", "k": 32}]))


@query("r05_season_reset_elo", "series", _elo_sql("24.0", "0.75"))
def r05(spark, sf):
    return _one(R.rate(labelled_rows(spark, sf), [{"name": "B5", "k": 24, "rho": 0.75}]))


@query("r01_coin_flip", "series", f"WITH {ROWS} SELECT series_id, 0.5::DOUBLE AS p FROM rows")
def r01(spark, sf):
    return labelled_rows(spark, sf).select("series_id", F.lit(0.5).alias("p"))


WIN = """
s AS (SELECT series_id, t, 'a' AS s, a AS team, y AS w FROM rows UNION ALL SELECT series_id, t, 'b', b, 1 - y FROM rows),
q AS (SELECT series_id, s, (coalesce(sum(w) OVER x, 0) + 5.0) / (count(*) OVER x + 10.0) AS r FROM s WINDOW x AS (PARTITION BY team ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT series_id, max(r) FILTER (s = 'a') AS ra, max(r) FILTER (s = 'b') AS rb FROM q GROUP BY 1),
win AS (SELECT v.*, ra * (1 - rb) / (ra * (1 - rb) + rb * (1 - ra)) AS p FROM v)"""


@query("r02_smoothed_win_rate", "series", f"WITH {ROWS}, {WIN} SELECT series_id, round(ra, 6) AS rate_a, round(rb, 6) AS rate_b, round(p, 6) AS p FROM win")
def r02(spark, sf):
    return R.smoothed_win_rates(labelled_rows(spark, sf))


def win_predictions(spark, sf):
    rows = labelled_rows(spark, sf)
    return R.smoothed_win_rates(rows).select("series_id", "p").join(rows.select("series_id", "season", "t", "y"), "series_id")


PRED = f"{ROWS}, {WIN}, pred AS (SELECT series_id, season, t, y, round(win.p, 6) AS p FROM win JOIN rows USING (series_id))"
CLIP = "greatest(1e-6, least(1 - 1e-6, p))"
LL = f"-CASE WHEN y = 1 THEN ln({CLIP}) ELSE ln(1 - {CLIP}) END"


@query("m01_metrics", "series", f"""
WITH RECURSIVE {PRED}, r AS (SELECT *, rank() OVER (PARTITION BY season ORDER BY p) + (count(*) OVER (PARTITION BY season, p) - 1) / 2.0 AS rk FROM pred),
mx AS MATERIALIZED (SELECT season, ln({CLIP} / (1 - {CLIP})) AS x, y FROM pred), {newton("mx", "season", ["1.0", "x"], [0.0, 0.0], 12, start=[0.0, 1.0])},
eb AS (SELECT season, abs(sum(CAST(floor(p * 1e9 + 0.5) AS BIGINT)) - sum(y) * 1000000000) AS gap FROM pred GROUP BY season, least(floor(p * 10), 9)), ec AS (SELECT season, CAST(sum(gap) AS DOUBLE) AS gap FROM eb GROUP BY season),
mm AS (SELECT season, count(*) AS n, {exact_mean_sql(f'({LL})')} AS log_loss, {exact_mean_sql('((p - y) * (p - y))')} AS brier, {rounded_sql('CAST(count(*) FILTER ((p >= 0.5) = (y = 1)) AS DOUBLE) / count(*)')} AS accuracy,
 CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN {rounded_sql('(sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y))')} END AS auc, {exact_mean_sql('p')} AS mean_p, {rounded_sql('CAST(sum(y) AS DOUBLE) / count(*)')} AS mean_y FROM r GROUP BY season),
mn AS (SELECT mm.*, {rounded_sql('gap / n / 1e9')} AS ece, CASE WHEN auc IS NULL THEN 'ONE_CLASS' WHEN n <= 10 THEN 'TOO_FEW_ROWS' ELSE '' END AS note FROM mm JOIN ec USING (season))
SELECT mn.*, CASE WHEN note = '' THEN {rounded_sql('w0', 4)} END AS intercept, CASE WHEN note = '' THEN {rounded_sql('w1', 4)} END AS slope FROM mn JOIN fit USING (season)""")
def m01(spark, sf):
    return E.full_metrics(win_predictions(spark, sf), "season")


@query("m03_reliability", "series", f"""
WITH {PRED}, b AS (SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, p, y FROM pred), g AS (SELECT bin, count(*) AS n, {exact_mean_sql('p')} AS mean_p, {exact_mean_sql('y')} AS rate FROM b GROUP BY bin)
SELECT CAST(i AS INTEGER) AS bin, coalesce(n, 0) AS n, mean_p, rate FROM range(10) r(i) LEFT JOIN g ON g.bin = i""")
def m03(spark, sf):
    return E.reliability(win_predictions(spark, sf))


@query("m04_calibration_error", "series", f"""
WITH {PRED}, b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, {exact_mean_sql('p')} AS mp, {exact_mean_sql('y')} AS my FROM pred GROUP BY 1) SELECT {rounded_sql("CAST(sum(CAST(floor(n * abs(mp - my) * 1e6 + 0.5) AS BIGINT)) AS DOUBLE) / sum(n) / 1e6")} AS ece FROM b""")
def m04(spark, sf):
    return E.calibration_error(win_predictions(spark, sf))


def two_models(spark, sf):
    rows = win_predictions(spark, sf)
    return rows.select(F.lit("B1").alias("config"), "series_id", "season", "t", "y", "p").unionByName(rows.select(F.lit("B0").alias("config"), "series_id", "season", "t", "y", F.lit(0.5).alias("p")))


@query("m17_paired_difference", "series", f"WITH {PRED}, d AS (SELECT ({LL}) - ln(2.0) AS d FROM pred) SELECT 'B1' AS config, count(*) AS n, round(avg(d), 6) AS mean_diff, round(stddev_samp(d) / sqrt(count(*)), 6) AS se, round(avg(CAST(d < 0 AS INTEGER)), 6) AS share_better FROM d")
def m17(spark, sf):
    return E.paired_difference(two_models(spark, sf), "B0")


@query("m14_block_bootstrap", "series", f"""
WITH {PRED}, sea AS (SELECT season, CAST(sum(CAST(floor(({LL}) * 1e9 + 0.5) AS BIGINT)) AS BIGINT) AS s, count(*) AS n, row_number() OVER (ORDER BY season) - 1 AS i FROM pred GROUP BY season), kk AS (SELECT count(*) AS k FROM sea),
d AS (SELECT draw, slot, CAST(floor(CAST(('0x' || substr(md5(draw || '|' || slot || '|1'), 1, 8)) AS BIGINT) / 4294967296.0 * k) AS BIGINT) AS i FROM range(500) a(draw), kk, range(1, 1000) b(slot) WHERE slot <= k),
m AS (SELECT draw, CAST(sum(s) AS DOUBLE) / sum(n) / 1e9 AS m FROM d JOIN sea USING (i) GROUP BY draw)
SELECT count(*) AS draws, {rounded_sql('avg(m)')} AS mean, {rounded_sql('quantile_cont(m, 0.025)')} AS low, {rounded_sql('quantile_cont(m, 0.975)')} AS high FROM m""")
def m14(spark, sf):
    return E.block_bootstrap(win_predictions(spark, sf), 500)


@query("m10_ablation", "series", f"""
WITH {PRED}, x AS (SELECT 0 AS ordinal, 'B0' AS config, round(ln(2.0), 6) AS log_loss UNION ALL SELECT 1, 'B1', round(avg({LL}), 6) FROM pred) SELECT ordinal, config, log_loss, round(log_loss - lag(log_loss) OVER (ORDER BY ordinal), 6) AS delta FROM x""")
def m10(spark, sf):
    m = E.metrics(two_models(spark, sf), "config").select(F.when(F.col("config") == "B0", 0).otherwise(1).alias("ordinal"), "config", "log_loss")
    return E.ablation(m)


@query("a49_favourite_bins", "series", f"""
WITH {PRED}, f AS (SELECT greatest(p, 1 - p) AS q, CASE WHEN p >= 0.5 THEN y ELSE 1 - y END AS won FROM pred)
SELECT CASE WHEN q < 0.55 THEN '50-55' WHEN q < 0.6 THEN '55-60' WHEN q < 0.7 THEN '60-70' ELSE '70+' END AS bin, count(*) AS n, {exact_mean_sql('q')} AS mean_q, {exact_mean_sql('won')} AS rate FROM f GROUP BY 1""")
def a49(spark, sf):
    q = F.greatest(F.col("p"), 1 - F.col("p"))
    f = win_predictions(spark, sf).select(q.alias("q"), F.when(F.col("p") >= 0.5, F.col("y")).otherwise(1 - F.col("y")).alias("won"))
    b = F.when(F.col("q") < 0.55, "50-55").when(F.col("q") < 0.6, "55-60").when(F.col("q") < 0.7, "60-70").otherwise("70+")
    return f.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), exact_mean(F.col("q")).alias("mean_q"), exact_mean(F.col("won")).alias("rate"))


@query("l01_train_only_scaling", "series", f"""
WITH o AS ({ORDER}), tr AS (SELECT s.* FROM series s JOIN o USING (season) WHERE ordinal <= 7),
st AS (SELECT median(score_a) AS med, quantile_cont(score_a, 0.005) AS lo, quantile_cont(score_a, 0.995) AS hi FROM tr),
m AS (SELECT avg(greatest(lo, least(hi, coalesce(score_a, med)))) AS mu, stddev_pop(greatest(lo, least(hi, coalesce(score_a, med)))) AS sd FROM tr, st)
SELECT series_id, round((greatest(lo, least(hi, coalesce(score_a, med))) - mu) / sd, 6) AS z FROM series, st, m""")
def l01(spark, sf):
    s = A.series(spark, sf)
    train = s.join(B.season_order(s).where("ordinal <= 7").select("season"), "season", "left_semi")
    lo, med, hi = train.agg(F.percentile("score_a", F.array(F.lit(0.005), F.lit(0.5), F.lit(0.995)))).first()[0]
    x = F.greatest(F.lit(lo), F.least(F.lit(hi), F.coalesce(F.col("score_a"), F.lit(med)).cast("double")))
    mu, sd = train.agg(F.avg(x), F.stddev_pop(x)).first()
    return s.select("series_id", F.round((x - mu) / sd, 6).alias("z"))


RATINGS = [1640.0, 1600.0, 1570.0, 1540.0, 1520.0, 1500.0, 1470.0, 1430.0]
_U = "CAST(('0x' || substr(md5(sim || '|{m}|1'), 1, 8)) AS BIGINT) / 4294967296.0"


def _bracket_sql(n):
    r = "[" + ", ".join(map(str, RATINGS)) + "]::DOUBLE[]"
    q, slot = f"SELECT range AS sim FROM range({n})", {f"S{i + 1}": str(i) for i in range(8)}
    for name, x, y in T.BRACKET:
        k, a, b = name[1:], slot[x], slot[y]
        p = f"1 / (1 + pow(10.0, (({r})[{b} + 1] - ({r})[{a} + 1]) / 400.0))"
        bo5 = "pow(pp, 3) * (1 + 3 * (1 - pp) + 6 * pow(1 - pp, 2))"
        q = f"SELECT * EXCLUDE (pp, aa, bb), CASE WHEN {_U.format(m=name)} < {bo5} THEN aa ELSE bb END AS w{k}, CASE WHEN {_U.format(m=name)} < {bo5} THEN bb ELSE aa END AS l{k} FROM (SELECT *, {p} AS pp, {a} AS aa, {b} AS bb FROM ({q}))"
        slot[f"W{name}"], slot[f"L{name}"] = f"w{k}", f"l{k}"
    return q


@query("t07_double_elimination", "", f"""
WITH s AS ({_bracket_sql(4000)}), x AS (SELECT w14 AS team, 1 AS won FROM s UNION ALL SELECT l14, 0 FROM s)
SELECT team, CAST(sum(won) AS BIGINT) AS titles, count(*) AS finals, round(sum(won) / 4000.0, 6) AS p_title, round(sqrt(sum(won) / 4000.0 * (1 - sum(won) / 4000.0) / 4000), 6) AS se FROM x GROUP BY team""")
def t07(spark, sf):
    return T.champions(T.double_elimination(spark, 4000, RATINGS))


@query("t14_convergence", "", f"WITH s AS ({_bracket_sql(4000)}) SELECT w14 AS team, round(count(*) FILTER (sim < 1000) / 1000.0, 6) AS p_1000, round(count(*) FILTER (sim < 2000) / 2000.0, 6) AS p_2000, round(count(*) / 4000.0, 6) AS p_4000 FROM s GROUP BY 1")
def t14(spark, sf):
    return T.convergence(T.double_elimination(spark, 4000, RATINGS), [1000, 2000, 4000])


@query("t19_pairwise", "", f"""
WITH r AS (SELECT 'T' || CAST(i AS VARCHAR) AS team, ([{', '.join(map(str, RATINGS))}]::DOUBLE[])[i + 1] AS rating FROM range(8) q(i)), x AS (SELECT a.team AS a, b.team AS b, 1 / (1 + pow(10.0, (b.rating - a.rating) / 400.0)) AS p FROM r a JOIN r b ON a.team <> b.team)
SELECT a, b, round(p, 6) AS p_game, round(pow(p, 3) * (1 + 3 * (1 - p) + 6 * pow(1 - p, 2)), 6) AS p_bo5, round(pow(p, 4) * (1 + 4 * (1 - p) + 10 * pow(1 - p, 2) + 20 * pow(1 - p, 3)), 6) AS p_bo7 FROM x""")
def t19(spark, sf):
    return T.pairwise(spark.createDataFrame([(f"T{i}", r) for i, r in enumerate(RATINGS)], "team string, rating double"))
