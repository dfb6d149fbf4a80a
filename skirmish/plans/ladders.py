"""Queries of supervised ladders, their inference and resampling; folds are seasons, features are known before each series."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.rounding import rounded, rounded_sql
from ..operators import evaluate as E
from ..operators import inference as I
from ..operators import ladders as L
from ..operators import ratings as R
from ..sources import adapter as A
from . import design as D
from .backbone import ORDER
from .base import query
from .fitsql import newton
from .forecast import CLIP, LL, PRED, ROWS, WIN, labelled_rows, win_predictions

#: Feature groups of the ladder, each with what the one before has.
GROUPS = {"B6_rates": ["rate"], "B7_form": ["rate", "form"], "B8_rest": ["rate", "form", "rest"]}
GROUPS_OUT = {"without_rate": ["form", "rest"], "without_form": ["rate", "rest"], "without_rest": ["rate", "form"]}


def ladder(spark, sf, groups):
    return L.ladder(D.folded(spark, sf), groups, "y")


def scored(p):
    """Sums of loss as whole numbers of 1e-9."""
    return p.groupBy("model", "fold").agg(F.count("*").alias("n"), F.sum(F.floor(C.log_loss(F.col("y"), F.col("p")) * 1e9 + 0.5).cast("long")).alias("loss"))


def _ladder_sql(models: dict[str, list[str]]) -> str:
    """CTEs ``lp`` (model, fold, series_id, y, p) and ``ls`` (model, fold, n, loss) of every model's Newton fits."""
    fits = [newton("ltrain", "fold", ["1.0", *c], [0.0] + [1.0] * len(c), 6, name=f"m{i}") for i, c in enumerate(models.values())]
    score = [f"SELECT '{m}' AS model, fold, series_id, y, 1 / (1 + exp(-(w0 + {' + '.join(f'w{k + 1} * {f}' for k, f in enumerate(c))}))) AS p FROM folded JOIN m{i} USING (fold) WHERE NOT train" for i, (m, c) in enumerate(models.items())]
    return f"""WITH RECURSIVE {D.DESIGN}, ltrain AS MATERIALIZED (SELECT * FROM folded WHERE train), {', '.join(fits)}, lp AS MATERIALIZED ({' UNION ALL '.join(score)}),
ls AS (SELECT model, fold, count(*) AS n, CAST(sum(CAST(floor(({LL}) * 1e9 + 0.5) AS BIGINT)) AS BIGINT) AS loss FROM lp GROUP BY 1, 2)"""


_MEAN = rounded_sql("CAST(loss AS DOUBLE) / n / 1e9")


def _mean():
    return rounded(F.col("loss") / F.col("n") / 1e9)


@query("l04_ladder", "series", f"{_ladder_sql(GROUPS)} SELECT model, fold, n, {_MEAN} AS log_loss FROM ls")
def l04(spark, sf):
    """Log loss out of sample per model and fold."""
    return scored(ladder(spark, sf, GROUPS)).select("model", "fold", "n", _mean().alias("log_loss"))


_OUT = {"all": GROUPS["B8_rest"], **GROUPS_OUT}


@query("l04_leave_one_group_out", "series", f"{_ladder_sql(_OUT)} SELECT model, fold, n, {_MEAN} AS log_loss FROM ls")
def l04b(spark, sf):
    return scored(ladder(spark, sf, _OUT)).select("model", "fold", "n", _mean().alias("log_loss"))


_TWO = {k: GROUPS[k] for k in ("B6_rates", "B8_rest")}


@query("l05_logit_average", "series", f"""
{_ladder_sql(_TWO)}, av AS (SELECT fold, series_id, max(y) AS y, avg(ln({CLIP} / (1 - {CLIP}))) AS z FROM lp GROUP BY 1, 2), a AS (SELECT fold, y, 1 / (1 + exp(-z)) AS p FROM av)
SELECT fold, count(*) AS n, {rounded_sql(f"CAST(sum(CAST(floor(({LL}) * 1e9 + 0.5) AS BIGINT)) AS DOUBLE) / count(*) / 1e9")} AS log_loss FROM a GROUP BY fold""")
def l05(spark, sf):
    """Equal mean of two models' logits."""
    p = ladder(spark, sf, _TWO)
    x = p.groupBy("fold", "series_id").agg(F.max("y").alias("y"), C.sigmoid(F.avg(C.logit(F.col("p")))).alias("p"))
    return scored(x.withColumn("model", F.lit("X3"))).select("fold", "n", _mean().alias("log_loss"))


@query("l07_inner_selection", "series", f"""
{_ladder_sql(GROUPS)}, pr AS (SELECT *, CAST(sum(loss) OVER w AS DOUBLE) / sum(n) OVER w / 1e9 AS mean FROM ls WINDOW w AS (PARTITION BY model ORDER BY fold RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT fold, model, {rounded_sql('mean')} AS prior_loss FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(mean, 10) NULLS LAST, model) AS r FROM pr) WHERE r = 1""")
def l07(spark, sf):
    """Each fold's model by its loss over earlier folds; the first takes the plainest."""
    return L.best_before(scored(ladder(spark, sf, GROUPS)).withColumn("loss", F.col("loss") / 1e9), {k: i for i, k in enumerate(GROUPS)})


_NEWTON = """
st AS (SELECT 0 AS i, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2 UNION ALL SELECT i + 1, w0 - (i00 * g0 + i01 * g1 + i02 * g2), w1 - (i01 * g0 + i11 * g1 + i12 * g2), w2 - (i02 * g0 + i12 * g1 + i22 * g2) FROM (
 SELECT *, (h11 * h22 - h12 * h12) / det AS i00, (h02 * h12 - h01 * h22) / det AS i01, (h01 * h12 - h02 * h11) / det AS i02, (h00 * h22 - h02 * h02) / det AS i11, (h01 * h02 - h00 * h12) / det AS i12, (h00 * h11 - h01 * h01) / det AS i22 FROM (
  SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det FROM (
   SELECT i, w0, w1, w2, sum(mu - y) AS g0, sum((mu - y) * x1) + w1 AS g1, sum((mu - y) * x2) + w2 AS g2, sum(v) AS h00, sum(v * x1) AS h01, sum(v * x2) AS h02, sum(v * x1 * x1) + 1 AS h11, sum(v * x1 * x2) AS h12, sum(v * x2 * x2) + 1 AS h22 FROM (
    SELECT i, w0, w1, w2, x1, x2, y, mu, mu * (1 - mu) AS v FROM (SELECT st.*, x1, x2, y, 1 / (1 + exp(-(w0 + w1 * x1 + w2 * x2))) AS mu FROM st, d WHERE i < 8)) GROUP BY i, w0, w1, w2))))"""


@query("l02_logistic_l2", "series", f"""
WITH RECURSIVE {ROWS}, {WIN}, d AS MATERIALIZED (SELECT round(ra, 6) AS x1, round(rb, 6) AS x2, y FROM win JOIN rows USING (series_id)), {_NEWTON}
SELECT 'intercept' AS term, round(w0, 5) AS weight FROM st WHERE i = 8 UNION ALL SELECT 'rate_a', round(w1, 5) FROM st WHERE i = 8 UNION ALL SELECT 'rate_b', round(w2, 5) FROM st WHERE i = 8""")
def l02(spark, sf):
    """Weights of an L2 logistic model of y on the two prior win rates."""
    rows = labelled_rows(spark, sf)
    f = R.smoothed_win_rates(rows).join(rows.select("series_id", "y"), "series_id").withColumn("g", F.lit(1))
    w = L.grouped_logistic(f, "g", ["rate_a", "rate_b"], "y", 1.0)
    return w.select(F.stack(F.lit(3), F.lit("intercept"), F.round("w0", 5), F.lit("rate_a"), F.round("w1", 5), F.lit("rate_b"), F.round("w2", 5)).alias("term", "weight"))


@query("m05_recalibration", "series", f"""
WITH RECURSIVE {PRED}, x AS MATERIALIZED (SELECT season, ln({CLIP} / (1 - {CLIP})) AS x, y FROM pred), {newton("x", "season", ["1.0", "x"], [0.0, 0.0], 12, start=[0.0, 1.0])}
SELECT season, {rounded_sql('w0', 4)} AS intercept, {rounded_sql('w1', 4)} AS slope FROM fit""")
def m05(spark, sf):
    return E.recalibration(win_predictions(spark, sf), "season")


_DRAWS = 200
_STATS = f"count(*) AS draws, {rounded_sql('avg(m)')} AS mean, {rounded_sql('stddev_samp(m)')} AS se, {rounded_sql('quantile_cont(m, 0.025)')} AS low, {rounded_sql('quantile_cont(m, 0.975)')} AS high"
_GAIN = f"CAST(floor((({LL}) - ln(2.0)) * 1e9 + 0.5) AS BIGINT)"


def _gain():
    return F.floor((C.log_loss(F.col("y"), F.col("p")) - float(np.log(2.0))) * 1e9 + 0.5).cast("long")


@query("m15_stratified_bootstrap", "series", f"""
WITH {PRED}, bu AS (SELECT season, series_id, {_GAIN} AS s, 1000000000::BIGINT AS k FROM pred), {I.poisson_sql("bu", "series_id", "season", _DRAWS, "1")}
SELECT {_STATS} FROM bm""")
def m15(spark, sf):
    """Paired bootstrap of the gain over chance within seasons."""
    u = win_predictions(spark, sf).select("season", "series_id", _gain().alias("s"), F.lit(1_000_000_000).cast("long").alias("k"))
    return I.summary(I.poisson_bootstrap(u, F.col("series_id").cast("string"), "season", _DRAWS, "1"))


@query("m16_cluster_bootstrap", "series", f"""
WITH {PRED}, bu AS (SELECT season, t, CAST(sum({_GAIN}) AS BIGINT) AS s, count(*) * 1000000000::BIGINT AS k FROM pred GROUP BY 1, 2), {I.cluster_sql("bu", "season", "t", _DRAWS, "2")}
SELECT {_STATS} FROM bm""")
def m16(spark, sf):
    """Whole clusters (series of one time) are drawn within seasons, as many as a season has; a cluster enters as its sum and count."""
    u = win_predictions(spark, sf).groupBy("season", "t").agg(F.sum(_gain()).alias("s"), (F.count("*") * 1_000_000_000).alias("k"))
    return I.summary(I.cluster_bootstrap(u, "season", "t", _DRAWS, "2"))


@query("m02_metric_variants", "series", f"""
WITH {PRED} SELECT round(avg(-CASE WHEN y = 1 THEN ln(greatest(1e-6, least(1 - 1e-6, p))) ELSE ln(1 - greatest(1e-6, least(1 - 1e-6, p))) END), 6) AS log_loss_6, round(avg(-CASE WHEN y = 1 THEN ln(greatest(1e-8, least(1 - 1e-8, p))) ELSE ln(1 - greatest(1e-8, least(1 - 1e-8, p))) END), 6) AS log_loss_8, round(avg((p - y) * (p - y)), 6) AS brier FROM pred""")
def m02(spark, sf):
    return win_predictions(spark, sf).agg(F.round(F.avg(C.log_loss(F.col("y"), F.col("p"), 1e-6)), 6).alias("log_loss_6"), F.round(F.avg(C.log_loss(F.col("y"), F.col("p"), 1e-8)), 6).alias("log_loss_8"), F.round(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))), 6).alias("brier"))


@query("m24_leave_one_season_out", "series", f"""
WITH {PRED}, ss AS (SELECT season, sum({LL}) AS l, count(*) AS n FROM pred GROUP BY 1), t AS (SELECT sum(l) AS l, sum(n) AS n FROM ss)
SELECT season AS left_out, t.n - s.n AS n, round((t.l - s.l) / (t.n - s.n) - ln(2.0), 6) AS delta, abs(((t.l - s.l) / (t.n - s.n) - t.l / t.n) / (t.l / t.n - ln(2.0))) > 0.3 OR ((t.l - s.l) / (t.n - s.n) - ln(2.0)) * (t.l / t.n - ln(2.0)) < 0 AS high_instability FROM ss s, t""")
def m24(spark, sf):
    """Without each season: the loss against chance; unstable where it moves by 30% or changes its sign. Sums of seasons are enough."""
    s = win_predictions(spark, sf).groupBy("season").agg(F.sum(C.log_loss(F.col("y"), F.col("p"))).alias("l"), F.count("*").alias("n"))
    t = s.agg(F.sum("l").alias("tl"), F.sum("n").alias("tn"))
    x = s.join(F.broadcast(t)).withColumn("rest", (F.col("tl") - F.col("l")) / (F.col("tn") - F.col("n"))).withColumn("all", F.col("tl") / F.col("tn"))  # one row
    ln2 = float(np.log(2.0))
    moved = F.abs((F.col("rest") - F.col("all")) / (F.col("all") - ln2)) > 0.3
    return x.select(F.col("season").alias("left_out"), (F.col("tn") - F.col("n")).alias("n"), F.round(F.col("rest") - ln2, 6).alias("delta"), (moved | ((F.col("rest") - ln2) * (F.col("all") - ln2) < 0)).alias("high_instability"))


@query("p22_known_gaps", "series", f"""
WITH o AS ({ORDER}), y AS (SELECT DISTINCT CAST(substr(season, 2, 4) AS INTEGER) AS y, substr(season, 7, 1) AS half FROM o)
SELECT y AS year, count(*) AS halves, CASE WHEN count(*) < 2 THEN 'MISSING_HALF_' || CASE WHEN min(half) = '1' THEN '2' ELSE '1' END ELSE 'COMPLETE' END AS gap FROM y GROUP BY 1""")
def p22(spark, sf):
    """Years of which a season is missing, by the season's name."""
    y = A.series(spark, sf).select(F.regexp_extract("season", r"^L(\d{4})S(\d)$", 1).cast("int").alias("year"), F.regexp_extract("season", r"^L(\d{4})S(\d)$", 2).alias("half")).distinct()
    other = F.when(F.min("half") == "1", "2").otherwise("1")
    return y.groupBy("year").agg(F.count("*").alias("halves"), F.when(F.count("*") < 2, F.concat(F.lit("MISSING_HALF_"), other)).otherwise("COMPLETE").alias("gap"))


@query("f16_season_parts", "series", "SELECT DISTINCT season, CAST(regexp_extract(season, '^L([0-9]{4})S([0-9])$', 1) AS INTEGER) AS year, CAST(regexp_extract(season, '^L([0-9]{4})S([0-9])$', 2) AS INTEGER) AS half FROM series")
def f16(spark, sf):
    part = lambda i: F.regexp_extract("season", r"^L(\d{4})S(\d)$", i).cast("int")
    return A.series(spark, sf).select("season", part(1).alias("year"), part(2).alias("half")).distinct()


@query("p03_epoch_fallback", "", "SELECT event_id, starts_with(CASE WHEN event_id % 50 = 0 THEN '1970-01-01 08:00:00' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END, '1970-01-01') AS fallback FROM events")
def p03(spark, sf):
    """Times that are the epoch in text stand for no time."""
    raw = F.when(F.col("event_id") % 50 == 0, "1970-01-01 08:00:00").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return A.table(spark, sf, "events").select("event_id", F.startswith(raw, F.lit("1970-01-01")).alias("fallback"))


@query("f14_parse_times", "", "SELECT o_orderkey, strftime(try_strptime(CASE WHEN o_orderkey % 7 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END, '%Y-%m-%d'), '%Y/%m') AS month FROM orders")
def f14(spark, sf):
    text = F.when(F.col("o_orderkey") % 7 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return A.table(spark, sf, "orders").select("o_orderkey", F.date_format(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), "yyyy/MM").alias("month"))


@query("o06_first_minimum", "games", "SELECT series_id, CAST(list_position(list(part ORDER BY game_number), min(part)) AS INTEGER) AS place, min(part) AS least FROM games GROUP BY series_id")
def o06(spark, sf):
    """The place of the first of the smallest values."""
    a = F.transform(F.array_sort(F.collect_list(F.struct("game_number", "part"))), lambda x: x["part"])
    g = A.games(spark, sf).groupBy("series_id").agg(a.alias("a"))
    return g.select("series_id", F.array_position("a", F.array_min("a")).cast("int").alias("place"), F.array_min("a").alias("least"))


@query("f22_log_days", "series", "SELECT series_id, round(ln(1 + t / 24.0) - ln(1 + (t % 9000) / 24.0), 6) AS diff FROM series")
def f22(spark, sf):
    return A.series(spark, sf).select("series_id", F.round(F.log1p(F.col("t") / 24.0) - F.log1p((F.col("t") % 9000) / 24.0), 6).alias("diff"))


@query("s05_field_evidence", "", """
WITH k(concept, word) AS (VALUES ('key', 'key'), ('money', 'price'), ('money', 'acctbal'), ('time', 'date'), ('time', 'ts'), ('text', 'name'), ('text', 'comment')),
c AS (SELECT table_name AS tab, column_name AS col FROM information_schema.columns WHERE table_name IN ('orders', 'customer', 'supplier', 'part', 'events')), h AS (SELECT DISTINCT concept, tab || '.' || col AS place FROM k JOIN c ON contains(col, word))
SELECT concept, count(*) AS n, array_to_string((list(place ORDER BY place))[1:5], '|') AS examples, 'GREEN' AS status FROM h GROUP BY concept""")
def s05(spark, sf):
    """Which concepts the tables' own columns hold, by keyword, with the first five examples."""
    k = spark.createDataFrame([("key", "key"), ("money", "price"), ("money", "acctbal"), ("time", "date"), ("time", "ts"), ("text", "name"), ("text", "comment")], "concept string, word string")
    cols = [(t, c) for t in ("orders", "customer", "supplier", "part", "events") for c in A.table(spark, sf, t).columns]
    hit = spark.createDataFrame(cols, "tab string, col string").join(F.broadcast(k), F.contains("col", F.col("word"))).select("concept", F.concat_ws(".", "tab", "col").alias("at")).distinct()  # a few keywords
    return hit.groupBy("concept").agg(F.count("*").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_list("at")), 1, 5), "|").alias("examples"), F.lit("GREEN").alias("status"))
