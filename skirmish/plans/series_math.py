"""Queries of the mathematics of series, over the forecasts of all labelled series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.rounding import rounded, rounded_sql
from ..sources import adapter as A
from . import design as D
from .base import query

_BO = {3: "q * q * (3 - 2 * q)", 5: "pow(q, 3) * (1 + 3 * (1 - q) + 6 * pow(1 - q, 2))", 7: "pow(q, 4) * (1 + 4 * (1 - q) + 10 * pow(1 - q, 2) + 20 * pow(1 - q, 3))"}
_OWN = "CASE best_of " + " ".join(f"WHEN {n} THEN {v}" for n, v in _BO.items()) + " END"


def _by_format(f):
    """f(best of how many), chosen by the row's own format."""
    out = F.lit(None).cast("double")
    for n in _BO:
        out = F.when(F.col("best_of") == n, f(n)).otherwise(out)
    return out


@query("f17_logit_sigmoid", "series", f"WITH {D.DESIGN} SELECT series_id, {rounded_sql('ln(greatest(1e-6, least(1 - 1e-6, p)) / (1 - greatest(1e-6, least(1 - 1e-6, p))))')} AS x, {rounded_sql('greatest(1e-6, least(1 - 1e-6, p))')} AS p FROM design")
def f17(spark, sf):
    """The logit of every forecast, and back."""
    x = C.logit(F.col("p"))
    return D.design(spark, sf).select("series_id", rounded(x).alias("x"), rounded(C.sigmoid(x)).alias("p"))


@query("n01_series_probability", "series", f"WITH {D.DESIGN}, g AS (SELECT series_id, best_of, p AS q FROM design) SELECT series_id, best_of, {', '.join(rounded_sql(v) + f' AS bo{n}' for n, v in _BO.items())}, {rounded_sql(_OWN)} AS p_series FROM g")
def n01(spark, sf):
    """The chance of a series from that of a game, in every format and in its own."""
    p = F.col("p")
    return D.design(spark, sf).select("series_id", "best_of", *[rounded(C.series_prob(p, n)).alias(f"bo{n}") for n in _BO], rounded(_by_format(lambda n: C.series_prob(p, n))).alias("p_series"))


@query("n02_game_probability", "series", f"""
WITH RECURSIVE {D.DESIGN}, bi AS (SELECT series_id, best_of, p, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS i FROM design UNION ALL
 SELECT series_id, best_of, p, CASE WHEN v < p THEN q ELSE lo END, CASE WHEN v < p THEN hi ELSE q END, i + 1 FROM (SELECT *, {_OWN} AS v FROM (SELECT *, (lo + hi) / 2 AS q FROM bi WHERE i < 60)))
SELECT series_id, best_of, {rounded_sql('(lo + hi) / 2', 5)} AS p_game FROM bi WHERE i = 60""")
def n02(spark, sf):
    """The chance of a game at which a series of the format is won with the forecast chance, by sixty bisections inside one expression."""
    return D.design(spark, sf).select("series_id", "best_of", rounded(_by_format(lambda n: C.game_prob(F.col("p"), n)), 5).alias("p_game"))


@query("n03_series_states", "games", f"""
WITH {D.DESIGN}, gw AS (SELECT series_id, game_number, coalesce(count(*) FILTER (winner = 'a') OVER w, 0) AS wa, coalesce(count(*) FILTER (winner = 'b') OVER w, 0) AS wb FROM games WHERE winner IS NOT NULL WINDOW w AS (PARTITION BY series_id ORDER BY game_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
st AS (SELECT series_id, game_number, wa, wb, p, best_of // 2 + 1 AS need FROM gw JOIN design USING (series_id))
SELECT series_id, game_number, CAST(wa AS INTEGER) AS wins_a, CAST(wb AS INTEGER) AS wins_b, {rounded_sql("CASE WHEN wa >= need THEN 1.0::DOUBLE WHEN wb >= need THEN 0.0::DOUBLE ELSE list_sum(list_transform(range(0, need - wb), lambda k: CAST(factorial(CAST(need - wa - 1 + k AS INTEGER)) AS DOUBLE) / CAST(factorial(CAST(k AS INTEGER)) * factorial(CAST(need - wa - 1 AS INTEGER)) AS DOUBLE) * pow(p, need - wa) * pow(1 - p, k))) END")} AS p_series FROM st""")
def n03(spark, sf):
    """The chance that side a wins the series from the score before every game: the games the other side may still win, summed."""
    w = Window.partitionBy("series_id").orderBy("game_number").rowsBetween(Window.unboundedPreceding, -1)
    won = lambda s: F.coalesce(F.count_if(F.col("winner") == s).over(w), F.lit(0)).cast("int")
    g = A.games(spark, sf).where("winner is not null").select("series_id", "game_number", won("a").alias("wins_a"), won("b").alias("wins_b"))
    x = g.join(D.design(spark, sf).select("series_id", "p", (F.floor(F.col("best_of") / 2) + 1).cast("int").alias("need")), "series_id")
    left, other = F.col("need") - F.col("wins_a"), F.col("need") - F.col("wins_b")
    ways = lambda k: F.factorial(left - 1 + k).cast("double") / (F.factorial(k) * F.factorial(left - 1)).cast("double")
    total = F.aggregate(F.sequence(F.lit(0), other - 1), F.lit(0.0), lambda s, k: s + ways(k) * F.pow(F.col("p"), left) * F.pow(1 - F.col("p"), k))
    p = F.when(left <= 0, F.lit(1.0)).when(other <= 0, F.lit(0.0)).otherwise(total)
    return x.select("series_id", "game_number", "wins_a", "wins_b", rounded(p).alias("p_series"))
