"""The design rows that supervised queries share: features known before each series, and the folds of seasons."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.rounding import rounded, rounded_sql
from ..operators import backbone as B
from ..operators import history as H
from ..operators.ladders import expand_folds
from ..sources import adapter as A
from ..sources.store import derived
from .backbone import ORDER
from .forecast import CLIP, ROWS, WIN, labelled_rows, win_predictions

FEATURES = ["rate", "form", "rest"]
FIRST_FOLD = 5


def _design(spark, sf):
    rows = labelled_rows(spark, sf)
    side = F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("team"), F.col("y").alias("w")), F.struct(F.lit("b").alias("side"), F.col("b").alias("team"), (1 - F.col("y")).alias("w"))))
    s = rows.select("series_id", "t", side.alias("x")).select("series_id", "t", "x.*")
    p = H.prior(["team"], "t")
    n = F.row_number().over(Window.partitionBy("team").orderBy("t", "series_id", "side"))
    s = s.withColumn("rate", C.shrunk(F.coalesce(F.sum("w").over(p), F.lit(0)), F.count("*").over(p), 10.0)).withColumn("rest", F.coalesce(F.ln(1 + (F.col("t") - F.max("t").over(p)) / 24.0), F.lit(0.0))).withColumn("n", n)
    s = s.withColumn("form", F.coalesce(F.sum("w").over(Window.partitionBy("team").orderBy("n").rangeBetween(-5, -1)), F.lit(0)) / 5.0)
    diff = lambda c: rounded(F.max(F.when(F.col("side") == "a", F.col(c))) - F.max(F.when(F.col("side") == "b", F.col(c)))).alias(c)
    wide = s.groupBy("series_id").agg(*[diff(c) for c in FEATURES])
    order = B.season_order(A.series(spark, sf)).select("season", F.col("ordinal").cast("int").alias("ordinal"))
    stage = A.series(spark, sf).select("series_id", C.best_of(F.col("stage")).alias("best_of"))
    p = win_predictions(spark, sf).select("series_id", "p", C.logit(F.col("p")).alias("z"))
    return rows.join(wide, "series_id").join(stage, "series_id").join(p, "series_id").join(F.broadcast(order), "season")  # a row per season


def design(spark, sf):
    """Per labelled series: season and its ordinal, best of how many, y, the features (differences a - b of the prior win rate, the
    last five series' wins and the log days of rest), and p with its logit z by prior win rates. Written once."""
    return derived(spark, "design", [f"{sf}/{t}.parquet" for t in ("orders", "lineitem", "customer", "supplier")], lambda: _design(spark, sf))


def folds(spark, sf):
    """The seasons that are predicted: all from the fifth on."""
    return design(spark, sf).where(F.col("ordinal") >= FIRST_FOLD).select(F.col("ordinal").alias("fold")).distinct()


def folded(spark, sf):
    """The design rows of every fold, train or test."""
    return expand_folds(design(spark, sf), folds(spark, sf))


DESIGN = f"""{ROWS}, {WIN}, so AS ({ORDER}),
dq AS (SELECT *, (coalesce(sum(w) OVER x, 0) + 5.0) / (count(*) OVER x + 10.0) AS rate, coalesce(ln(1 + (t - max(t) OVER x) / 24.0), 0.0) AS rest, row_number() OVER (PARTITION BY team ORDER BY t, series_id, s) AS n FROM s WINDOW x AS (PARTITION BY team ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
df AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY team ORDER BY n RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) / 5.0 AS form FROM dq),
dd AS (SELECT series_id, {', '.join(rounded_sql(f"max({c}) FILTER (s = 'a') - max({c}) FILTER (s = 'b')") + f' AS {c}' for c in FEATURES)} FROM df GROUP BY 1),
dp AS (SELECT series_id, round(p, 6) AS p FROM win),
design AS MATERIALIZED (SELECT r.series_id, r.t, r.season, CAST(so.ordinal AS INTEGER) AS ordinal, r.a, r.b, r.y, dd.rate, dd.form, dd.rest, p, ln({CLIP} / (1 - {CLIP})) AS z,
  CASE WHEN stage = '1-URGENT' THEN 7 WHEN stage IN ('2-HIGH', '3-MEDIUM') THEN 5 ELSE 3 END AS best_of
 FROM rows r JOIN dd USING (series_id) JOIN dp USING (series_id) JOIN (SELECT series_id, stage FROM series) USING (series_id) JOIN so ON so.season = r.season),
folded AS MATERIALIZED (SELECT d.*, fold, ordinal < fold AS train FROM design d JOIN (SELECT DISTINCT ordinal AS fold FROM design WHERE ordinal >= {FIRST_FOLD}) ON ordinal <= fold)"""
