"""Forecast evaluation: metrics by group, reliability, paired bootstrap, calibration fits, selection of configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.rounding import exact_mean, rounded, whole
from .ladders import grouped_logistic


def metrics(pred: DataFrame, *keys: str) -> DataFrame:
    """Per group of ``pred`` (keys, p, y): n, log loss, Brier, accuracy, AUC by average ranks, means, calibration error over ten bins.

    Losses are whole sums, so they do not depend on the order of rows. A group of one class has no AUC.
    """
    per = pred.groupBy(*keys, "p").agg(F.count("*").alias("m"), F.sum("y").alias("pos"))  # ties of p are one row
    below = F.coalesce(F.sum("m").over(Window.partitionBy(*keys).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = per.withColumn("rank", below + (F.col("m") + 1) / 2).withColumn("bin", F.least(F.floor(F.col("p") * 10), F.lit(9)))
    p, y1, y0 = F.col("p"), F.col("pos"), F.col("m") - F.col("pos")
    q = C.clip(p)
    sums = {"n": F.sum("m"), "n1": F.sum("pos"), "ll": F.sum(y1 * whole(-F.ln(q)) + y0 * whole(-F.ln(1 - q))), "br": F.sum(y1 * whole((p - 1) * (p - 1)) + y0 * whole(p * p)), "hit": F.sum(F.when(p >= 0.5, y1).otherwise(y0)), "r1": F.sum(y1 * F.col("rank")), "sp": F.sum(whole(p) * F.col("m"))}
    bins = ranked.groupBy(*keys, "bin").agg(*[c.alias(k) for k, c in sums.items()])
    gap = F.abs(F.col("sp") - F.col("n1") * 1_000_000_000)  # n times |mean p - rate| of a bin
    agg = bins.groupBy(*keys).agg(*[F.sum(k).alias(k) for k in sums], F.sum(gap).alias("gap"))
    n, n1 = F.col("n"), F.col("n1")
    n0 = n - n1
    auc = F.when((n0 > 0) & (n1 > 0), F.try_divide(F.col("r1") - n1 * (n1 + 1) / 2, n0 * n1))
    mean = lambda c: rounded(F.col(c) / n / 1e9).alias({"ll": "log_loss", "br": "brier", "sp": "mean_p", "gap": "ece"}[c])
    return agg.select(*keys, "n", mean("ll"), mean("br"), rounded(F.col("hit") / n).alias("accuracy"), rounded(auc).alias("auc"), mean("sp"), rounded(n1 / n).alias("mean_y"), mean("gap"))


def full_metrics(pred: DataFrame, key: str) -> DataFrame:
    """``metrics`` with the recalibration's intercept and slope, and a note: neither is estimated for groups of one class or ten rows or fewer."""
    w = recalibration(pred, key)
    few = F.col("n") <= 10
    one = F.col("auc").isNull()
    note = F.when(one, "ONE_CLASS").when(few, "TOO_FEW_ROWS").otherwise("")
    x = metrics(pred, key).join(w, key).withColumn("note", note)
    return x.withColumns({c: F.when(F.col("note") == "", F.col(c)) for c in ("intercept", "slope")})  # a row per group


def reliability(pred: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width bins of p; empty bins are kept with nulls."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    per = pred.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), exact_mean(F.col("p")).alias("mean_p"), exact_mean(F.col("y")).alias("rate"))
    return pred.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(per, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_p", "rate")


def calibration_error(pred: DataFrame, bins: int = 10) -> DataFrame:
    r = reliability(pred, bins)
    return r.agg(rounded(F.sum(F.floor(F.col("n") * F.abs(F.col("mean_p") - F.col("rate")) * 1e6 + 0.5).cast("long")) / F.sum("n") / 1e6).alias("ece"))


def paired_difference(pred: DataFrame, reference: str) -> DataFrame:
    """Per model: mean log-loss difference to the reference on the same rows, its standard error and share of rows won."""
    x = pred.select("config", "series_id", C.log_loss(F.col("y"), F.col("p")).alias("ll"))
    ref = x.where(F.col("config") == reference).select("series_id", F.col("ll").alias("base"))
    d = x.where(F.col("config") != reference).join(ref, "series_id").withColumn("d", F.col("ll") - F.col("base"))
    return d.groupBy("config").agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("mean_diff"), F.round(F.stddev_samp("d") / F.sqrt(F.count("*")), 6).alias("se"), F.round(F.avg((F.col("d") < 0).cast("int")), 6).alias("share_better"))


def block_bootstrap(pred: DataFrame, draws: int, seed: str = "1") -> DataFrame:
    """Season-block bootstrap of the mean loss: seasons are drawn with replacement by hashed uniforms; rows are never multiplied,
    for a season enters as its sum and count. Returns the mean and the 2.5 and 97.5 percentiles over draws."""
    per = pred.groupBy("season").agg(F.sum(whole(C.log_loss(F.col("y"), F.col("p")))).alias("s"), F.count("*").alias("n"))
    order = per.withColumn("i", (F.row_number().over(Window.orderBy("season")) - 1).cast("long"))  # a row per season
    k = order.agg(F.count("*").alias("k"))
    picks = pred.sparkSession.range(draws).withColumnRenamed("id", "draw").join(F.broadcast(k)).withColumn("slot", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k"))))
    picks = picks.withColumn("i", F.floor(C.uniform(F.col("draw"), F.col("slot"), seed=seed) * F.col("k")).cast("long"))
    means = picks.join(F.broadcast(order), "i").groupBy("draw").agg((F.sum("s") / F.sum("n") / 1e9).alias("m"))  # seasons are few
    return means.agg(F.count("*").alias("draws"), rounded(F.avg("m")).alias("mean"), rounded(F.percentile("m", F.lit(0.025))).alias("low"), rounded(F.percentile("m", F.lit(0.975))).alias("high"))


def recalibration(pred: DataFrame, key: str, steps: int = 12, digits: int = 4) -> DataFrame:
    """Per group: intercept and slope of y on logit(p), by Newton steps as aggregates over all groups' rows."""
    w = grouped_logistic(pred.select(key, "y", C.logit(F.col("p")).alias("x")), key, ["x"], "y", float("inf"), steps, start=[0.0, 1.0])
    return w.select(key, rounded(F.col("w0"), digits).alias("intercept"), rounded(F.col("w1"), digits).alias("slope"))


def ablation(scores: DataFrame) -> DataFrame:
    """Successive differences along the models' order: ``scores`` (ordinal, config, log_loss)."""
    return scores.withColumn("delta", F.round(F.col("log_loss") - F.lag("log_loss").over(Window.orderBy("ordinal")), 6))  # a row per model
