"""Supervised models over folds of seasons: features that are known before a series, fits by aggregated Newton steps, and the
choice of a model by earlier seasons. A step of all folds and models is one aggregate; a row of sums per
group is collected.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.rounding import rounded
from ..sources.store import drop, stash


#: What marks columns that a model may not see before a series: outcomes of the series itself, and another source's winners.
FORBIDDEN = ("oracle_", "undated_winner", "label_")


def deployable(cols: list[str]) -> list[str]:
    """The columns, if none of them tells what is not known before a series; else a ValueError names those that do."""
    bad = [c for c in cols if any(mark in c for mark in FORBIDDEN)]
    if bad:
        raise ValueError(f"not known before a series: {', '.join(bad)}")
    return cols


def expand_folds(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows of every fold: train where the season's ordinal is below the fold's, test where it is equal. ``folds``: (fold int) ordinals."""
    small = folds.select("fold")  # a row per season
    return rows.join(F.broadcast(small), F.col("ordinal") <= F.col("fold")).withColumn("train", F.col("ordinal") < F.col("fold"))


def grouped_logistic(rows: DataFrame, key: str, cols: list[str], label: str, strength: float, steps: int = 8, *, intercept: bool = True, start: list[float] | None = None, penalty=None, bound: float | None = None) -> DataFrame:
    """(key, w0, w1, ...): penalised logistic weights of every group, by Newton steps from ``start`` (zeros).

    w0 is the free intercept, if there is one. All others have the penalty 1 / ``strength`` around ``start``; ``penalty(key)``, where
    given, returns a group's own penalties. Weights stay within ``bound``. Each step is one aggregate over all groups: sums of
    gradient and Hessian by ``key``. The solved steps, one small system a group, go back as a table of a row per group.
    """
    spark = rows.sparkSession
    x = [*([F.lit(1.0)] if intercept else []), *[F.col(c).cast("double") for c in cols]]
    d = len(x)
    names = [f"w{i}" for i in range(d)]
    first = np.zeros(d) if start is None else np.array(start, float)
    shared = np.array(([0.0] if intercept else []) + [1 / strength] * len(cols))
    base = rows.select(F.col(key).alias("__k"), *[v.alias(f"__x{i}") for i, v in enumerate(x)], F.col(label).cast("double").alias("__y"))
    x = [F.col(f"__x{i}") for i in range(d)]
    base = stash(base, "fit")  # every step reads it
    kind, wide = rows.schema[key].dataType.simpleString(), ", ".join(f"{n} double" for n in names)
    weights: dict = {}
    for _ in range(steps):
        if weights:
            table = spark.createDataFrame([(k, *map(float, w)) for k, w in weights.items()], f"__k {kind}, {wide}")
            now = base.join(table, "__k")
        else:
            now = base.select("*", *[F.lit(float(v)).alias(n) for n, v in zip(names, first)])
        mu = C.sigmoid(sum((F.col(n) * v for n, v in zip(names, x)), F.lit(0.0)))
        sums = [F.sum((mu - F.col("__y")) * v) for v in x] + [F.sum(mu * (1 - mu) * x[i] * x[j]) for i in range(d) for j in range(i, d)]
        for r in now.groupBy("__k").agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).collect():  # a row per group
            w, lam = weights.get(r[0], first), shared if penalty is None else np.array(penalty(r[0]), float)
            h, k = np.diag(lam), d + 1
            for i in range(d):
                for j in range(i, d):
                    h[i, j] += r[k]
                    h[j, i] = h[i, j]
                    k += 1
            w = w - np.linalg.solve(h + 1e-9 * np.eye(d), np.array(r[1 : d + 1]) + lam * (w - first))
            weights[r[0]] = w if bound is None else np.clip(w, -bound, bound)
    drop(base)
    return spark.createDataFrame([(k, *map(float, w)) for k, w in weights.items()], f"{key} {kind}, {wide}")


def apply_weights(rows: DataFrame, weights: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Adds p of each row from its group's weights."""
    z = sum((F.col(f"w{i + 1}") * F.col(c) for i, c in enumerate(cols)), F.col("w0"))
    return rows.join(F.broadcast(weights), key).withColumn("p", C.sigmoid(z)).drop(*[f"w{i}" for i in range(len(cols) + 1)])


def ladder(rows: DataFrame, groups: dict[str, list[str]], label: str, strength: float = 1.0, steps: int = 6) -> DataFrame:
    """(model, fold, series_id, y, p): every feature group fitted on the seasons before each fold, predicting the fold's own.

    ``rows``: see ``expand_folds``. All models and folds are groups of one fit: a row enters each model with zeros for what the
    model does not have, whose weights the penalty keeps at zero. So a Newton step is one job whatever the number of models.
    """
    cols = deployable(list(dict.fromkeys(c for own in groups.values() for c in own)))
    model = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), *[(F.col(c).cast("double") if c in own else F.lit(0.0)).alias(f"f{i}") for i, c in enumerate(cols)]) for m, own in groups.items()]))
    names = [f"f{i}" for i in range(len(cols))]
    flat = rows.select("fold", "series_id", "train", F.col(label).alias("y"), model.alias("m")).select(F.concat_ws("|", "m.model", F.col("fold").cast("string")).alias("key"), "fold", "series_id", "train", "y", "m.*")
    w = grouped_logistic(flat.where("train"), "key", names, "y", strength, steps)
    return apply_weights(flat.where("not train"), w, "key", names).select("model", "fold", "series_id", "y", "p")


def best_before(scored: DataFrame, order: dict[str, int]) -> DataFrame:
    """Per fold, the model with the least mean loss over earlier folds (ties: the model named first); the first fold takes the
    first model. ``scored``: (model, fold, n, loss) with sums of loss, a row per model and fold."""
    rank = F.create_map(*[v for k, n in order.items() for v in (F.lit(k), F.lit(n))])[F.col("model")]
    w = Window.partitionBy("model").orderBy("fold").rangeBetween(Window.unboundedPreceding, -1)
    prior = scored.withColumn("mean", F.sum("loss").over(w) / F.sum("n").over(w)).withColumn("place", rank)
    pick = F.row_number().over(Window.partitionBy("fold").orderBy(F.round("mean", 10).asc_nulls_last(), "place"))
    return prior.withColumn("r", pick).where("r = 1").select("fold", "model", rounded(F.col("mean")).alias("prior_loss"))
