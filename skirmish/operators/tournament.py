"""Monte Carlo tournaments: one row per simulation, matches as columns, uniforms from hashed counters.

Every match adds one expression to the same projection, so a million simulations are one narrow stage and one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C

# A double-elimination bracket of eight as (match, side a, side b); S1..S8 seeds, W / L winner and loser of a match.
BRACKET = [
    ("M1", "S1", "S8"), ("M2", "S4", "S5"), ("M3", "S2", "S7"), ("M4", "S3", "S6"), ("M5", "WM1", "WM2"), ("M6", "WM3", "WM4"), ("M7", "LM1", "LM2"),
    ("M8", "LM3", "LM4"), ("M9", "LM6", "WM7"), ("M10", "LM5", "WM8"), ("M11", "WM5", "WM6"), ("M12", "WM9", "WM10"), ("M13", "LM11", "WM12"), ("M14", "WM11", "WM13"),
]


def strengths(ratings: list[float]) -> Column:
    return F.array(*[F.lit(float(r)) for r in ratings])


def play(sim: Column, match: str, a: Column, b: Column, rating: Column, seed: str, best_of: int = 5) -> Column:
    """The winner's index: team a wins if the match's uniform is below its series probability."""
    p = C.elo_expected(F.get(rating, a), F.get(rating, b))
    return F.when(C.uniform(sim, F.lit(match), seed=seed) < C.series_prob(p, best_of), a).otherwise(b)


def double_elimination(spark: SparkSession, n: int, ratings: list[float], seed: str = "1", best_of: int = 5) -> DataFrame:
    """(sim, w1..w14, l1..l14): winners and losers of all matches, for eight teams seeded by index."""
    df = spark.range(n).withColumnRenamed("id", "sim").withColumn("rating", strengths(ratings))
    slot = {f"S{i + 1}": F.lit(i) for i in range(8)}
    for name, x, y in BRACKET:
        k = name[1:]
        a, b = slot[x], slot[y]
        df = df.withColumn(f"w{k}", play(F.col("sim"), name, a, b, F.col("rating"), seed, best_of))
        df = df.withColumn(f"l{k}", F.when(F.col(f"w{k}") == a, b).otherwise(a))
        slot[f"W{name}"], slot[f"L{name}"] = F.col(f"w{k}"), F.col(f"l{k}")
    return df.drop("rating")


def champions(sims: DataFrame) -> DataFrame:
    """Per team: chance to win, to reach the final, and the Monte Carlo standard error."""
    n = sims.agg(F.count("*").alias("n"))
    per = sims.select(F.explode(F.array(F.struct(F.col("w14").alias("team"), F.lit(1).alias("won")), F.struct(F.col("l14").alias("team"), F.lit(0).alias("won")))).alias("x")).groupBy(F.col("x.team").alias("team")).agg(F.sum("x.won").alias("titles"), F.count("*").alias("finals"))
    p = F.col("titles") / F.col("n")
    return per.join(F.broadcast(n)).select("team", "titles", "finals", F.round(p, 6).alias("p_title"), F.round(F.sqrt(p * (1 - p) / F.col("n")), 6).alias("se"))


def sanity(sims: DataFrame) -> DataFrame:
    """Invariants of every simulation: no team is knocked out twice more than allowed, the champion lost at most once."""
    losses = F.array(*[F.col(f"l{i}") for i in range(1, 15)])
    lost = lambda team: F.size(F.filter(losses, lambda x: x == team))
    return sims.agg(F.bool_and(lost(F.col("w14")) <= 1).alias("champion_ok"), F.bool_and(F.col("w14") != F.col("l14")).alias("two_finalists"), F.bool_and(F.size(F.array_distinct(losses)) >= 7).alias("seven_lost"))


def convergence(sims: DataFrame, checkpoints: list[int]) -> DataFrame:
    """Title chances over the first c simulations, in one pass."""
    rows = sims.select("sim", F.col("w14").alias("team"))
    agg = [F.count_if(F.col("sim") < c).alias(f"c{c}") for c in checkpoints]
    per = rows.groupBy("team").agg(*agg)
    return per.select("team", *[F.round(F.col(f"c{c}") / c, 6).alias(f"p_{c}") for c in checkpoints])


def round_robin(spark: SparkSession, n: int, ratings: list[float], seed: str = "1", best_of: int = 5) -> DataFrame:
    """(sim, order array<int>): six or so teams play each other once; ranked by wins, then by a hashed lot."""
    k = len(ratings)
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
    df = spark.range(n).withColumnRenamed("id", "sim")
    p = {(i, j): C.series_prob(C.elo_expected(F.lit(float(ratings[i])), F.lit(float(ratings[j]))), best_of) for i, j in pairs}
    won = {(i, j): (C.uniform(F.col("sim"), F.lit(f"R{i}-{j}"), seed=seed) < p[i, j]).cast("int") for i, j in pairs}
    df = df.select("sim", *[w.alias(f"g{i}_{j}") for (i, j), w in won.items()])
    wins = [sum((F.col(f"g{i}_{j}") if t == i else 1 - F.col(f"g{i}_{j}") for i, j in pairs if t in (i, j)), F.lit(0)) for t in range(k)]
    table = F.array(*[F.struct((-wins[t]).alias("w"), C.uniform(F.col("sim"), F.lit(f"L{t}"), seed=seed).alias("lot"), F.lit(t).alias("team")) for t in range(k)])
    return df.select("sim", F.array_sort(table).alias("s")).select("sim", F.transform("s", lambda x: x["team"]).alias("order"), F.transform("s", lambda x: -x["w"]).alias("wins"))


def rank_distribution(tables: DataFrame) -> DataFrame:
    return tables.select(F.posexplode("order").alias("place", "team")).groupBy("team", "place").agg(F.count("*").alias("n"))


def tie_audit(tables: DataFrame) -> DataFrame:
    """Simulations in which neighbours in the table have equal wins, by place."""
    return tables.select(F.posexplode(F.zip_with(F.slice("wins", 1, F.size("wins") - 1), F.slice("wins", 2, F.size("wins") - 1), lambda a, b: a == b)).alias("place", "tied")).groupBy("place").agg(F.count_if("tied").alias("ties"), F.count("*").alias("n"))


def pairwise(ratings: DataFrame) -> DataFrame:
    """Ordered pairs of the entrants (team, rating) with game and series probabilities: entrants of one tournament are few."""
    a, b = ratings.select(F.col("team").alias("a"), F.col("rating").alias("ra")), ratings.select(F.col("team").alias("b"), F.col("rating").alias("rb"))
    p = C.elo_expected(F.col("ra"), F.col("rb"))
    pairs = a.join(F.broadcast(b), F.col("a") != F.col("b"))
    return pairs.select("a", "b", F.round(p, 6).alias("p_game"), F.round(C.series_prob(p, 5), 6).alias("p_bo5"), F.round(C.series_prob(p, 7), 6).alias("p_bo7"))
