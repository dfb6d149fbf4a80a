"""Column functions: labels, probabilities, text keys. All stay inside whole-stage code generation."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column
from pyspark.sql import functions as F


def yes(p: Column) -> Column:
    """A predicate that is false where it is null."""
    return F.coalesce(p, F.lit(False))


def decisive(a: Column, b: Column) -> Column:
    return yes(a != b)


def label_flag(a: Column, b: Column, status: Column) -> Column:
    """COMPLETED: decisive and finished (4); a decisive score at another status is a conflict; without one it is not finished, or has no decisive score."""
    d, done = decisive(a, b), yes(status == 4)
    return F.when(d & done, "COMPLETED").when(done, "FINISHED_NO_DECISIVE_SCORE").when(d, "STATUS_SCORE_CONFLICT").otherwise("NOT_FINISHED")


def clip(p: Column, eps: float = 1e-6) -> Column:
    return F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps)
    return F.ln(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def elo_expected(a: Column, b: Column, scale: float = 400.0) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (b - a) / scale))


def log5(a: Column, b: Column) -> Column:
    """Chance of a against b from their win rates."""
    return a * (1 - b) / (a * (1 - b) + b * (1 - a))


def log_loss(y: Column, p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps)
    return -F.when(y == 1, F.ln(q)).otherwise(F.ln(1 - q))


def shrunk(wins: Column, n: Column, m: float) -> Column:
    """Rate drawn to one half with the weight of m games."""
    return (wins + m / 2) / (n + m)


def series_prob(p: Column, best_of: int) -> Column:
    """Chance to win a best-of-n series from the chance of one game: the loser's games before the last one, summed."""
    need = best_of // 2 + 1
    return sum((F.pow(p, F.lit(float(need))) * F.pow(1 - p, F.lit(float(k))) * comb(need - 1 + k, k) for k in range(need)), F.lit(0.0))


def game_prob(s: Column, best_of: int, steps: int = 60) -> Column:
    """The chance of one game at which a best-of-n series is won with chance s: bisection inside one expression."""
    need = best_of // 2 + 1
    terms = [(need - 1 + k, k) for k in range(need)]

    def value(x):
        return sum((F.pow(x, F.lit(float(need))) * F.pow(1 - x, F.lit(float(k))) * comb(n, k) for n, k in terms), F.lit(0.0))

    def step(acc, _):
        mid = (acc["lo"] + acc["hi"]) / 2
        low = value(mid) < s
        return F.struct(F.when(low, mid).otherwise(acc["lo"]).alias("lo"), F.when(low, acc["hi"]).otherwise(mid).alias("hi"))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), step)
    return (end["lo"] + end["hi"]) / 2


def uniform(*parts: Column, seed: str = "1") -> Column:
    """A counter-based uniform in [0, 1): the same on every partitioning and in any engine with MD5."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(seed))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(2**32)


def best_of(stage: Column) -> Column:
    return F.when(stage == "1-URGENT", 7).when(stage.isin("2-HIGH", "3-MEDIUM"), 5).otherwise(3)


def row_hash(*cols: Column) -> Column:
    """SHA-256 over the cells' texts, separated by U+001F; null cells are empty."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), 256)
