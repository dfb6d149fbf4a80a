"""Online ratings: batches of equal time are predicted from the state before them, then update it once.

One chain couples all teams and is sequential; Spark's axis is the configurations. Spark sorts a configuration's rows, and its
task reads them batch by batch: it holds the ratings, not the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .leagues import in_order

RATED = "config string, series_id long, p double, before_a double, before_b double"


def step(state: dict, rows: dict, k: float, scale: float = 400.0, start: float = 1500.0, half: float = float("inf"), rho: float = 1.0) -> tuple[list, list, list]:
    """Elo over the next rows (lists t, season, a, b, y) in order of t: batched updates, decay toward ``start`` by half-life in hours,
    and a shrink of all ratings by rho at the first batch of a new season. Returns p and both ratings before. The state, empty at
    first, holds a rating a team and the open batch's changes, so that rows may come in any pieces."""
    rating, seen, change = (state.setdefault(n, {}) for n in ("rating", "seen", "change"))
    p, ra, rb = [], [], []
    decays = half != float("inf")

    def now(team, at):
        r = rating.get(team, start)
        return r if not decays or team not in seen else start + (r - start) * 2.0 ** (-(at - seen[team]) / half)

    for t, season, a, b, y in zip(*(rows[c] for c in ("t", "season", "a", "b", "y"))):
        if t != state.get("t"):
            close(state, now)
            if state.get("season") is not None and season != state["season"] and rho < 1:
                for team in rating:
                    rating[team] = start + rho * (rating[team] - start)
            state["season"], state["t"] = season, t
        x, z = now(a, t), now(b, t)
        q = 1 / (1 + 10 ** ((z - x) / scale))
        d = k * (y - q)
        change[a] = change.get(a, 0.0) + d
        change[b] = change.get(b, 0.0) - d
        p.append(q)
        ra.append(x)
        rb.append(z)
    state["now"] = now
    return p, ra, rb


def close(state: dict, now) -> None:
    """Applies the changes of the batch that is over."""
    for team, d in state["change"].items():
        state["rating"][team] = now(team, state["t"]) + d
        state["seen"][team] = state["t"]
    state["change"].clear()


def fold(rows: pd.DataFrame, k: float, scale: float = 400.0, start: float = 1500.0, half: float = float("inf"), rho: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
    """``step`` over all rows (t, season, a, b, y) at once. Returns p, both ratings before, and the final ratings."""
    if not 0 <= rho <= 1:
        raise ValueError("rho is not in [0, 1]")
    state: dict = {}
    out = step(state, {c: rows[c].tolist() for c in ("t", "season", "a", "b", "y")}, k, scale, start, half, rho)
    close(state, state["now"])
    return *map(np.array, out), state["rating"]


def rate(labelled: DataFrame, configs: list[dict]) -> DataFrame:
    """Runs every configuration over ``labelled`` (series_id, t, season, a, b, y), each in one task that holds a batch of rows."""
    if any(not 0 <= c.get("rho", 1) <= 1 for c in configs):
        raise ValueError("rho is not in [0, 1]")

    def run(state: dict, b: pa.RecordBatch, league: str, c: dict) -> pa.RecordBatch:
        rows = {n: b.column(n).to_pylist() for n in ("t", "season", "a", "b", "y")}
        p, ra, rb = step(state, rows, float(c["k"]), float(c.get("scale", 400)), half=float(c.get("half", "inf")), rho=float(c.get("rho", 1)))
        return pa.RecordBatch.from_pydict({"config": pa.repeat(pa.scalar(c["name"], pa.string()), b.num_rows), "series_id": b.column("series_id").cast(pa.int64()), **{n: pa.array(v, pa.float64()) for n, v in (("p", p), ("before_a", ra), ("before_b", rb))}})

    return in_order(labelled, configs, run, RATED)


def smoothed_win_rates(labelled: DataFrame, m: float = 10.0) -> DataFrame:
    """Beta-smoothed win rates before each row, combined by log5: needs no fold, only prior windows."""
    from ..functions import columns as C

    sides = labelled.select("series_id", "t", F.explode(F.array(F.struct(F.lit("a").alias("s"), F.col("a").alias("team"), F.col("y").alias("w")), F.struct(F.lit("b").alias("s"), F.col("b").alias("team"), (1 - F.col("y")).alias("w")))).alias("x")).select("series_id", "t", "x.*")
    f = Window.partitionBy("team").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    r = C.shrunk(F.coalesce(F.sum("w").over(f), F.lit(0)), F.count("*").over(f), m)
    rated = sides.select("series_id", "s", r.alias("r"))
    wide = rated.groupBy("series_id").agg(F.max(F.when(F.col("s") == "a", F.col("r"))).alias("ra"), F.max(F.when(F.col("s") == "b", F.col("r"))).alias("rb"))
    return wide.select("series_id", F.round("ra", 6).alias("rate_a"), F.round("rb", 6).alias("rate_b"), F.round(C.log5(F.col("ra"), F.col("rb")), 6).alias("p"))
