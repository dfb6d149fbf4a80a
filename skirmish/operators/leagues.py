"""More rating folds: each is a small sequential pass inside a group of (configuration, league); a league's rows are first packed
to one row per batch of equal time, so that the grid of configurations multiplies batches, not rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SCALE = 1500.0, 400.0


def expected(a: float, b: float) -> float:
    return 1 / (1 + 10 ** ((b - a) / SCALE))


def packed(rows: DataFrame, league: Column | None = None) -> DataFrame:
    """(league, t, season, b): a row per league and batch of equal time; b holds (series_id, a, b, y) in order of the series."""
    return rows.groupBy((F.lit("all") if league is None else league).alias("league"), "t").agg(F.min("season").alias("season"), F.array_sort(F.collect_list(F.struct("series_id", "a", "b", "y"))).alias("b"))


def by_league(batches: DataFrame, configs: list[dict], fold, schema: str) -> DataFrame:
    """Runs ``fold(batches in order of time, config)`` per configuration and league. The grid is a literal list of parameters."""
    grid = batches.sparkSession.createDataFrame([(i, repr(sorted(c.items()))) for i, c in enumerate(configs)], "config int, parameters string")

    order = [c for c in ("t", "series_id") if c in batches.columns]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return fold(pdf.sort_values(order, kind="stable"), key[1], configs[key[0]])

    return batches.crossJoin(F.broadcast(grid)).groupBy("config", "league").applyInPandas(run, schema)  # a few hundred configurations


def in_order(rows: DataFrame, configs: list[dict], step, schema: str, late: dict[str, Column] | None = None) -> DataFrame:
    """Runs every configuration over the rows of every league (one, where there is no such column) in order of (t, series_id).

    ``step(state, batch, league, config)`` gets an Arrow batch and returns one; the state, a dict that is empty at first, goes from
    batch to batch. So a task holds a batch and the state, however long the history: rows are sorted by Spark, which spills.
    ``late`` columns are computed after the sort, so that what is wide is neither shuffled nor spilled.
    """
    grid = rows.sparkSession.createDataFrame([(i,) for i in range(len(configs))], "config int")
    keys = ["config", "league"]

    def run(batches):
        at, state = None, {}
        for b in batches:
            own = list(zip(b.column("config").to_pylist(), b.column("league").to_pylist()))
            cuts = [0, *(i for i in range(1, len(own)) if own[i] != own[i - 1]), len(own)] if own else [0]
            for first, last in zip(cuts, cuts[1:]):
                if own[first] != at:
                    at, state = own[first], {}
                yield step(state, b.slice(first, last - first), at[1], configs[at[0]])

    one = rows if "league" in rows.columns else rows.withColumn("league", F.lit("all"))
    sorted_ = one.crossJoin(F.broadcast(grid)).repartition(*keys).sortWithinPartitions(*keys, "t", "series_id")  # a few hundred configurations
    return sorted_.withColumns(late or {}).mapInArrow(run, schema)


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def plain_fold(pdf: pd.DataFrame, league: str, c: dict) -> pd.DataFrame:
    """Row by row (R0a): no batches; every row is rated from all rows before it in (time, series)."""
    rating, out = {}, []
    for batch in pdf.b:
        for r in batch:
            a, b = rating.get(r["a"], START), rating.get(r["b"], START)
            p = expected(a, b)
            out.append((league, r["series_id"], a, b, p))
            rating[r["a"]], rating[r["b"]] = a + c["k"] * (r["y"] - p), b - c["k"] * (r["y"] - p)
    return pd.DataFrame(out, columns=["league", "series_id", "before_a", "before_b", "p"])


def slot_fold(pdf: pd.DataFrame, league: str, c: dict) -> pd.DataFrame:
    """Batched; a team without a rating starts at start + share x (its predecessor's rating - start), as of its first rows."""
    rating, out, before = {}, [], c["predecessors"]

    def now(team):
        if team not in rating and team in before:
            return START + c["share"] * (rating.get(before[team], START) - START)
        return rating.get(team, START)

    for batch in pdf.b:
        change: dict = {}
        for r in batch:
            a, b = now(r["a"]), now(r["b"])
            p = expected(a, b)
            out.append((league, c["share"], r["series_id"], a, b, p))
            change.setdefault(r["a"], a)
            change.setdefault(r["b"], b)
            change[r["a"]] += c["k"] * (r["y"] - p)
            change[r["b"]] -= c["k"] * (r["y"] - p)
        rating.update(change)
    return pd.DataFrame(out, columns=["league", "share", "series_id", "before_a", "before_b", "p"])


def final_fold(pdf: pd.DataFrame, league: str, c: dict) -> pd.DataFrame:
    """Season-reset ratings over all rows, then one more reset for the next season: both ratings of every team, its last time
    and its number of series."""
    rating, last, n, season = {}, {}, {}, None
    for t, s, batch in zip(pdf.t, pdf.season, pdf.b):
        if season is not None and s != season:
            rating = {k: START + c["rho"] * (v - START) for k, v in rating.items()}
        season, change = s, {}
        for r in batch:
            p = expected(rating.get(r["a"], START), rating.get(r["b"], START))
            d = c["k"] * (r["y"] - p)
            change[r["a"]], change[r["b"]] = change.get(r["a"], 0.0) + d, change.get(r["b"], 0.0) - d
            for q in (r["a"], r["b"]):
                last[q], n[q] = t, n.get(q, 0) + 1
        for q, d in change.items():
            rating[q] = rating.get(q, START) + d
    return pd.DataFrame([(league, k, v, START + c["rho"] * (v - START), last[k], n[k]) for k, v in rating.items()], columns=["league", "team", "before_reset", "rating", "last_t", "n"])


def game_fold(pdf: pd.DataFrame, league: str, c: dict) -> pd.DataFrame:
    """``game_step`` over a whole league in order."""
    return game_step({}, pa.RecordBatch.from_pandas(pdf, preserve_index=False), league, c).to_pandas()


def game_step(state: dict, batch: pa.RecordBatch, league: str, c: dict) -> pa.RecordBatch:
    """Game ratings: each team decays by half-life in hours and is drawn in by rho at its own new season when its series begins;
    PRE rates all games of a series from its start, LIVE from the games before. ``series_aware`` adds a series' changes at its
    end. Games without a winner are skipped. Series are taken in order of (time, series)."""
    rating, seen, season = (state.setdefault(n, {}) for n in ("rating", "seen", "season"))
    k, half, rho, aware = c["k"], c.get("half", math.inf), c.get("rho", 1.0), c.get("series_aware", False)
    games = batch.column("games")
    offsets, number = games.offsets.to_numpy(), games.values.field("game_number").to_numpy(zero_copy_only=False)
    result = pc.fill_null(games.values.field("y"), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, results = offsets.tolist(), result.tolist()
    pre_of, live_of = [], []

    def prepare(team, t, s):
        r = rating.get(team, START)
        if team in seen and not math.isinf(half):
            r = START + (r - START) * 0.5 ** ((t - seen[team]) / half)
        if team in season and season[team] != s:
            r = START + rho * (r - START)
        rating[team], seen[team], season[team] = r, t, s

    for i, (t, s, a, b) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("t", "season", "a", "b_team")))):
        prepare(a, t, s)
        prepare(b, t, s)
        pre, held = expected(rating[a], rating[b]), 0.0
        for y in results[ends[i] : ends[i + 1]]:
            if y < 0:
                continue
            live = pre if aware else expected(rating[a], rating[b])
            pre_of.append(pre)
            live_of.append(live)
            if aware:
                held += y - pre
            else:
                d = k * (y - live)
                rating[a], rating[b] = rating[a] + d, rating[b] - d
        rating[a], rating[b] = rating[a] + k * held, rating[b] - k * held
    # the games before, of the same series: running counts less those at the series' first game
    own = slice(ends[0], ends[-1])
    result, decided = result[own], result[own] >= 0
    first = np.repeat(offsets[:-1] - offsets[0], np.diff(offsets))
    before = [(r := np.concatenate([[0], np.cumsum(result == v)]))[:-1] - r[first] for v in (1, 0)]
    sid = np.repeat(batch.column("series_id").to_numpy(), np.diff(offsets))[decided]
    n = len(sid)
    return _batch(
        name=pa.repeat(pa.scalar(c["name"], pa.string()), n), league=pa.repeat(pa.scalar(league, pa.string()), n), series_id=pa.array(sid, pa.int64()), game_number=pa.array(number[own][decided], pa.int32()),
        p_pre=pa.array(pre_of, pa.float64()), p_live=pa.array(live_of, pa.float64()), wins_a=pa.array(before[0][decided], pa.int32()), wins_b=pa.array(before[1][decided], pa.int32()),
    )


def player_fold(pdf: pd.DataFrame, league: str, c: dict) -> pd.DataFrame:
    """``player_step`` over a whole league in order."""
    return player_step({}, pa.RecordBatch.from_pandas(pdf, preserve_index=False), league, c).to_pandas()


PLAYER_COLUMNS = ["strength_a", "strength_b", "p", "max_a", "min_a", "std_a", "max_b", "min_b", "std_b", "gap"]


def _mean(x: list) -> float:
    total = 0.0
    for v in x:  # not sum(), which compensates
        total += v
    return total / len(x)


def player_step(state: dict, batch: pa.RecordBatch, league: str, c: dict) -> pa.RecordBatch:
    """Player ratings: a side's strength is the mean of its players' ratings, each drawn to the start by n / (n + m) games. P2
    expects from both sides, P1 from a side against the start. Per series: both strengths and p before it. ``mode`` game updates
    with every decided game's line-ups, series with all who played and the series' result. Series of one time see each other
    only if they come later in order, so they are rated together and updated after: their line-ups are held until then.
    """
    points, seen, held = state.setdefault("points", {}), state.setdefault("seen", {}), state.setdefault("held", [])
    k, m, both, by_game = c["k"], c["m"], c["variant"] == "P2", c["mode"] == "game"

    def drawn(who: list) -> list:
        return [points.get(p, 0.0) * (seen.get(p, 0) / (seen.get(p, 0) + m) if m else 1.0) for p in who]

    def learn(sides: tuple, y: int) -> None:
        own = [_mean(drawn(s)) for s in sides]
        against = own[::-1] if both else (0.0, 0.0)
        gain = [k * (r - expected(o, x)) for r, o, x in zip((y, 1 - y), own, against)]
        for s, g in zip(sides, gain):
            for p in s:
                points[p] = points.get(p, 0.0) + g
                seen[p] = seen.get(p, 0) + 1

    games = batch.column("games")
    ends, g = games.offsets.to_pylist(), games.values
    sides = [(g.field(n).offsets.to_pylist(), g.field(n).values.to_pylist()) for n in ("la", "lb")]
    results = pc.fill_null(g.field("y"), -1).to_pylist()
    rows = []
    for i, (t, y) in enumerate(zip(batch.column("t").to_pylist(), batch.column("y").to_pylist())):
        if t != state.get("t"):
            for who, r in held:
                learn(who, r)
            held.clear()
            state["t"] = t
        own = range(ends[i], ends[i + 1])
        line = [[v[o[j] : o[j + 1]] for j in own] for o, v in sides]
        squad = [sorted({p for x in side for p in x}) for side in line]
        levels = [drawn(s) for s in squad]
        mean = [_mean(x) if x else 0.0 for x in levels]
        spread = [v for x, mu in zip(levels, mean) for v in ((max(x) + START, min(x) + START, math.sqrt(_mean([(u - mu) ** 2 for u in x]))) if x else (None,) * 3)]
        rows.append((START + mean[0], START + mean[1], expected(*mean), *spread, mean[0] - mean[1] if all(levels) else None))
        if by_game:
            held += [((a, b), results[j]) for j, a, b in zip(own, *line) if results[j] >= 0 and a and b]
        elif y is not None and all(squad):
            held.append((tuple(squad), y))
    n = batch.num_rows
    head = {"name": pa.repeat(pa.scalar(c["name"], pa.string()), n), "league": pa.repeat(pa.scalar(league, pa.string()), n), "series_id": batch.column("series_id").cast(pa.int64())}
    return _batch(**head, **{name: pa.array([r[j] for r in rows], pa.float64()) for j, name in enumerate(PLAYER_COLUMNS)})
