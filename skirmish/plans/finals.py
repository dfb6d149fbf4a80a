"""Queries of the simulated finals; the SQL plays the same simulations from the same hashed uniforms, in rows instead of columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import brackets as K
from ..operators import tournament as T
from .base import query

N = 2000
RATINGS = [1640.0, 1600.0, 1570.0, 1540.0, 1520.0, 1500.0, 1590.0, 1560.0, 1530.0, 1510.0, 1470.0, 1430.0]
_R = "([" + ", ".join(map(str, RATINGS)) + "]::DOUBLE[])[{} + 1]"


def _u(*parts):
    return "CAST(('0x' || substr(md5(" + " || '|' || ".join([*parts, "'1'"]) + "), 1, 8)) AS BIGINT) / 4294967296.0"


def _lit(x):
    return f"'{x}'"


def _elo(a, b):
    return f"1 / (1 + pow(10.0, ({_R.format(b)} - {_R.format(a)}) / 400.0))"


_BO5 = "pow({p}, 3) * (1 + 3 * (1 - {p}) + 6 * pow(1 - {p}, 2))"
_BO7 = "(pow({p}, 4) * (1 + 4 * (1 - {p}) + 10 * pow(1 - {p}, 2) + 20 * pow(1 - {p}, 3)))"


def _play(cte, before, name, a, b, win, lose):
    """One more match: a CTE that adds the winner and the loser of best of seven."""
    p = _BO7.format(p="pp")
    hit = f"{_u('sim', _lit(name))} < {p}"
    return f"{cte} AS MATERIALIZED (SELECT * EXCLUDE (aa, bb, pp), CASE WHEN {hit} THEN aa ELSE bb END AS {win}, CASE WHEN {hit} THEN bb ELSE aa END AS {lose} FROM (SELECT *, {_elo('aa', 'bb')} AS pp FROM (SELECT *, {a} AS aa, {b} AS bb FROM {before})))"


def _stage1_sql(n):
    g = "CASE WHEN won THEN q ELSE 1 - q END"
    return f"""
met AS (SELECT sim, m, e, q, {_u('sim', "'S' || m || '-' || e")} < {_BO5.format(p='q')} AS won FROM (SELECT sim, m, e, {_elo('m', 'e')} AS q FROM range({n}) s(sim), range(6) a(m), range(6, 12) b(e))),
mar AS (SELECT *, {_u('sim', "'G' || m || '-' || e")} * (1.0 + 3 * (1 - g) + 6 * (1 - g) * (1 - g)) AS u FROM (SELECT *, {g} AS g FROM met)),
res AS (SELECT sim, m, e, won, (CASE WHEN won THEN 1 ELSE -1 END) * (3 - CAST(u >= 1.0 AS INTEGER) - CAST(u >= 1.0 + 3 * (1 - g) AS INTEGER)) AS d FROM mar),
tab AS (SELECT sim, team, CAST(sum(CAST(d > 0 AS INTEGER)) AS INTEGER) AS wins, CAST(sum(d) AS INTEGER) AS diff FROM (SELECT sim, m AS team, d FROM res UNION ALL SELECT sim, e, -d FROM res) GROUP BY 1, 2),
lot AS (SELECT *, CASE WHEN team < 6 THEN 'master' ELSE 'elite' END AS grp, {_u('sim', "'L' || CASE WHEN team < 6 THEN 'master' ELSE 'elite' END || team")} AS u FROM tab),
rk AS (SELECT *, row_number() OVER (PARTITION BY sim, grp ORDER BY wins DESC, diff DESC, u DESC) AS place FROM lot),
grp AS MATERIALIZED (SELECT sim, list(team ORDER BY place) FILTER (grp = 'master') AS master, list(team ORDER BY place) FILTER (grp = 'elite') AS elite FROM rk GROUP BY sim)"""


def _finals_sql(n):
    weak = f"list_sort([struct_pack(r := {_R.format('elite[2]')}, i := 1, t := elite[2]), struct_pack(r := {_R.format('elite[3]')}, i := 2, t := elite[3]), struct_pack(r := {_R.format('elite[4]')}, i := 3, t := elite[4]), struct_pack(r := {_R.format('elite[5]')}, i := 4, t := elite[5])])"
    parts = [_stage1_sql(n), f"weak AS (SELECT *, list_transform({weak}, lambda x: x.t) AS w FROM grp)"]
    parts.append("pick AS (SELECT * EXCLUDE (w), w[1] AS p1, w[2] AS p2, list_filter(elite[2:5], lambda x: x <> w[1] AND x <> w[2]) AS rest FROM weak)")
    parts += [_play("bt1", "pick", "BT1", "master[5]", "p1", "b1", "x1"), _play("bt2", "bt1", "BT2", "master[6]", "p2", "b2", "x2"), _play("bt3", "bt2", "BT3", "rest[1]", "rest[2]", "b3", "x3")]
    lots = ", ".join(f"struct_pack(u := {_u('sim', _lit('Dr'), t)}, t := {t})" for t in ("master[3]", "master[4]", "elite[1]", "b1", "b2", "b3"))
    parts.append(f"d0 AS MATERIALIZED (SELECT *, {_u('sim', _lit('Df'))} < 0.5 AS flip, 2 * CAST(floor({_u('sim', _lit('Da'))} * 2) AS INTEGER) AS qa, 4 + 2 * CAST(floor({_u('sim', _lit('Db'))} * 2) AS INTEGER) AS qb, list_transform(list_sort([{lots}]), lambda x: x.t) AS rs FROM bt3)")
    slot = "CASE WHEN i = qa THEN CASE WHEN flip THEN master[2] ELSE master[1] END WHEN i = qb THEN CASE WHEN flip THEN master[1] ELSE master[2] END ELSE rs[1 + i - CAST(qa < i AS INTEGER) - CAST(qb < i AS INTEGER)] END"
    parts.append(f"m0 AS MATERIALIZED (SELECT * EXCLUDE (flip, qa, qb, rs), list_transform([0, 1, 2, 3, 4, 5, 6, 7], lambda i: {slot}) AS slots FROM d0)")
    at = {"S1": "slots[1]", "S8": "slots[2]", "S4": "slots[3]", "S5": "slots[4]", "S2": "slots[5]", "S7": "slots[6]", "S3": "slots[7]", "S6": "slots[8]"}
    before = "m0"
    for name, x, y in T.BRACKET:
        k = name[1:]
        parts.append(_play(f"m{k}", before, name, at[x], at[y], f"w{k}", f"l{k}"))
        at[f"W{name}"], at[f"L{name}"], before = f"w{k}", f"l{k}", f"m{k}"
    among = lambda cols: f"team IN ({', '.join(cols)})"
    played = " + ".join(f"CAST({among([f'w{i}', f'l{i}'])} AS INTEGER)" for i in range(1, 15))
    parts.append(f"""team AS MATERIALIZED (SELECT *, direct OR breakthrough_win AS knockout, end_ IN ('FINAL', 'CHAMPION') AS final, end_ = 'CHAMPION' AS champion, p + CAST(breakthrough AS INTEGER) + 6 AS series, p + CAST(breakthrough AS INTEGER) AS bo7 FROM (
 SELECT sim, team, list_contains(master[1:4], team) OR elite[1] = team AS direct, {among(['b1', 'b2', 'b3', 'x1', 'x2', 'x3'])} AS breakthrough, {among(['b1', 'b2', 'b3'])} AS breakthrough_win, {played} AS p,
  CASE WHEN team = w14 THEN 'CHAMPION' WHEN team = l14 THEN 'FINAL' WHEN team = l13 THEN 'LB_F' WHEN team = l12 THEN 'LB_SF' WHEN {among(['l9', 'l10'])} THEN 'LB_R2' WHEN {among(['l7', 'l8'])} THEN 'LB_R1' WHEN {among(['x1', 'x2', 'x3'])} THEN 'BREAKTHROUGH' ELSE 'STAGE1' END AS end_
 FROM m14, range(12) r(team)))""")
    return ", ".join(parts)


STAGE1, FINALS = _stage1_sql(N), _finals_sql(N)


def sims(spark, **kw):
    return K.finals(spark, N, RATINGS, **kw)


@query("t03_stage1", "", f"WITH {STAGE1} SELECT CAST(team AS INTEGER) AS team, wins, diff, count(*) AS n FROM tab GROUP BY 1, 2, 3")
def t03(spark, sf):
    return K.stage1(spark, N, RATINGS).select(F.posexplode_outer(F.arrays_zip("wins", "diff")).alias("team", "x")).groupBy("team", "x.wins", "x.diff").agg(F.count("*").alias("n"))


@query("t04_tie_audit", "", f"""
WITH {STAGE1}, a AS (SELECT grp, place, wins = lead(wins) OVER w AS tied, wins = lead(wins) OVER w AND diff = lead(diff) OVER w AS fallback FROM rk WINDOW w AS (PARTITION BY sim, grp ORDER BY place))
SELECT grp, CAST(place - 1 AS INTEGER) AS place, count(*) FILTER (tied) AS tied, count(*) FILTER (tied AND NOT fallback) AS by_difference, count(*) FILTER (fallback) AS fallback FROM a WHERE tied IS NOT NULL GROUP BY 1, 2""")
def t04(spark, sf):
    """Per group and boundary: simulations tied on wins, settled by game difference, and left to the lot."""
    s = K.ranked(K.ranked(K.stage1(spark, N, RATINGS), "master", K.MASTER), "elite", K.ELITE)
    groups = F.array(*[F.struct(F.lit(g).alias("grp"), F.arrays_zip(F.col(f"{g}_tied").alias("t"), F.col(f"{g}_fallback").alias("f")).alias("a")) for g in ("master", "elite")])
    x = s.select(F.explode_outer(groups).alias("g")).select("g.grp", F.posexplode_outer("g.a").alias("place", "a")).select("grp", "place", F.col("a")["t"].alias("t"), F.col("a")["f"].alias("f"))
    return x.groupBy("grp", "place").agg(F.count_if("t").alias("tied"), F.count_if(F.col("t") & ~F.col("f")).alias("by_difference"), F.count_if("f").alias("fallback"))


@query("t05_breakthrough", "", f"WITH {FINALS} SELECT CAST(team AS INTEGER) AS team, count(*) FILTER (breakthrough) AS played, count(*) FILTER (breakthrough_win) AS won FROM team GROUP BY 1")
def t05(spark, sf):
    return K.team_rows(sims(spark)).groupBy("team").agg(F.count_if("breakthrough").alias("played"), F.count_if("breakthrough_win").alias("won"))


@query("t06_draw", "", f"WITH {FINALS} SELECT CAST(i AS INTEGER) AS slot, CAST(slots[i + 1] AS INTEGER) AS team, count(*) AS n FROM m14, range(8) r(i) GROUP BY 1, 2")
def t06(spark, sf):
    return sims(spark).select(F.posexplode_outer("slots").alias("slot", "team")).groupBy("slot", "team").agg(F.count("*").alias("n"))


@query("t08_team_ends", "", f"WITH {FINALS} SELECT CAST(team AS INTEGER) AS team, end_ AS \"end\", count(*) AS n FROM team GROUP BY 1, 2")
def t08(spark, sf):
    return K.team_rows(sims(spark)).groupBy("team", "end").agg(F.count("*").alias("n"))


@query("t10_paths", "", f"WITH {FINALS} SELECT CAST(team AS INTEGER) AS team, CAST(sum(series) AS BIGINT) AS series, CAST(sum(bo7) AS BIGINT) AS bo7, CAST(sum(series - bo7) AS BIGINT) AS bo5 FROM team GROUP BY 1")
def t10(spark, sf):
    """Series that a team plays on its way, by length."""
    return K.team_rows(sims(spark)).groupBy("team").agg(F.sum("series").alias("series"), F.sum("bo7").alias("bo7"), F.sum(F.col("series") - F.col("bo7")).alias("bo5"))


@query("t10_opponents", "", f"""
WITH {FINALS}, o AS ({' UNION ALL '.join(f"SELECT w{i} AS team, l{i} AS opponent, 1 AS won FROM m14 UNION ALL SELECT l{i}, w{i}, 0 FROM m14" for i in range(1, 15))})
SELECT CAST(team AS INTEGER) AS team, count(*) AS n, CAST(sum(won) AS BIGINT) AS won, round(avg({_R.format('opponent')}), 4) AS mean_opponent FROM o GROUP BY 1""")
def t10o(spark, sf):
    """How strong the opponents of the knockout were: difficulty of a team's path."""
    m = F.array(*[F.struct(F.col(f"w{i}").alias("w"), F.col(f"l{i}").alias("l")) for i in range(1, 15)])
    x = sims(spark).select(F.explode_outer(m).alias("m")).select(F.explode_outer(F.array(F.struct(F.col("m.w").alias("team"), F.col("m.l").alias("opponent"), F.lit(1).alias("won")), F.struct(F.col("m.l").alias("team"), F.col("m.w").alias("opponent"), F.lit(0).alias("won")))).alias("x")).select("x.*")
    return x.groupBy("team").agg(F.count("*").alias("n"), F.sum("won").alias("won"), F.round(F.avg(F.get(T.strengths(RATINGS), F.col("opponent"))), 4).alias("mean_opponent"))


@query("t11_milestones", "", f"""
WITH {FINALS} SELECT CAST(team AS INTEGER) AS team, round(count(*) FILTER (direct) / {N}.0, 6) AS p_direct, round(count(*) FILTER (knockout) / {N}.0, 6) AS p_knockout, round(count(*) FILTER (final) / {N}.0, 6) AS p_final, round(count(*) FILTER (champion) / {N}.0, 6) AS p_champion,
 CASE WHEN count(*) FILTER (knockout) > 0 THEN round(count(*) FILTER (champion) / count(*) FILTER (knockout), 6) END AS p_champion_if_knockout, CASE WHEN count(*) FILTER (final) > 0 THEN round(count(*) FILTER (champion) / count(*) FILTER (final), 6) END AS p_champion_if_final FROM team GROUP BY 1""")
def t11(spark, sf):
    return milestones(K.team_rows(sims(spark)))


def milestones(teams, *keys):
    n, c = F.count("*"), lambda x: F.count_if(F.col(x))
    given = lambda x: F.when(c(x) > 0, F.round(c("champion") / c(x), 6))
    return teams.groupBy(*keys, "team").agg(*[F.round(c(x) / n, 6).alias(f"p_{x}") for x in ("direct", "knockout", "final", "champion")], given("knockout").alias("p_champion_if_knockout"), given("final").alias("p_champion_if_final"))


_COUNTS = {"STAGE1": 1, "BREAKTHROUGH": 3, "LB_R1": 2, "LB_R2": 2, "LB_SF": 1, "LB_F": 1, "FINAL": 1, "CHAMPION": 1}


@query("t12_simulation_invariants", "", f"""
WITH {FINALS}, per AS (SELECT sim, count(*) FILTER (champion) = 1 AS champion_one, count(*) FILTER (final) = 2 AS final_two, count(*) FILTER (knockout) = 8 AS knockout_eight, bool_and(NOT champion OR final) AS champion_is_finalist, bool_and(NOT final OR knockout) AS finalist_in_knockout,
 count(*) FILTER (direct) = 5 AS direct_five, count(*) FILTER (breakthrough) = 6 AS breakthrough_six, count(*) FILTER (end_ = 'STAGE1') = 1 AS stage1_one, count(*) FILTER (breakthrough_win) = 3 AS breakthrough_winners_three,
 bool_and(CAST(direct AS INTEGER) + CAST(breakthrough AS INTEGER) + CAST(end_ = 'STAGE1' AS INTEGER) = 1) AS stage1_partition, bool_and(knockout = (direct OR breakthrough_win)) AS knockout_is_direct_or_winner, count(end_) = 12 AS every_team_ends_once,
 {' AND '.join(f"count(*) FILTER (end_ = '{k}') = {v}" for k, v in _COUNTS.items())} AS ends_counts FROM team GROUP BY sim)
SELECT {', '.join(f'bool_and({c}) AS {c}' for c in ('champion_one', 'final_two', 'knockout_eight', 'champion_is_finalist', 'finalist_in_knockout', 'direct_five', 'breakthrough_six', 'stage1_one', 'breakthrough_winners_three', 'stage1_partition', 'knockout_is_direct_or_winner', 'every_team_ends_once', 'ends_counts'))} FROM per""")
def t12(spark, sf):
    return K.invariants(K.team_rows(sims(spark)))


#: Runs beside the primary one: rules that the organisers have not settled.
VARIANTS = {"primary": {}, "T2": {"rule": "T2"}, "T3": {"rule": "T3"}, "random_choice": {"strategy": "RANDOM"}, "adversarial": {"strategy": "ADVERSARIAL"}, "any_pool": {"pool": "ANY"}, "K2": {"scenario": "K2"}, "K3": {"scenario": "K3"}, "no_seeds": {"scenario": "RANDOM"}, "second_seed": {"seed": "2"}}


def all_runs(spark, names=tuple(VARIANTS)):
    out = None
    for name, kw in ((n, VARIANTS[n]) for n in names):
        t = K.team_rows(sims(spark, **kw)).withColumn("run", F.lit(name))
        out = t if out is None else out.unionByName(t)
    return out


@query("t13_scenarios")
def t13(spark, sf):
    """Milestones of every run."""
    return milestones(all_runs(spark), "run")


@query("t15_sensitivity")
def t15(spark, sf):
    """Per run of the draws, tie rules and seeds: the largest change of a champion's chance against the primary run, its team and its materiality."""
    m = milestones(all_runs(spark, ("primary", "T2", "K2", "no_seeds", "second_seed")), "run").select("run", "team", F.col("p_champion").alias("p"))
    base = m.where("run = 'primary'").select("team", F.col("p").alias("base"))
    d = m.where("run <> 'primary'").join(F.broadcast(base), "team").withColumn("d", F.abs(F.col("p") - F.col("base")))  # twelve teams
    x = d.groupBy("run").agg(F.max("d").alias("max_change"), F.max_by("team", F.struct("d", -F.col("team"))).alias("team"))
    return x.select("run", "team", F.round("max_change", 6).alias("max_change"), F.when(F.col("max_change") < 0.005, "IMMATERIAL").when(F.col("max_change") <= 0.02, "LOW").otherwise("MATERIAL").alias("class"))


@query("t16_fixture_ledger", "", f"""
SELECT 'F' || lpad(CAST(m * 6 + e - 5 AS VARCHAR), 2, '0') AS fixture, CAST(m AS INTEGER) AS team_a, CAST(e AS INTEGER) AS team_b, round(q, 6) AS p_game, round({_BO5.format(p='q')}, 6) AS p_series, round(({_BO5.format(p='q')}) + ({_BO5.format(p='(1 - q)')}), 6) AS both_sides
FROM (SELECT m, e, {_elo('m', 'e')} AS q FROM range(6) a(m), range(6, 12) b(e))""")
def t16(spark, sf):
    """The group stage's fixtures with their chances; both sides add to one."""
    q = C.elo_expected(F.get(T.strengths(RATINGS), F.col("team_a")), F.get(T.strengths(RATINGS), F.col("team_b")))
    f = spark.range(36).select((F.floor(F.col("id") / 6)).cast("int").alias("team_a"), (6 + F.col("id") % 6).cast("int").alias("team_b"), F.format_string("F%02d", F.col("id") + 1).alias("fixture"))
    return f.select("fixture", "team_a", "team_b", F.round(q, 6).alias("p_game"), F.round(C.series_prob(q, 5), 6).alias("p_series"), F.round(C.series_prob(q, 5) + C.series_prob(1 - q, 5), 6).alias("both_sides"))


@query("t09_round_robin_ranks", "", f"""
WITH g AS (SELECT sim, i, j, {_u('sim', "'R' || i || '-' || j")} < {_BO5.format(p='q')} AS won FROM (SELECT sim, i, j, {_elo('i', 'j')} AS q FROM range({N}) s(sim), range(12) a(i), range(12) b(j) WHERE i < j)),
w AS (SELECT sim, team, sum(w) AS w FROM (SELECT sim, i AS team, CAST(won AS INTEGER) AS w FROM g UNION ALL SELECT sim, j, 1 - CAST(won AS INTEGER) FROM g) GROUP BY 1, 2),
r AS (SELECT sim, team, row_number() OVER (PARTITION BY sim ORDER BY w DESC, {_u('sim', "'L' || team")}) - 1 AS place FROM w)
SELECT CAST(team AS INTEGER) AS team, CAST(place AS INTEGER) AS place, count(*) AS n FROM r GROUP BY 1, 2""")
def t09(spark, sf):
    """Neutral format: twelve teams play 66 series; places by wins, then by lot."""
    return T.rank_distribution(T.round_robin(spark, N, RATINGS))


@query("t18_other_wiring")
def t18(spark, sf):
    """The bracket with crossed lower matches: first-round results stay, later ones may change."""
    crossed = [(m, {"LM6": "LM5", "LM5": "LM6"}.get(x, x), y) for m, x, y in T.BRACKET]
    d = K.draw(K.breakthrough(K.ranked(K.ranked(K.stage1(spark, N, RATINGS), "master", K.MASTER), "elite", K.ELITE), RATINGS))
    a, b = K.knockout(d, RATINGS), K.knockout(d, RATINGS, wiring=crossed)
    j = a.select("sim", *[F.col(f"w{i}").alias(f"a{i}") for i in range(1, 15)]).join(b.select("sim", *[F.col(f"w{i}").alias(f"b{i}") for i in range(1, 15)]), "sim")
    return j.agg(F.bool_and((F.col("a1") == F.col("b1")) & (F.col("a4") == F.col("b4"))).alias("same_first_round"), F.bool_or(F.col("a14") != F.col("b14")).alias("differs_later"))

