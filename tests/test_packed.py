"""What a query says of one game or one response is decided inside a row: nothing exploded is shuffled, odd rows keep their results."""

import pytest
from pyspark.sql import functions as F

from skirmish.operators import checks as K
from skirmish.operators import history as H
from skirmish.operators import roster as R
from skirmish.plans import audits, registry


@pytest.mark.parametrize(("name", "most"), [
    ("f12_literal_parse", 2), ("p06_draft_quality", 1), ("w11_sequential_draft", 1), ("s18_series_players", 1), ("s18_detail_games", 1), ("s18_game_players", 1), ("p09_lineup_flags", 1), ("p10_game_flags", 3), ("a31_response_checks", 5), ("a27_coverage", 4), ("a28_historical_coverage", 10), ("a38_collection_status", 7), ("j15_dated_candidates", 3),
])
def test_few_exchanges(spark, sf, name, most):
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= most, plan.count("Exchange hashpartitioning")


def test_cells_that_are_no_json_are_read_as_literals(spark):
    cells = {
        1: "[{'team': 0, 'kind': 'P', 'hero': 7, 'note': None}, {'team': 1, 'kind': 'None', 'hero': 12, 'note': 'None'}]", 2: "[{'team': 0, 'kind': \"it's\", 'hero': 0x10}]", 3: "[{'team': 1, 'kind': 'a\\\\n: None, b', 'hero': 1_000}]",
        4: "[]", 5: "[{'team': 1, 'kind': 'P', 'hero': 3},]", 6: "[" + ", ".join(["{'team': 0, 'kind': 'P', 'hero': 1, 'note': None}"] * 400) + "]", 7: "({'team': 1, 'kind': 'P', 'hero': 0},)",
    }
    got = {r.draft: [(e.team, e.kind, e.hero) for e in r.e] for r in audits.parsed_cells(spark.createDataFrame(list(cells.items()), "draft long, cell string")).collect()}
    import ast

    assert got == {k: [(e["team"], e["kind"], e["hero"]) for e in ast.literal_eval(c)] for k, c in cells.items()}


def test_drafts_with_a_place_twice_are_counted(spark):
    rows = [(1, [(1, "B", 0), (5, "P", 1)]), (2, [(1, "B", 0), (1, "B", 0), (18, "P", 1)]), (3, [(70, "P", 0), (0, "P", 0)])]
    df = spark.createDataFrame(rows, "draft long, e array<struct<seq:int,kind:string,side:int>>")
    got = {(r.draft, r.j): (r.bans_a, r.bans_b, r.picks_a, r.picks_b) for r in H.sequential_draft(df).collect()}
    for draft, e in rows:
        for j in range(19):
            assert got[draft, j] == tuple(sum(s <= j and (k, x) == c for s, k, x in e) for c in (("B", 0), ("B", 1), ("P", 0), ("P", 1)))


def test_flags_inside_the_row_are_those_of_exploded_rows(spark):
    player = lambda pid, pos, hero, name="h": f'{{"playerid":"{pid}","position":{pos},"hero_id":{hero},"hero_name":"{name}"}}'
    side = lambda first, pos=None: [player(f"p{first + i}", (i + 1) if pos is None else pos, first + i + 1) for i in range(5)]
    listed = ",".join(f'{{"playerid":"p{i}","team_id":"{"A" if i < 5 else "B"}"}}' for i in range(10))
    rounds = {
        1: [(1, [*side(0), *side(5)]), (2, [*side(0, 0), *side(5)]), (3, None), (4, [])], 2: [(1, side(0)), (1, side(5))], 3: [(1, [*side(0)[:4], player("x", 5, 99), *side(5)])],
        4: [(1, [*side(0)[:4], player("p0", 5, 1), *side(5)])], 5: [(1, [*side(0)[:4], player("", 5, "null", ""), *side(5, 3)]), (2, [*side(0)[:3], *side(5)])],
    }
    body = lambda rs: '{"result":0,"data":{"players":[' + listed + '],"round_details":[' + ",".join(f'{{"round":{n},"win_team":"A","vid":"v"' + ("" if p is None else ',"players":[' + ",".join(p) + "]") + "}" for n, p in rs) + "]}}"
    d = spark.createDataFrame([(k, body(rs)) for k, rs in rounds.items()], "scheduleid long, body string")
    cols = ["scheduleid", "round", "win_team_slot", "no_id", "no_hero", "flags"]
    want = R.lineup_flags(R.detail_games(d), R.game_players(d)).select(*cols)
    got = K.lineup_flags(K.parsed_responses(d, R.DETAIL, R.UNKNOWN, by_number=True)).select(*cols)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.where(F.col("flags") != "").count() >= 7
