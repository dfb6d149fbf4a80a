"""Prior state: every value uses rows strictly before the row's time (integer RANGE frames), so ties never see each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.rounding import rounded


def prior(keys: list[str], time: str):
    """The frame of all rows of the keys with a smaller time."""
    return Window.partitionBy(*keys).orderBy(time).rangeBetween(Window.unboundedPreceding, -1)


def prior_sums(df: DataFrame, keys: list[str], time: str, sums: dict[str, Column], width: int | None, source: DataFrame | None = None) -> DataFrame:
    """Adds to every row the sums of ``sums`` (whole-number columns) over all rows of its keys with a smaller time.

    Times are cut into buckets of ``width``. A window over (keys, bucket) has the rows before it in its own bucket; what earlier
    buckets hold is joined from a table of a row per key and bucket, whose partitioning the window already has. So a key with a
    third of all rows is spread over its buckets, and rows are shuffled once. Keys and times are not null. Without a width it is one window over
    the keys, for keys so fine that none of them is large. ``source`` has the same rows before other
    sums were added, so that the bucket table does not compute those again.
    """
    if width is None:
        return df.withColumns({n: F.coalesce(F.sum(c).over(prior(keys, time)), F.lit(0)) for n, c in sums.items()})
    rows = df.withColumn("__b", F.floor(F.col(time) / width))
    inner = Window.partitionBy(*keys, "__b").orderBy(time).rangeBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("__b").rangeBetween(Window.unboundedPreceding, -1)
    totals = (df if source is None else source).groupBy(*keys, F.floor(F.col(time) / width).alias("__b")).agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    base = totals.select(*keys, "__b", *[F.coalesce(F.sum(f"__{n}").over(outer), F.lit(0)).alias(f"__{n}") for n in sums])
    own = rows.withColumns({n: F.coalesce(F.sum(c).over(inner), F.lit(0)) for n, c in sums.items()})
    return own.join(base, [*keys, "__b"]).withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums}).drop("__b", *[f"__{n}" for n in sums])


def _one(condition: Column) -> Column:
    """1 where the condition holds, else 0."""
    return F.when(condition, 1).otherwise(0).cast("long")


STATE_KEYS = {"hero": ["hero"], "team_hero": ["team", "hero"], "pair": ["player", "hero"], "player": ["player"]}
#: Heroes and players are few and may have a large share of all rows each; their pairs are many.
COARSE = ("hero", "player")


def player_hero_state(appearances: DataFrame) -> DataFrame:
    """Per appearance: prior games, wins and win rate (null without a decided game) of the player, the hero, the pair, and the
    hero in the team, at game level (series time, then game)."""
    a = appearances.withColumn("clock", F.col("t") * 1000 + F.col("game_number"))
    base = a  # the bucket tables read the rows as they came
    for name, keys in STATE_KEYS.items():
        won = {f"{name}_games": F.lit(1).cast("long"), f"{name}_wins": _one(F.col("won")), "__decided": _one(F.col("won").isNotNull())}
        a = prior_sums(a, keys, "clock", won, 24 * 90 * 1000 if name in COARSE else None, base)
        a = a.withColumn(f"{name}_rate", F.when(F.col("__decided") > 0, rounded(F.col(f"{name}_wins") / F.col("__decided")))).drop("__decided")
    return a.drop("clock")


def preseries_state(appearances: DataFrame) -> DataFrame:
    """Prior state of the player at series level: games of the same series (and of series at the same time) do not count."""
    per = appearances.groupBy("player", "t").agg(F.count("*").alias("g"), F.count_if("won").alias("w"), F.count("won").alias("d"))
    w = prior(["player"], "t")
    return per.select("player", "t", F.coalesce(F.sum("g").over(w), F.lit(0)).alias("games"), F.coalesce(F.sum("w").over(w), F.lit(0)).alias("wins"), F.coalesce(F.sum("d").over(w), F.lit(0)).alias("decided"))


def draft_sums(events: DataFrame) -> DataFrame:
    """Per draft event: prior picks, bans, wins and decided picks of the hero, and the hero's picks, wins and decided picks in the team;
    the same game, and games of the same time, do not count."""
    pick = F.col("kind") == "P"
    w, d = _one(pick & F.col("won")), _one(pick & F.col("won").isNotNull())
    out = prior_sums(events, ["hero"], "t", {"prior_picks": _one(pick), "prior_bans": _one(F.col("kind") == "B"), "w": w, "d": d}, 24 * 90)
    return prior_sums(out, ["team", "hero"], "t", {"tg": _one(pick), "tw": w, "td": d}, None)


def draft_state(events: DataFrame, m: float = 10.0) -> DataFrame:
    """Per draft event: prior picks, bans and shrunk win rate of the hero, and of the hero in the team (see ``draft_sums``)."""
    rate = lambda w, d: rounded(C.shrunk(F.col(w), F.col(d), m))
    return draft_sums(events).select("draft", "seq", "hero", "kind", "prior_picks", "prior_bans", rate("w", "d").alias("prior_rate"), rate("tw", "td").alias("team_prior_rate"), (F.col("td") >= 5).alias("team_min_sample"))


def pair_sums(appearances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(synergy, counter): per game and pair of heroes of one side, and per game and pair across sides (ordered), prior games, wins and
    decided games. A game makes at most 20 and 50 rows."""
    side = appearances.groupBy("series_id", "t", "game_number", "side", "won").agg(F.array_sort(F.collect_set("hero")).alias("h"))
    inner = F.expr("flatten(transform(h, (x, i) -> transform(slice(h, i + 2, size(h)), y -> struct(x as a, y as b))))")
    pairs = side.select("series_id", "t", "game_number", "side", "won", F.explode(inner).alias("p")).select("series_id", "t", "game_number", "side", "won", "p.*")
    other = side.select("series_id", "game_number", (1 - F.col("side")).alias("side"), F.col("h").alias("o"))
    cross = side.join(other, ["series_id", "game_number", "side"]).select("series_id", "t", "game_number", "side", "won", F.explode(F.expr("flatten(transform(h, x -> transform(o, y -> struct(x as a, y as b))))")).alias("p")).select("series_id", "t", "game_number", "side", "won", "p.*")

    def state(rows):
        rows = rows.withColumn("clock", F.col("t") * 1000 + F.col("game_number"))
        return prior_sums(rows, ["a", "b"], "clock", {"prior_games": F.lit(1).cast("long"), "w": _one(F.col("won")), "prior_decided": _one(F.col("won").isNotNull())}, 24 * 365 * 1000)

    return state(pairs), state(cross)


def pair_state(appearances: DataFrame, m: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """(synergy, counter) with shrunk win rates; see ``pair_sums``."""
    return tuple(s.withColumn("prior_rate", rounded(C.shrunk(F.col("w"), F.col("prior_decided"), m))).drop("clock", "won", "w") for s in pair_sums(appearances))


def shrunk_from(w: Column, d: Column, m: float, least: int) -> Column:
    """The shrunk rate less one half; 0 below ``least`` decided games."""
    return F.when(d >= least, C.shrunk(w, d, m) - 0.5).otherwise(0.0)


#: Of each side of a game, before it: means over its picks, its bans, its pairs, and its pairs against the other side.
STATIC = ["hero_strength", "hero_winrate_raw", "hero_pick_rate", "team_hero_familiarity", "team_hero_strength", "ban_strength", "synergy", "pair_novelty", "counter"]


def static_features(events: DataFrame, appearances: DataFrame, m: float = 10.0, least: int = 5) -> DataFrame:
    """(series_id, game_number, <feature>_a, <feature>_b, <feature>_diff): what a draft's heroes had done before the game's time.

    Rates are shrunk with the weight of ``m`` games and count from ``least`` decided games on; pick rates are over all games before.
    A side without such picks, bans or pairs has nulls.
    """
    games = events.groupBy("t").agg(F.countDistinct("draft").alias("n"))
    before = games.select("t", F.coalesce(F.sum("n").over(Window.orderBy("t").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("games"))  # a row per distinct time
    key = ["series_id", "game_number", "side"]
    e = draft_sums(events).join(before, "t")
    pick, ban = F.col("kind") == "P", F.col("kind") == "B"
    raw = F.when(F.col("d") >= max(least, 1), F.col("w") / F.greatest("d", F.lit(1)) - 0.5).otherwise(0.0)
    of = lambda c, v: F.avg(F.when(c, v))
    drafted = e.groupBy(*key).agg(
        of(pick, shrunk_from(F.col("w"), F.col("d"), m, least)).alias("hero_strength"), of(pick, raw).alias("hero_winrate_raw"), (F.sum(F.when(pick, F.col("prior_picks"))) / (F.count_if(pick) * F.greatest(F.max("games"), F.lit(1)))).alias("hero_pick_rate"), of(pick, F.log1p("tg")).alias("team_hero_familiarity"),
        of(pick, shrunk_from(F.col("tw"), F.col("td"), m, least)).alias("team_hero_strength"), of(ban, shrunk_from(F.col("w"), F.col("d"), m, least)).alias("ban_strength"),
    )
    synergy, counter = pair_sums(appearances)
    v = shrunk_from(F.col("w"), F.col("prior_decided"), m, least)
    own = synergy.groupBy(*key).agg(F.avg(v).alias("synergy"), F.avg((F.col("prior_games") == 0).cast("double")).alias("pair_novelty"))
    against = counter.groupBy(*key).agg(F.avg(v).alias("counter"))
    sides = drafted.join(own, key, "left").join(against, key, "left")
    at = lambda f, s: F.max(F.when(F.col("side") == s, F.col(f)))
    wide = sides.groupBy("series_id", "game_number").agg(*[at(f, s).alias(f"{f}_{x}") for f in STATIC for s, x in ((0, "a"), (1, "b"))])
    return wide.select("series_id", "game_number", *[rounded(F.col(f"{f}_{x}")).alias(f"{f}_{x}") for f in STATIC for x in "ab"], *[rounded(F.col(f"{f}_a") - F.col(f"{f}_b")).alias(f"{f}_diff") for f in STATIC])


def rolling_form(long: DataFrame, k: int = 5) -> DataFrame:
    """Per team and series: wins over the last k series before it. ``long``: series_id, t, team, won."""
    n = F.row_number().over(Window.partitionBy("team").orderBy("t", "series_id", "side"))
    last = Window.partitionBy("team").orderBy("n").rangeBetween(-k, -1)
    return long.withColumn("n", n).select("series_id", "side", "team", "n", F.count("*").over(last).alias("seen"), F.coalesce(F.sum(F.col("won").cast("int")).over(last), F.lit(0)).alias("wins"))


def decayed_players(appearances: DataFrame, last: int = 20, half: float = 3.0) -> DataFrame:
    """Candidates of a team's latest series by decayed games: sum of games x 0.5^(series ago / half) over the last series."""
    per = appearances.groupBy("team", "t", "player").agg(F.count("*").alias("games"))
    order = appearances.select("team", "t").distinct().withColumn("s", F.row_number().over(Window.partitionBy("team").orderBy(F.desc("t"))) - 1).where(F.col("s") < last)
    scored = per.join(order, ["team", "t"]).groupBy("team", "player").agg(F.sum("games").alias("games"), F.round(F.sum(F.col("games") * F.pow(F.lit(0.5), F.col("s") / half)), 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("team").orderBy(F.desc("score"), F.desc("games"), "player"))
    return scored.withColumn("place", place).where("place <= 5")


def rotation(appearances: DataFrame) -> DataFrame:
    """Per series and team: players used, line-up changes between games, distinct line-ups, share of the first line-up kept."""
    line = appearances.groupBy("series_id", "team", "side", "game_number").agg(F.array_sort(F.collect_list("player")).alias("line"))
    w = Window.partitionBy("series_id", "side").orderBy("game_number")
    x = line.withColumn("before", F.lag("line").over(w)).withColumn("first", F.first("line").over(w))
    kept = F.size(F.array_intersect("line", "first")) / F.size("first")
    per = x.groupBy("series_id", "side", "team").agg(F.size(F.array_distinct(F.flatten(F.collect_list("line")))).alias("players"), F.count_if(F.col("before") != F.col("line")).alias("changes"), F.countDistinct("line").alias("lineups"), F.round(F.coalesce(F.avg(F.when(F.col("before").isNotNull(), kept)), F.lit(1.0)), 6).alias("continuity"))
    return per


def hero_usage(appearances: DataFrame) -> DataFrame:
    """Per game and side: heroes that the side used in earlier games of the series, and repeats of them."""
    g = appearances.groupBy("series_id", "side", "game_number").agg(F.collect_set("hero").alias("heroes"))
    used = F.array_distinct(F.flatten(F.collect_list("heroes").over(prior(["series_id", "side"], "game_number"))))
    g = g.withColumn("used", F.coalesce(used, F.array().cast("array<int>")))
    return g.select("series_id", "side", "game_number", F.size("used").alias("n_used"), F.size(F.array_intersect("used", "heroes")).alias("n_repeated"))


def transfers(appearances: DataFrame, player: str = "handle") -> DataFrame:
    """Per player: games, first and last time, sequence of teams with repeats collapsed, changes of team."""
    w = Window.partitionBy(player).orderBy("t", "series_id", "game_number", "side")
    steps = appearances.withColumn("last_team", F.lag("team").over(w))
    moved = F.col("last_team").isNull() | (F.col("last_team") != F.col("team"))
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(moved, F.struct("t", "series_id", "game_number", "side", "team")))), lambda x: x["team"].cast("string")), ">")
    return steps.groupBy(player).agg(F.count("*").alias("games"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), (F.count_if(moved) - 1).alias("transfers"), path.alias("teams"))


def roles(appearances: DataFrame) -> DataFrame:
    """Per hero: games, entropy of positions over ln 5, and the primary position (ties: the smaller)."""
    n = appearances.groupBy("hero", "position").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("hero"))
    q = n.withColumn("q", F.col("n") / total)
    return q.groupBy("hero").agg(F.sum("n").alias("games"), F.round(F.abs(F.sum(-F.col("q") * F.ln("q"))) / F.ln(F.lit(5.0)), 6).alias("flex"), F.max_by("position", F.struct("n", -F.col("position"))).alias("primary"))


def synergy(appearances: DataFrame, m: float = 20.0) -> DataFrame:
    """Shrunk win rate of pairs of heroes of one side: pairs come from each side's five, so a game makes ten rows."""
    side = appearances.where("won is not null").groupBy("series_id", "game_number", "side", "won").agg(F.array_sort(F.collect_set("hero")).alias("h"))
    pairs = side.select("won", F.explode(F.expr("flatten(transform(h, (x, i) -> transform(slice(h, i + 2, size(h)), y -> struct(x as a, y as b))))")).alias("p"))
    return pairs.groupBy(F.col("p.a").alias("hero_a"), F.col("p.b").alias("hero_b")).agg(F.count("*").alias("games"), F.count_if("won").alias("wins")).withColumn("rate", F.round(C.shrunk(F.col("wins"), F.col("games"), m), 6))


def counters(appearances: DataFrame, m: float = 20.0) -> DataFrame:
    """Directed: how a hero did against another; a game makes at most fifty rows."""
    side = appearances.where("won is not null").groupBy("series_id", "game_number").agg(F.collect_list(F.when(F.col("side") == 0, F.struct("hero", "won"))).alias("x"), F.collect_list(F.when(F.col("side") == 1, F.struct("hero", "won"))).alias("y"))
    both = F.expr("flatten(transform(x, a -> transform(y, b -> struct(a.hero as hero, b.hero as against, a.won as won)))) ")
    back = F.expr("flatten(transform(y, a -> transform(x, b -> struct(a.hero as hero, b.hero as against, a.won as won)))) ")
    rows = side.select(F.explode(F.concat(both, back)).alias("c")).select("c.*")
    return rows.groupBy("hero", "against").agg(F.count("*").alias("games"), F.count_if("won").alias("wins")).withColumn("rate", F.round(C.shrunk(F.col("wins"), F.col("games"), m), 6))


def sequential_draft(drafts: DataFrame) -> DataFrame:
    """After each event j = 0..18 of a draft: bans and picks of both sides so far. ``drafts``: draft, e (seq, kind, side).

    The places of a kind and side are bits of a number, so that a step counts bits; a draft that has a place twice, or places
    beyond 62, is counted event by event.
    """
    classes = {"bans_a": ("B", 0), "bans_b": ("B", 1), "picks_a": ("P", 0), "picks_b": ("P", 1)}
    of = lambda k, s: F.filter("e", lambda v: (v["kind"] == k) & (v["side"] == s))
    mask = lambda k, s: F.aggregate("e", F.lit(0).cast("long"), lambda m, v: F.when((v["kind"] == k) & (v["side"] == s), m + F.call_function("shiftleft", F.lit(1).cast("long"), v["seq"].cast("int"))).otherwise(m))
    plain = (F.size(F.array_distinct(F.transform("e", lambda v: v["seq"]))) == F.size("e")) & F.forall("e", lambda v: v["seq"].between(0, 62))
    x = drafts.where(F.size("e") > 0).withColumn("plain", F.coalesce(plain, F.lit(False)))
    x = x.select("draft", *[F.when(F.col("plain"), mask(*c)).alias(f"__{n}") for n, c in classes.items()], F.when(~F.col("plain"), F.struct(*[of(*c).alias(n) for n, c in classes.items()])).alias("__e"))
    steps = x.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(18))))
    upto = F.call_function("shiftleft", F.lit(2).cast("long"), F.col("j")) - 1
    count = lambda n: F.coalesce(F.bit_count(F.col(f"__{n}").bitwiseAND(upto)), F.size(F.filter(F.col(f"__e.{n}"), lambda v: v["seq"] <= F.col("j")))).cast("int")
    return steps.select("draft", "j", *[count(n).alias(n) for n in classes])


def draft_quality(drafts: DataFrame) -> DataFrame:
    """Per draft: number of events, whether the shape is standard, which side picks first, repeated heroes. ``drafts``: draft, e (seq,
    kind, side, hero)."""
    n = F.size("e")
    ordered = F.sort_array(F.transform("e", lambda v: F.struct(v["seq"], v["kind"])))
    first = F.array_min(F.transform(F.filter("e", lambda v: v["kind"] == "P"), lambda v: F.struct(v["seq"].alias("seq"), v["side"].alias("side"))))["side"]
    per = drafts.select("draft", n.cast("long").alias("n"), F.array_join(F.transform(ordered, lambda x: x["kind"]), "").alias("shape"), first.alias("first_pick"), (n - F.size(F.array_distinct(F.transform("e", lambda v: v["hero"])))).cast("long").alias("repeated"))
    return per.withColumn("standard", F.col("shape") == "BBBBPPPPPPBBBBPPPP")


def recency_strength(appearances: DataFrame, half: float = 90 * 24.0) -> DataFrame:
    """Per hero and time: wins and games before it, weighted 0.5^(age / half), by scaled prefix sums.

    Weights 2^(t / half) are taken from the hero's first time, so that they stay in range, and divided out at the row's time.
    """
    per = appearances.where("won is not null").groupBy("hero", "t").agg(F.count("*").alias("g"), F.count_if("won").alias("w"))
    start = F.min("t").over(Window.partitionBy("hero"))
    x = per.withColumn("u", F.pow(F.lit(2.0), (F.col("t") - start) / half))
    f = prior(["hero"], "t")
    scale = lambda c: F.coalesce(F.sum(F.col(c) * F.col("u")).over(f), F.lit(0.0)) / F.col("u")
    return x.select("hero", "t", F.round(scale("g"), 6).alias("weight"), F.round((scale("w") + 5) / (scale("g") + 10), 6).alias("strength"))
