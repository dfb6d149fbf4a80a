"""Mixing sources to target weights by entropy balancing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
CAP = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Rates are rounded to so many parts, so that ranks times rates stay exact integers.
PARTS = 10_000_000
SALTS = 64


def words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(key, source, total, target) for ``sources`` (key, source, total): one row per source.

    Sources by code point, null last, take the weights in turn and share the sum of all totals; a target stops at ``cap``
    times its total and the excess is shared anew by weight. Each turn of that is one small aggregate. One row per source
    is ranked in one task; documents never are.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int"))
    src = common.stash(sources.withColumn("weight", weight.cast("double")).withColumn("most", F.col("total") * F.lit(cap)), "sources")
    full = src.agg(F.sum("total")).first()[0] or 0
    level, held = None, -1
    while True:
        above = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= F.col("most")
        n, fixed, free = src.agg(F.count_if(above), F.sum(F.when(above, F.col("most"))), F.sum(F.when(~above, F.col("weight")))).first()
        if n == held or not free:
            break
        held, level = n, (full - (fixed or 0)) / free
    share = F.col("most").cast("double") if level is None else F.least(F.col("most").cast("double"), F.col("weight") * F.lit(float(level)))
    return src.select("key", "source", "total", share.alias("target"))


def rates(sizes: DataFrame, goals: DataFrame, tolerance: float = 1e-10, max_steps: int = 80) -> DataFrame:
    """(key, rate): the rate of each source's documents, by Newton steps on the dual of entropy balancing.

    The primal asks for the rates r >= 0 with the least sum of size (r ln r - r + 1) over all documents whose tokens meet every
    source's target; its solution is r = exp(lambda of the source), and the dual's gradient for a source is its tokens at
    that rate less the target. One Newton step is one aggregate over ``sizes`` (key, size, n: a histogram of documents),
    with lambdas kept in a table; the Hessian is diagonal. Sources without tokens or target get rate 0.
    """
    live = goals.where("total > 0 and target > 0").select("key", "target", F.lit(0.0).alias("lam"))
    state = common.stash(live, "dual")
    for _ in range(max_steps):
        tilt = sizes.join(state.select("key", "lam"), "key").groupBy("key", "lam").agg(F.sum(F.col("n") * F.col("size")).alias("exact"))
        tokens = tilt.select("key", (F.col("exact") * F.exp("lam")).alias("tokens"))  # whole sums: the order of rows does not matter
        step = F.greatest(F.lit(-2.0), F.least(F.lit(2.0), (F.col("target") - F.col("tokens")) / F.col("tokens")))
        nxt = common.stash(state.join(tokens, "key").select("key", "target", (F.col("lam") + step).alias("lam"), (F.abs(F.col("tokens") - F.col("target")) / F.col("target")).alias("gap")), "dual")
        worst = nxt.agg(F.max("gap")).first()[0]
        common.unstash(state)
        state = nxt.drop("gap")
        state._skirmish_path = nxt._skirmish_path
        if worst is None or worst <= tolerance:
            break
    else:
        raise RuntimeError("the dual did not converge")
    return goals.select("key").join(state.select("key", F.exp("lam").alias("rate")), "key", "left").na.fill(0.0, ["rate"])


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(id, source, size, source_size, target, rate, copies): how many copies of each row of ``docs`` the mix takes.

    Rates become copies by systematic rounding: a source's rows are ranked by size (to 1/64), then id, and a row's copies are
    the whole steps that rank times rate passes; so a source's tokens come near its target and no row gets more than
    ceil(rate) <= ``cap`` copies. Ranks come from counts per (source, size, salt of the id), so that no task holds a source.
    Null and empty texts have size 0. A null source is a source of its own; null ids rank first; repeated rows count each;
    other columns are not read. An empty table gives an empty result. Equal input gives equal output.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"))
    bits = F.length(F.bin("size"))
    cell = bits * 1000 + F.expr("shiftright(size, cast(greatest(length(bin(size)) - 7, 0) as int))")
    rows = common.stash(base.select("id", "source", "size", key.alias("key"), cell.cast("long").alias("cell"), F.coalesce(F.pmod("id", F.lit(SALTS)), F.lit(0)).cast("long").alias("salt")), "sizes")
    hist = common.stash(rows.groupBy("key", "source", "size").agg(F.count("*").alias("n")), "histogram")
    goals = common.stash(targets(hist.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("total")), weights, cap), "targets")
    plan = rates(hist, goals).withColumn("parts", F.least(F.lit(cap * PARTS), F.round(F.col("rate") * PARTS)).cast("long"))
    plan = common.stash(goals.join(plan, "key"), "rates")
    cells = rows.groupBy("key", "cell", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("key").orderBy("cell", "salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("key", "cell", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("key", "cell", "salt").orderBy("id", "size")) - 1
    ranked = rows.withColumn("rank", rank).join(cells, ["key", "cell", "salt"]).withColumn("rank", F.col("rank") + F.col("first"))
    copies = F.expr(f"((rank + 1) * parts + {PARTS // 2}) div {PARTS} - (rank * parts + {PARTS // 2}) div {PARTS}")
    joined = ranked.join(plan.select("key", F.col("total").alias("source_size"), "target", "rate", "parts"), "key")
    return joined.select("id", "source", "size", "source_size", "target", "rate", copies.alias("copies"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, each repeated as often as the mix takes it (rows that share an id are taken alike: their mean, rounded)."""
    plan = mix(docs, id_col, **options).groupBy("id").agg(F.round(F.avg("copies")).cast("int").alias("__copies")).where("__copies > 0")
    joined = docs.join(plan.withColumnRenamed("id", "__id"), F.col(id_col) == F.col("__id")).drop("__id")
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).drop("__copies", "__copy").select(*docs.columns)


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    plan = mix(common.table(spark, sf_dir, "documents"))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP7_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS total FROM docs GROUP BY source
), weighted AS (
  SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS DOUBLE) AS weight,
         sum(total) OVER () AS everything
  FROM src
), filled AS (
  SELECT *, coalesce(sum(3 * total) OVER before, 0) AS fixed, sum(weight) OVER rest AS free
  FROM weighted
  WINDOW before AS (ORDER BY total / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         rest AS (ORDER BY total / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), tried AS (
  SELECT *, CAST(everything - fixed AS DOUBLE) / free AS level, weight * (CAST(everything - fixed AS DOUBLE) / free) >= 3 * total AS at_cap FROM filled
), goals AS (
  SELECT source, total, CASE WHEN at_cap THEN CAST(3 * total AS DOUBLE)
    ELSE weight * (SELECT min_by(level, total / weight) FROM tried WHERE NOT at_cap) END AS target
  FROM tried
), rated AS (
  SELECT *, CASE WHEN total > 0 AND target > 0 THEN CAST(least(30000000, round(target / total * 10000000)) AS BIGINT) ELSE 0 END AS parts FROM goals
), ranked AS (
  SELECT doc_id, source, size, row_number() OVER (
    PARTITION BY source ORDER BY length(bin(size)) * 1000 + (size >> greatest(length(bin(size)) - 7, 0)), doc_id % 64, doc_id, size) - 1 AS k
  FROM docs
)
SELECT r.doc_id, r.size, g.total AS source_size, g.target,
       CAST((((k + 1) * parts + 5000000) // 10000000 - (k * parts + 5000000) // 10000000) * size AS BIGINT) AS taken
FROM ranked r JOIN rated g ON r.source IS NOT DISTINCT FROM g.source
"""
