"""Problem 1: capping the records of dominant contributors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftline.llm.tables import latest_audit, seed_key, table
from siftline.operators.grouping import first_k, quality_order
from siftline.operators.staging import written


def fill_levels(counts: DataFrame, group: str, rows: str, max_share: float = 1.0, max_count: DataFrame | None = None) -> DataFrame:
    """``group, level, filled, top_share``: the largest count per contributor with which the output keeps its limits.

    Water-filling: with contributors sorted by count, filling all of them up to a level c gives
    ``sum(min(n, c))`` rows, and the level holds if c is at most ``max_share`` of that and at most the group's
    ``limit`` (``max_count``: group, limit). Contributors are folded into a histogram of their counts first, whose length grows
    with the root of a group's rows at most, so a group's window stays small. For m contributors above the level and
    s rows in the others the share's level is ``share * s / (1 - share * m)``; below it every level keeps the share, as
    the filled rows are concave in the level, so the lower of both limits is the solution. It is at least 1 for a share, and
    null (no limit) where the present counts keep both. ``filled`` are the rows that remain and ``top_share`` the
    largest share of them.
    """
    hist = counts.groupBy(group, F.col(rows).alias("_n")).agg(F.count(F.lit(1)).alias("_of"))
    up = Window.partitionBy(group).orderBy("_n")
    down = Window.partitionBy(group)
    m = F.sum("_of").over(down) - F.sum("_of").over(up)
    s = F.sum(F.col("_n") * F.col("_of")).over(up)
    # filling up to _n leaves m contributors above it; a break at the next count is consistent if its level is below that count
    steps = hist.withColumn("_m", m).withColumn("_s", s).withColumn("_next", F.lead("_n").over(up))
    level = F.when(F.col("_m") * max_share < 1, F.floor(max_share * F.col("_s") / (1 - max_share * F.col("_m")) + 1e-9))
    steps = steps.withColumn("_level", level)
    whole = F.max(F.when(F.col("_m") == 0, (F.col("_n") <= max_share * F.col("_s") + 1e-9)))
    fits = (F.col("_level") >= F.col("_n")) & (F.col("_level") < F.coalesce(F.col("_next"), F.lit(0)))
    first = F.floor(max_share * F.sum("_of"))  # every contributor at the same count: shares 1 / contributors
    found = steps.groupBy(group).agg(whole.alias("_whole"), F.max(F.when(fits, F.col("_level"))).alias("_fit"), first.alias("_flat"), F.max("_n").alias("_most"), F.collect_list(F.struct("_n", "_of")).alias("_hist"))
    limit = F.when(~F.col("_whole"), F.greatest(F.coalesce("_fit", "_flat"), F.lit(1))).cast("long")
    if max_count is not None:
        found = found.join(max_count.select(group, F.col("limit").cast("long").alias("_limit")), group)
        limit = F.least(limit, F.when(F.col("_most") > F.col("_limit"), F.col("_limit")))
    found = found.withColumn("level", limit)
    filled = F.aggregate("_hist", F.lit(0).cast("long"), lambda t, x: t + x["_of"] * F.least(x["_n"], F.coalesce("level", x["_n"])))
    return found.withColumn("filled", filled).select(group, "level", "filled", (F.least(F.col("_most"), F.coalesce("level", "_most")) / F.nullif("filled", F.lit(0))).alias("top_share"))


def cap_contributors(
    cites: DataFrame,
    quality: DataFrame,
    group: str,
    contributor: str,
    record: str,
    score: str,
    max_count: DataFrame | None = None,
    max_share: float = 1.0,
) -> DataFrame:
    """For every record of a contributor above its group's level whether it is kept; the best ``level`` records are.

    ``cites`` has group, contributor and record (repeats count once; rows with a null are left
    out), ``quality`` one score per record (none, null or NaN comes last), ``max_count`` a
    ``limit`` per group. The level is the water-filling solution of both limits (``fill_levels``); where they hold
    already nothing is capped. Only contributors above the level are ranked, in parts that end once they can't be kept, so that one
    with a third of all rows is spread over tasks. Equal scores are ordered by record.
    Returns ``group, contributor, record, rank, kept``, the rank null beyond the level. Other columns of the inputs are ignored.
    """
    pairs = cites.select(group, contributor, record).na.drop().distinct()
    counts = pairs.groupBy(group, contributor).agg(F.count(F.lit(1)).alias("_rows"))
    levels = fill_levels(counts, group, "_rows", max_share, max_count).filter(F.col("level").isNotNull()).select(group, "level")
    over = counts.join(levels, group).filter(F.col("_rows") > F.col("level")).select(group, contributor, "level")
    found = pairs.join(over, [group, contributor]).join(quality.select(record, F.col(score).alias("_score")), record, "left")
    ranked = first_k(found, [group, contributor], quality_order("_score"), F.col("level"), record)
    return ranked.select(group, contributor, record, "rank", F.col("rank").isNotNull().alias("kept"))


def consistent_pool(cites: DataFrame, quality: DataFrame, group: str, contributor: str, record: str, score: str, max_share: float, max_count: DataFrame | None = None) -> DataFrame:
    """``group, record`` of the pool in which every contributor's limits hold, with records that cite several contributors.

    A record beyond the limit of any of its contributors is dropped whole, which takes rows from the others too; levels are
    solved again on what remains until all shares are consistent. Each round is one written table; it drops at least
    one record, so the rounds end, and a contributor at its least count of 1 is never capped further.
    """
    pairs = written(cites.select(group, contributor, record).na.drop().distinct(), "pool")
    while True:
        gone = cap_contributors(pairs, quality, group, contributor, record, score, max_count, max_share).filter(~F.col("kept")).select(group, record).distinct()
        gone = written(gone, "gone")
        if not gone.limit(1).count():
            return pairs.select(group, record).distinct()
        pairs = written(pairs.join(gone, [group, record], "left_anti"), "pool")


def _cites(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = table(spark, sf_dir, "gold").select(F.col("id").alias("seed_id"), seed_key(F.col("id")).alias("_key")).distinct()
    cited = table(spark, sf_dir, "candidates").select("run_id", "candidate_id", F.explode("source_seed_ids").alias("_seed"))
    return cited.select("run_id", "candidate_id", seed_key(F.col("_seed")).alias("_key")).join(gold, "_key").drop("_key")


def _capped(spark: SparkSession, sf_dir: str, **limits) -> DataFrame:
    audit = latest_audit(table(spark, sf_dir, "audit"), "s")
    return cap_contributors(_cites(spark, sf_dir), audit, "run_id", "seed_id", "candidate_id", "s", **limits)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that come after the first max_per_source of a run's seed."""
    limit = table(spark, sf_dir, "runs").select("run_id", F.col("max_per_source").alias("limit"))
    return _capped(spark, sf_dir, max_count=limit).filter(~F.col("kept")).select("run_id", "seed_id", "candidate_id")


def p1_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool that remains: candidates that are beyond the limit of none of their seeds."""
    pool = table(spark, sf_dir, "candidates").select("run_id", "candidate_id").na.drop().distinct()
    return pool.join(p1_found(spark, sf_dir).select("run_id", "candidate_id"), ["run_id", "candidate_id"], "left_anti")


def p1_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each run the level to which its seeds are filled, the citations that remain and the largest share of a seed among them."""
    limit = table(spark, sf_dir, "runs").select("run_id", F.col("max_per_source").alias("limit"))
    counts = _cites(spark, sf_dir).na.drop().distinct().groupBy("run_id", "seed_id").agg(F.count(F.lit(1)).alias("n"))
    return fill_levels(counts, "run_id", "n", max_count=limit).withColumn("top_share", F.round("top_share", 6))


def p1_consistent(spark: SparkSession, sf_dir: str, max_share: float = 0.05) -> DataFrame:
    """The pool in which, with its final citations counted, no seed has more than a twentieth of a run's citations, or one alone."""
    audit = latest_audit(table(spark, sf_dir, "audit"), "s")
    return consistent_pool(_cites(spark, sf_dir), audit, "run_id", "seed_id", "candidate_id", "s", max_share)


def p1_share(spark: SparkSession, sf_dir: str, max_share: float = 0.05) -> DataFrame:
    """Candidates beyond a limit of a twentieth of the citations that remain in a run."""
    return _capped(spark, sf_dir, max_share=max_share).filter(~F.col("kept")).select("run_id", "seed_id", "candidate_id")


_CITES = r"""
pairs AS (
  SELECT DISTINCT c.run_id, g.id AS seed_id, c.candidate_id
  FROM (SELECT run_id, candidate_id, unnest(source_seed_ids) AS seed FROM candidates) c
  JOIN gold g ON regexp_replace(regexp_replace(lower(trim(c.seed, E' \t')), '[|]', ':', 'g'), ':0+([0-9])', ':\1') = g.id
  WHERE c.run_id IS NOT NULL AND c.candidate_id IS NOT NULL),
best AS (
  SELECT candidate_id, scores.s AS s FROM audit
  QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY audited_at DESC, ingested_at DESC, scores.s DESC) = 1),
ranked AS (
  SELECT p.*, row_number() OVER (PARTITION BY p.run_id, p.seed_id
    ORDER BY CASE WHEN b.s IS NULL OR isnan(b.s) THEN 1 ELSE 0 END, b.s DESC, p.candidate_id) AS rk
  FROM pairs p LEFT JOIN best b USING (candidate_id)),
excess AS (
  SELECT r.run_id, r.seed_id, r.candidate_id FROM ranked r JOIN runs USING (run_id) WHERE r.rk > runs.max_per_source)
"""

QUERIES = {"p1_found": p1_found, "p1_pool": p1_pool, "p1_levels": p1_levels, "p1_share": p1_share, "p1_consistent": p1_consistent}
SQL = {
    "p1_found": f"WITH {_CITES} SELECT run_id, seed_id, candidate_id FROM excess",
    "p1_pool": f"WITH {_CITES} SELECT DISTINCT run_id, candidate_id FROM candidates c WHERE run_id IS NOT NULL AND candidate_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM excess e WHERE e.run_id = c.run_id AND e.candidate_id = c.candidate_id)",
    "p1_levels": f"""WITH {_CITES}, counts AS (SELECT p.run_id, p.seed_id, count(*) AS n, any_value(r.max_per_source) AS most FROM pairs p JOIN runs r USING (run_id) GROUP BY ALL)
SELECT run_id, CASE WHEN max(n) > max(most) THEN max(most) END AS level, sum(least(n, most))::BIGINT AS filled, round(max(least(n, most)) / sum(least(n, most))::DOUBLE, 6) AS top_share FROM counts GROUP BY run_id""",
    "p1_share": f"""WITH {_CITES}, counts AS (SELECT run_id, seed_id, count(*) AS n FROM pairs GROUP BY ALL),
levels AS (
  SELECT run_id, CASE WHEN max(n) <= 0.05::DOUBLE * sum(n) + 1e-9 THEN NULL ELSE
    greatest(1, coalesce((SELECT max(l.c) FROM (SELECT unnest(range(1, max(counts.n) + 1)) AS c) l
      WHERE l.c <= 0.05::DOUBLE * list_sum(list_transform(list(counts.n), lambda x: least(x, l.c))) + 1e-9), 1)) END AS level
  FROM counts GROUP BY run_id)
SELECT r.run_id, r.seed_id, r.candidate_id FROM ranked r JOIN levels USING (run_id) WHERE r.rk > level""",
}
