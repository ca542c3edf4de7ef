"""Problem 3: one ranking from several differently scaled scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftline.llm.tables import latest_audit, table
from siftline.operators.grouping import SPLIT_ROWS, top_k, value_ranks
from siftline.operators.staging import written

# Coefficients of the rational approximation of the inverse normal distribution
# (relative error under 1.2e-9), for the middle and for the tails.
A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01]
C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00]
TAIL = 0.02425


def _poly(x: Column, coefficients: list[float]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def inverse_normal(p: Column) -> Column:
    """The normal quantile of a probability within (0, 1), as a column expression."""
    q = p - 0.5
    r = q * q
    low, high = F.sqrt(-2 * F.log(F.least(p, F.lit(0.5)))), F.sqrt(-2 * F.log(F.least(1 - p, F.lit(0.5))))
    tail = lambda t: _poly(t, C) / _poly(t, [*D, 1.0])
    return F.when(p < TAIL, tail(low)).when(p > 1 - TAIL, -tail(high)).otherwise(_poly(r, A) * q / _poly(r, [*B, 1.0]))


def _within_windows(rows: DataFrame, group: str, names: list[str]) -> DataFrame:
    """Adds each score's normal quantile; a group's rows meet once, and are sorted there by each score."""
    every, out = Window.partitionBy(group), rows
    for s in names:
        ties = F.count(F.lit(1)).over(Window.partitionBy(group, s))
        p = (F.rank().over(every.orderBy(s)) - 1 + ties / 2) / F.count(F.lit(1)).over(every)
        # a column of its own, as the quantile's expression names it many times
        out = out.withColumn("_p", p).withColumn(f"_z{s}", inverse_normal(F.col("_p"))).drop("_p")
    return out


def _within_ranges(rows: DataFrame, group: str, names: list[str]) -> DataFrame:
    """The same for groups too large for one task: distinct values are ranked in ranges of their order and joined to the rows."""
    out = rows
    for s in names:
        r = value_ranks(rows, [group], s)
        r = r.withColumn("_p", (F.col("below") + F.col("ties") / 2) / F.col("group_rows"))
        out = out.join(r.select(group, s, inverse_normal(F.col("_p")).alias(f"_z{s}")), [group, s])
    return out.select(*rows.columns, *[f"_z{s}" for s in names])


def combined_scores(df: DataFrame, group: str, record: str, weights: dict[str, float], split_rows: int = SPLIT_ROWS) -> DataFrame:
    """``group, record, score``: the weighted mean of the normal quantiles of each score's percentile.

    A percentile is (rows below + (ties + 1) / 2 - 1/2) / rows of the group, so ties share their
    average and one-row groups get the middle. A negative weight turns a score downwards. Rows
    with a null or NaN among the scores, group or record are left out. Records must be unique.
    The rows are written once. Groups of up to ``split_rows`` are ranked by windows over one shuffle, larger ones in ranges, with the same result.
    """
    names = [f"_s{i}" for i in range(len(weights))]
    rows = df.select(F.col(group), F.col(record), *[F.col(s).cast("double").alias(n) for s, n in zip(weights, names)]).na.drop()
    for s in names:
        rows = rows.filter(~F.isnan(s))
    rows = written(rows, "scores")
    large = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > split_rows).select(group)
    if large.limit(1).count():
        large = written(large, "large")
        ranked = _within_windows(rows.join(large, group, "left_anti"), group, names).unionByName(_within_ranges(rows.join(large, group, "left_semi"), group, names))
    else:
        ranked = _within_windows(rows, group, names)
    total = sum(abs(w) for w in weights.values())
    return ranked.select(group, record, (sum((float(w) * F.col(f"_z{n}") for w, n in zip(weights.values(), names)), F.lit(0.0)) / total).alias("score"))


WEIGHTS = {"u": 1.0, "d": 1.0, "l": -1.0, "h": -1.0}


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "candidates").select("run_id", "candidate_id").na.drop().distinct()
    audit = latest_audit(table(spark, sf_dir, "audit"), *WEIGHTS)
    return combined_scores(runs.join(audit, "candidate_id"), "run_id", "candidate_id", WEIGHTS)


def p3_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The combined score of every candidate with a complete audit."""
    return _scores(spark, sf_dir).select("run_id", "candidate_id", F.round("score", 6).alias("score"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first top_n candidates of each run; scores count as equal, and go by id, only where they differ by rounding errors."""
    limits = table(spark, sf_dir, "runs").select("run_id", "top_n")
    rows = _scores(spark, sf_dir).withColumn("_s", F.round("score", 12)).join(limits, "run_id")
    return top_k(rows, ["run_id"], [F.desc("_s")], F.col("top_n"), "candidate_id").select("run_id", "candidate_id")


def _normal_sql(p: str) -> str:
    """The same rational approximation in SQL."""

    def poly(x: str, coefficients: list[float]) -> str:
        out = f"({coefficients[0]!r}::DOUBLE)"
        for c in coefficients[1:]:
            out = f"({out} * {x} + ({c!r}::DOUBLE))"
        return out

    tail = lambda q: f"({poly(q, C)} / {poly(q, [*D, 1.0])})"
    low, high, r = f"sqrt(-2 * ln(least({p}, 0.5)))", f"sqrt(-2 * ln(least(1 - {p}, 0.5)))", f"(({p} - 0.5) * ({p} - 0.5))"
    return f"CASE WHEN {p} < {TAIL} THEN {tail(low)} WHEN {p} > 1 - {TAIL} THEN -{tail(high)} ELSE {poly(r, A)} * ({p} - 0.5) / {poly(r, [*B, 1.0])} END"


_COMBINED = f"""latest AS (
  SELECT candidate_id, scores.u::DOUBLE AS u, scores.d::DOUBLE AS d, scores.l::DOUBLE AS l, scores.h::DOUBLE AS h FROM audit WHERE candidate_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY audited_at DESC, ingested_at DESC) = 1),
whole AS (
  SELECT r.run_id, candidate_id, u, d, l, h FROM (SELECT DISTINCT run_id, candidate_id FROM candidates WHERE run_id IS NOT NULL AND candidate_id IS NOT NULL) r JOIN latest USING (candidate_id)
  WHERE NOT (u IS NULL OR d IS NULL OR l IS NULL OR h IS NULL OR isnan(u) OR isnan(d) OR isnan(l) OR isnan(h))),
share AS (
  SELECT run_id, candidate_id, {', '.join(f'(rank() OVER (PARTITION BY run_id ORDER BY {x}) - 1 + count(*) OVER (PARTITION BY run_id, {x}) / 2.0) / count(*) OVER (PARTITION BY run_id) AS p{x}' for x in WEIGHTS)} FROM whole),
combined AS (SELECT run_id, candidate_id, ({' + '.join(f'({w}) * ({_normal_sql("p" + x)})' for x, w in WEIGHTS.items())}) / {sum(map(abs, WEIGHTS.values()))} AS score FROM share)"""
QUERIES = {"p3_found": p3_found, "p3_scores": p3_scores}
SQL = {
    "p3_scores": f"WITH {_COMBINED} SELECT run_id, candidate_id, round(score, 6) AS score FROM combined",
    "p3_found": f"""WITH {_COMBINED}, placed AS (SELECT c.run_id, candidate_id, top_n, row_number() OVER (PARTITION BY c.run_id ORDER BY round(score, 12) DESC, candidate_id) AS place FROM combined c JOIN runs USING (run_id))
SELECT run_id, candidate_id FROM placed WHERE place <= top_n""",
}
