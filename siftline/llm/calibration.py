"""Problem 4: samples that match target category proportions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.tables import label_key, table

#: Records of one pool and label that one task draws from; larger groups are drawn in parts.
PART_ROWS = 50_000
NEWTON_ROUNDS = 60


#: Why a category is drawn less often than is needed: too few records, other categories' floors, or floors that fill the size.
ENOUGH, SHORT, SQUEEZED = "", "available", "floors"


def newton(n, target):
    """Moments of the exponential tilting whose dual meets the targets: ``n exp(dual)`` for each category."""
    import numpy as np

    if not len(n):
        return n
    # dual of entropy: f(l) = sum(n exp(l)) - target . l, whose gradient is moments minus targets and whose Hessian is the moments
    dual = np.full(len(n), np.log(max(target.sum(), 1e-9) / n.sum()))
    for _ in range(NEWTON_ROUNDS):
        moments = n * np.exp(np.minimum(dual, 50.0))
        step = np.where(target > 0, (target - moments) / np.maximum(moments, 1e-12), -1.0)
        dual = dual + np.clip(step, -2.0, 2.0)
        if np.abs(np.where(target > 0, moments - target, moments)).max() < 1e-9 * max(1.0, target.sum()):
            break
    return np.where(target > 0, n * np.exp(np.minimum(dual, 50.0)), 0.0)


def tilt(counts, shares, floors, size: int, needed=None):
    """Expected sample counts per category, how much of what is needed can't be there, and why less is drawn.

    The probability of a category's records is ``exp(a + l)`` for the size dual a and the category's dual l, between its floor and 1.
    Newton's steps solve for the duals with which the moments, the expected counts, are the targets. Where they
    leave those bounds, the side that is broken by more is fixed at its bound and the others are solved again for what
    remains of the size, which ends at the one solution within all bounds. Floors that together exceed the size are cut in
    proportion to it, so that a sample never exceeds its size; where all records are too few, all are drawn. ``gap`` is
    what remains of ``needed`` at full probability, the bound of a category's moment.
    """
    import numpy as np

    n = counts.astype(float)
    needed = np.maximum(floors, np.floor(shares * size + 0.5)) if needed is None else needed
    low = np.minimum(floors, n)
    gap = np.maximum(0.0, needed - n * 1.0)
    if low.sum() > size:
        want = low * size / low.sum()
    else:
        want = np.zeros(len(n))
        fixed = n <= 0
        while not fixed.all():
            free = ~fixed
            rest = max(0.0, size - want[fixed].sum())
            s = shares[free]
            s = s / s.sum() if s.sum() > 0 else np.full(free.sum(), 1 / free.sum())
            want[free] = newton(n[free], s * rest)
            over, under = np.maximum(0.0, want - n), np.maximum(0.0, low - want)
            over[fixed] = under[fixed] = 0.0
            if over.sum() <= 1e-9 and under.sum() <= 1e-9:
                break
            broken, bound = (over > 1e-9, n) if over.sum() >= under.sum() else (under > 1e-9, low)
            want[broken] = bound[broken]
            fixed |= broken
    # targets are met to within the rounding of what is needed
    why = np.where(gap > 0, SHORT, np.where(needed - want >= 1.0 - 1e-9, SQUEEZED, ENOUGH))
    return want, gap, why


def plan_samples(counts: DataFrame, pool: list[str], category: str) -> DataFrame:
    """Per pool and target category what is needed, the expected number to draw, the gap and why less is drawn.

    ``counts`` has pool, category, target_share, min_count, sample_size and ``available``. Needed is
    the larger of min_count and target_share times sample_size, rounded. ``draw``, ``gap`` and ``missed`` are the solver's
    (``tilt``): the gap is by how much there are too few records; missed is "available" there, and "floors" where the
    floors of other categories or all floors together leave less than is needed. One task sees one pool's categories, never its records.
    """

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(category, kind="stable")
        draw, gap, why = tilt(part["available"].to_numpy(), part["target_share"].fillna(0).to_numpy(), part["min_count"].fillna(0).to_numpy(float), int(part["sample_size"].max()), part["needed"].to_numpy(float))
        return part.assign(draw=draw, gap=gap.astype("int64"), missed=why)

    counts = counts.withColumn("needed", F.greatest(F.coalesce("min_count", F.lit(0)), F.round(F.coalesce("target_share", F.lit(0.0)) * F.col("sample_size")).cast("long")))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counts.schema.fields)
    # few rows, but much work for each pool: spread it over all tasks, which adaptive execution would not
    tasks = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return counts.repartition(tasks, *pool).groupBy(*pool).applyInPandas(solve, f"{fields}, draw double, gap bigint, missed string")


def pivotal(p, seed: int):
    """Rows drawn by the pivotal method with inclusion probabilities p: two rows fight until one is settled.

    Exactly ``sum(p)`` rows, rounded up or down at random, are drawn, and each with its probability.
    """
    import numpy as np

    draw = np.random.default_rng(seed).random(len(p) + 1)
    out = np.zeros(len(p), bool)
    held, a = -1, 0.0
    for i, b in enumerate(p.tolist()):
        if b >= 1 - 1e-9 or b <= 1e-9:
            out[i] = b > 0.5
            continue
        if held < 0:
            held, a = i, b
            continue
        u, t = draw[i], a + b
        if t < 1 - 1e-12:  # one of the two is out
            if u * t < b:
                held = i
            a = t
        elif t <= 1 + 1e-12:
            out[held if u * t < a else i] = True
            held = -1
        else:  # one of the two is in
            if u * (2 - t) < 1 - b:
                out[held], held = True, i
            else:
                out[i] = True
            a = t - 1
    if held >= 0:
        out[held] = draw[-1] < a
    return out


def draw_samples(records: DataFrame, plan: DataFrame, pool: list[str], category: str, record: str, seed: int = 13) -> DataFrame:
    """``pool, category, record`` of the drawn records.

    The expected number of a category is first made whole, pool by pool, by the pivotal method
    over categories, so that a pool's sample has its size; then that many records are drawn with equal
    probability by the pivotal method. A category with more than PART_ROWS records is cut into parts by hash, over
    which its number is spread in proportion, again made whole by the pivotal method.
    """
    import numpy as np

    def number(*x) -> int:
        import zlib

        return zlib.crc32(repr((seed, *map(str, x))).encode())

    def whole(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(category, kind="stable")
        base = np.floor(part["draw"].to_numpy() + 1e-9)
        up = pivotal(np.clip(part["draw"].to_numpy() - base, 0, 1), number(*part[pool].iloc[0]))
        return part.assign(take=(base + up).astype("int64"))[[*pool, category, "take", "available"]]

    # small rows, much work for each group: spread over all tasks, which adaptive execution would not
    tasks = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = {f.name: f.dataType.simpleString() for f in plan.schema.fields}
    keys = ", ".join(f"{k} {kinds[k]}" for k in [*pool, category])
    takes = plan.select(*pool, category, "draw", "available").repartition(tasks, *pool).groupBy(*pool).applyInPandas(whole, f"{keys}, take bigint, available bigint")
    takes = takes.withColumn("_parts", F.ceil(F.col("available") / PART_ROWS).cast("int")).filter("take > 0")
    rows = records.select(*pool, category, record).join(takes, [*pool, category]).withColumn("_part", F.pmod(F.xxhash64(record, F.lit(seed)), F.col("_parts")))
    sizes = rows.groupBy(*pool, category, "_part").agg(F.count(F.lit(1)).alias("_n"), F.max("take").alias("take"), F.max("available").alias("available"))

    def spread(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_part")
        x = part["take"].to_numpy() * part["_n"].to_numpy() / part["available"].to_numpy()
        base = np.floor(x + 1e-9)
        up = pivotal(np.clip(x - base, 0, 1), number(*part[[*pool, category]].iloc[0], "parts"))
        return part.assign(share=(base + up) / part["_n"])[[*pool, category, "_part", "share"]]

    # most categories are one part, whose share needs no draw
    one = sizes.filter(F.col("_n") == F.col("available")).select(*pool, category, "_part", (F.col("take") / F.col("_n")).alias("share"))
    more = sizes.filter(F.col("_n") != F.col("available")).repartition(tasks, *pool, category)
    shares = one.unionByName(more.groupBy(*pool, category).applyInPandas(spread, f"{keys}, _part bigint, share double"))

    def draw(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(record)
        # a random order, as the pivotal method's neighbours exclude each other
        part = part.iloc[np.random.default_rng(number(*part[[*pool, category, "_part"]].iloc[0])).permutation(len(part))]
        return part[pivotal(part["share"].to_numpy(), number(*part[[*pool, category, "_part"]].iloc[0], "draw"))][[*pool, category, record]]

    kind = next(f.dataType.simpleString() for f in records.schema.fields if f.name == record)
    return rows.join(shares, [*pool, category, "_part"]).select(*pool, category, "_part", record, "share").repartition(tasks, *pool, category, "_part").groupBy(*pool, category, "_part").applyInPandas(draw, f"{keys}, {record} {kind}")


_POOL = ["pool_table", "pool_id"]


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per candidate or record with its pool and label; of repeated ones the latest."""
    out = None
    for name, key, pool, at in (("candidates", "candidate_id", "run_id", "received_at"), ("records", "id", "batch_id", "loaded_at")):
        rows = table(spark, sf_dir, name).select(F.col(key).alias("record"), F.col(pool).alias("pool_id"), label_key(F.col("label")).alias("label"), at)
        rows = rows.filter(F.col("record").isNotNull() & F.col("pool_id").isNotNull())
        one = rows.groupBy("record").agg(F.max_by(F.struct("pool_id", "label"), F.struct(at, "label")).alias("s")).select(F.lit(name).alias("pool_table"), "s.pool_id", "s.label", "record")
        out = one if out is None else out.unionByName(one)
    return out


def _plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, sf_dir, "targets").select(*_POOL, F.col("label").alias("_label"), label_key(F.col("label")).alias("label"), "target_share", "min_count", "sample_size")
    records = _records(spark, sf_dir)
    have = records.groupBy(*_POOL, "label").agg(F.count(F.lit(1)).alias("available"))
    counts = targets.join(have, [*_POOL, "label"], "left").withColumn("available", F.coalesce("available", F.lit(0).cast("long")))
    return records, plan_samples(counts, _POOL, "label")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of targets of which a pool has too few records."""
    return _plan(spark, sf_dir)[1].filter(F.col("gap") > 0).select("pool_id", F.col("_label").alias("label"))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every target: what there is, what is needed and the gap."""
    plan = _plan(spark, sf_dir)[1]
    return plan.select("pool_table", "pool_id", F.col("_label").alias("label"), "available", "needed", "gap")


def p4_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every target the expected number to draw and, where that is less than is needed, why."""
    plan = _plan(spark, sf_dir)[1]
    return plan.select("pool_table", "pool_id", F.col("_label").alias("label"), F.round("draw", 4).alias("draw"), "missed")


def p4_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample of every pool."""
    records, plan = _plan(spark, sf_dir)
    return draw_samples(records, plan, _POOL, "label", "record")


QUERIES = {"p4_found": p4_found, "p4_report": p4_report, "p4_draws": p4_draws, "p4_sample": p4_sample}
_HAVE = r"""
one AS (
  SELECT 'candidates' AS pool_table, run_id AS pool_id, candidate_id AS record, label FROM candidates
  QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY received_at DESC) = 1
  UNION ALL
  SELECT 'records', batch_id, id, label FROM records QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1),
have AS (
  SELECT pool_table, pool_id, lower(regexp_replace(label, '^[\s\p{Z}\p{P}]+|[\s\p{Z}\p{P}]+$', '', 'g')) AS label, count(*) AS available FROM one GROUP BY ALL),
need AS (
  SELECT t.pool_table, t.pool_id, t.label, coalesce(h.available, 0) AS available,
    greatest(t.min_count, CAST(round(t.target_share * t.sample_size) AS BIGINT)) AS needed
  FROM targets t LEFT JOIN have h ON h.pool_table = t.pool_table AND h.pool_id = t.pool_id AND h.label = t.label)
"""
SQL = {
    "p4_found": f"WITH {_HAVE} SELECT pool_id, label FROM need WHERE available < needed",
    "p4_report": f"WITH {_HAVE} SELECT pool_table, pool_id, label, available, needed, greatest(0, needed - available) AS gap FROM need",
}
