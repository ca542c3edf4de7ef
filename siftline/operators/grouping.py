"""Ranks, running counts and top-k within groups of any size.

A group may hold a third of all rows, so none of these sorts one group in one task:
groups beyond ``split_rows`` are cut into ranges of their order, ranked range by range and
joined with the totals of the ranges before.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftline.operators.staging import written

SPLIT_ROWS = 100_000
RANGES = 64


def value_ranks(df: DataFrame, keys: list[str], value: str, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Distinct values of each group with their share of the order.

    Returns ``keys, value, ties, below, group_rows``: the rows equal to the value, the rows
    under it, and the rows of the group. Null values are left out; NaN counts as the largest.
    An empty input gives an empty result.
    """
    hist = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("ties"))
    shares = [i / RANGES for i in range(1, RANGES)]
    sizes = hist.groupBy(*keys).agg(
        F.sum("ties").alias("group_rows"),
        F.count(F.lit(1)).alias("_values"),
        F.percentile_approx(value, shares, 2000).alias("_cuts"),
    )
    sizes = sizes.withColumn("_cuts", F.when(F.col("_values") > split_rows, F.array_distinct("_cuts")))
    under = F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    cut = hist.join(sizes.drop("_values"), keys)
    cut = cut.withColumn("_range", F.when(F.col("_cuts").isNull(), 0).otherwise(under)).drop("_cuts")
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = cut.withColumn("_in", F.coalesce(F.sum("ties").over(inside), F.lit(0)))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cut.groupBy(*keys, "_range")
        .agg(F.sum("ties").alias("_rows"))
        .withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .drop("_rows")
    )
    return ranked.join(starts, [*keys, "_range"]).select(
        *keys, value, "ties", (F.col("_start") + F.col("_in")).alias("below"), "group_rows"
    )


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: Column, tie: str, parts: int = 16) -> DataFrame:
    """The first ``k`` rows of each group; ``k`` is a column that is constant in a group.

    Each group is first cut into ``parts`` parts by a hash of ``tie``, so that the last sort of
    a group sees at most ``parts * k`` rows. Equal rows are told apart by ``tie``. Rows whose
    ``k`` is null give nothing. The rank comes out as ``rank``.
    """
    first = Window.partitionBy(*keys, "_part").orderBy(*order, F.col(tie))
    last = Window.partitionBy(*keys).orderBy(*order, F.col(tie))
    return (
        df.withColumn("_part", F.pmod(F.xxhash64(tie), F.lit(parts)))
        .withColumn("_rank", F.row_number().over(first))
        .filter(F.col("_rank") <= k)
        .withColumn("rank", F.row_number().over(last))
        .filter(F.col("rank") <= k)
        .drop("_part", "_rank")
    )


def means_in_order(df: DataFrame, keys: list[str], order: str, values: dict[str, Column]) -> DataFrame:
    """``keys``, ``rows`` and the means of ``values``, each group summed row by row in its ``order``, which has no ties.

    So the last digits, and what they round to, don't depend on partitions. The sums run within a sorted window; no group is collected.
    """
    running = df.select(*keys, F.col(order).alias("_order"), *[v.alias(n) for n, v in values.items()])
    up = Window.partitionBy(*keys).orderBy("_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return running.select(*keys, "_order", *[F.avg(n).over(up).alias(n) for n in values]).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *[F.max_by(n, "_order").alias(n) for n in values])


def exact_mean(value: str) -> Column:
    """The mean of a column by its exact sum, rounded once: the same in any order of rows; plain where a number isn't finite or beyond 1e6.

    A double is summed as two whole numbers, units of 2^-30 and of 2^-82; what a number has below that is cut off.
    """
    x = F.col(value).cast("double")
    plain = F.isnan(x) | (F.abs(x) > 1e6)
    scaled = F.when(~plain, x) * 2.0**30
    whole = F.floor(scaled)
    units = lambda n: F.sum(n.cast("decimal(19,0)"))
    total = (units(whole) * F.lit(Decimal(2**52)) + units(F.floor((scaled - whole) * 2.0**52))).cast("double") / 2.0**82
    return F.when(F.count_if(plain) > 0, F.avg(x)).otherwise(total / F.nullif(F.count(x), F.lit(0)))


def quality_order(quality: str) -> list[Column]:
    """Best first, null and NaN last."""
    none = F.col(quality).isNull() | F.isnan(quality)
    return [F.when(none, F.lit(float("inf"))).otherwise(-F.col(quality))]


def first_k(df: DataFrame, keys: list[str], order: list[Column], k: Column, tie: str, parts: int = 16) -> DataFrame:
    """All rows, with ``rank`` for the first ``k`` of each group and null for the others; ``k`` is constant in a group.

    As in ``top_k`` parts of a group are ranked first; rows that are beyond ``k`` in their part stay there, so the last
    sort of a group sees at most ``parts * k`` rows, and no row is joined back.
    """
    first = Window.partitionBy(*keys, "_part").orderBy(*order, F.col(tie))
    cut = df.withColumn("_part", F.pmod(F.xxhash64(tie), F.lit(parts))).withColumn("_in", F.row_number().over(first) <= k)
    cut = cut.withColumn("_part", F.when(~F.coalesce("_in", F.lit(False)), F.col("_part")))
    last = Window.partitionBy(*keys, "_part").orderBy(*order, F.col(tie))
    ranked = cut.withColumn("rank", F.row_number().over(last))
    return ranked.withColumn("rank", F.when(F.col("_part").isNull() & (F.col("rank") <= k), F.col("rank"))).drop("_part", "_in")


def rank_in_groups(df: DataFrame, keys: list[str], quality: str, tie: str, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Adds ``rank``: the place by ``quality`` downwards (null and NaN last), then by ``tie``.

    For ranks of whole groups; where only the first k count, ``top_k`` or ``first_k`` need no table. The rows are written once, so
    what makes them runs once, and the largest group is counted there. Up to ``split_rows`` a group is sorted in one task;
    beyond it groups are cut by quality and, where qualities are equal, by the leading bytes of ``tie``; both cuts
    keep the order, so the ranks of the parts add up. Pass the columns needed, as all are written. Empty in, empty out.
    """
    df = written(df, "ranked")
    q = F.when(F.col(quality).isNull() | F.isnan(quality), F.lit(float("inf"))).otherwise(-F.col(quality))
    lead = F.conv(F.hex(F.substring(F.encode(F.col(tie).cast("string"), "UTF-8"), 1, 6)), 16, 10).cast("double")
    rows = df.withColumn("_q", q)
    if (df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) <= split_rows:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_q", tie))).drop("_q")
    rows = rows.withColumn("_lead", lead)
    shares = [i / RANGES for i in range(1, RANGES)]
    sizes = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_q", shares, 2000).alias("_qs"),
        F.percentile_approx("_lead", shares, 2000).alias("_ls"),
    )
    big = sizes.filter(F.col("_n") > split_rows).select(*keys, F.array_distinct("_qs").alias("_qs"), F.array_distinct("_ls").alias("_ls"))
    rows = rows.join(big, keys, "left")
    under = lambda cuts, x: F.when(F.col(cuts).isNull(), 0).otherwise(F.size(F.filter(cuts, lambda c: c < F.col(x))))
    at_cut = F.coalesce(F.array_contains("_qs", F.col("_q")), F.lit(False))
    # a quality that is itself a cut may be shared by many rows: it gets parts of its own, cut by the tie
    rows = rows.withColumn("_a", under("_qs", "_q") * 2 + F.when(at_cut, 1).otherwise(0)).withColumn("_b", F.when(at_cut, under("_ls", "_lead")).otherwise(0))
    parts = rows.groupBy(*keys, "_a", "_b").agg(F.count(F.lit(1)).alias("_m"))
    before = Window.partitionBy(*keys).orderBy("_a", "_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("_start", F.coalesce(F.sum("_m").over(before), F.lit(0))).drop("_m")
    inside = Window.partitionBy(*keys, "_a", "_b").orderBy("_q", tie)
    ranked = rows.withColumn("_in", F.row_number().over(inside))
    return ranked.join(starts, [*keys, "_a", "_b"]).withColumn("rank", F.col("_in") + F.col("_start")).drop("_q", "_lead", "_qs", "_ls", "_a", "_b", "_in", "_start")
