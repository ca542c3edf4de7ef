"""Metrics of predictions and statistics of result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftline.operators.grouping import value_ranks
from siftline.operators.staging import written


def macro_f1(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """``macro_f1, accuracy``: mean F1 over the labels of either column, and the share of equal ones; 0 on no rows."""
    rows = df.select(F.col(truth).alias("t"), F.col(guess).alias("g"))
    pairs = rows.groupBy("t", "g").agg(F.count(F.lit(1)).alias("n"))
    either = pairs.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0).alias("hit"), F.col("n").alias("seen")), F.struct(F.col("g").alias("label"), F.lit(0).cast("bigint").alias("hit"), F.col("n").alias("seen")))).alias("x")).select("x.*")
    f1 = either.groupBy("label").agg((2 * F.sum("hit") / F.sum("seen")).alias("f1"), F.sum("hit").alias("hit"))
    total = pairs.agg(F.sum("n").alias("total"))
    return f1.agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"), F.sum("hit").alias("hits")).join(total, F.lit(True)).select("macro_f1", F.coalesce(F.col("hits") / F.nullif("total", F.lit(0)), F.lit(0.0)).alias("accuracy"))


def calibration_error(df: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """``ece``: mean gap of accuracy and confidence over equal bins of confidence, by their rows; 0 on no rows."""
    b = F.least(F.lit(bins - 1), F.floor(F.col(confidence) * bins).cast("int"))
    per = df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(correct).cast("double")).alias("acc"), F.avg(confidence).alias("conf"))
    return per.agg(F.coalesce(F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.nullif(F.sum("n").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("ece"))


def _correlation(x: Column, y: Column) -> Column:
    return F.coalesce(F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)), F.lit(0.0))


def pearson(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """``keys, rho`` per group; 0 where either side doesn't vary."""
    return df.groupBy(*keys).agg(_correlation(F.col(x), F.col(y)).alias("rho"))


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """``keys, rho`` of average ranks per group; 0 where either side doesn't vary. Groups of any size are ranked in ranges.

    The two columns are written once, as both rankings read them, and again where their ranks are joined.
    """
    rows = written(df.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).na.drop(), "pairs")
    for v in ("_x", "_y"):
        rank = value_ranks(rows, keys, v).select(*keys, v, (F.col("below") + (F.col("ties") + 1) / 2).alias(f"{v}r"))
        rows = rows.join(rank, [*keys, v])
    return pearson(rows, keys, "_xr", "_yr")


def exact_bootstrap(df: DataFrame, value: str, order: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """``mean, lo, hi``: the exact bootstrap interval of the mean of a few values.

    All multisets of the values, C(2n - 1, n) of them, grow count by count with their multinomial
    weight; the bounds are the first means at which the cumulative weight reaches its share. For n up to about 12.
    """
    xs = df.filter(F.col(value).isNotNull()).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("_s")).select(F.transform("_s", lambda s: s[value]).alias("x"))
    n = xs.select(F.size("x").alias("n")).first().n
    if n > 12:
        raise ValueError("the exact interval is for a few values")
    rows = xs.select("x", F.lit(n).alias("left"), F.lit(0.0).alias("total"), F.lit(1.0).alias("weight"))
    for i in range(n):
        some = F.sequence(F.lit(0), F.col("left")) if i < n - 1 else F.array("left")
        rows = rows.withColumn("c", F.explode(some)).select("x", (F.col("left") - F.col("c")).alias("left"), (F.col("total") + F.col("c") * F.col("x")[i]).alias("total"), (F.col("weight") / F.factorial("c")).alias("weight"))
    means = rows.groupBy(F.round(F.col("total") / n, 12).alias("m")).agg(F.sum("weight").alias("w"))
    up = Window.orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    cum = means.withColumn("cum", F.sum("w").over(up)).withColumn("all", F.sum("w").over(Window.partitionBy()))
    bound = lambda q: F.min(F.when(F.col("cum") >= q * F.col("all") * (1 - 1e-12), F.col("m")))
    return cum.agg(bound(low).alias("lo"), bound(high).alias("hi")).join(xs.select((F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / n).alias("mean")), F.lit(True))


def wins(df: DataFrame, keys: list[str], who: str, value: str, against: str, tolerance: float = 1e-12) -> DataFrame:
    """Per contestant its wins, ties and losses against one of them over the keys, those missing, and the mean difference."""
    base = df.filter(F.col(who) == against).select(*keys, F.col(value).alias("_b"))
    names = df.select(who).filter(F.col(who) != against).distinct()
    grid = base.join(names, F.lit(True))  # a handful of contestants for each cell
    both = grid.join(df.select(*keys, who, F.col(value).alias("_v")), [*keys, who], "left").withColumn("_d", F.col("_v") - F.col("_b"))
    return both.groupBy(who).agg(
        F.count_if(F.col("_d") > tolerance).alias("wins"), F.count_if(F.abs("_d") <= tolerance).alias("ties"), F.count_if(F.col("_d") < -tolerance).alias("losses"),
        F.count_if(F.col("_d").isNull()).alias("missing"), F.avg("_d").alias("mean_delta"), F.coalesce(F.stddev_samp("_d"), F.lit(0.0)).alias("std_delta"),
    )


def total_variation(a: DataFrame, b: DataFrame, keys: list[str], label: str) -> DataFrame:
    """``keys, tvd``: half the summed differences of label shares; 0 where either side has no rows."""
    share = lambda d, n: d.groupBy(*keys, label).count().withColumn(n, F.col("count") / F.sum("count").over(Window.partitionBy(*keys))).drop("count")
    x, y = share(a, "p"), share(b, "q")
    full = x.withColumn(label, F.coalesce(label, F.lit("None"))).join(y.withColumn(label, F.coalesce(label, F.lit("None"))), [*keys, label], "full")
    both = full.groupBy(*keys).agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"), (F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))) / 2).alias("t"))
    return both.select(*keys, F.when(F.col("sp").isNull() | F.col("sq").isNull(), 0.0).otherwise(F.col("t")).alias("tvd"))
