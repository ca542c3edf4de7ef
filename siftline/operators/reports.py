"""Reports over selections and replay results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.operators import scoring as sc
from siftline.operators.config import AuditConfig
from siftline.operators.grouping import exact_mean, means_in_order
from siftline.operators.metrics import spearman

SCORES = ["u", "c", "d", "l", "h", "s"]
#: Baselines with which others are compared.
ANCHORS = ("naive", "quality_judge", "quality_diversity", "equal_budget")


def row_key(sources: str = "seeds") -> Column:
    """What makes a selected row: its label, its text and its sources in their order; a digest of them as JSON."""
    whole = F.to_json(F.struct(F.col("label"), F.coalesce(F.col(sources), F.array().cast("array<string>")).alias("source_seed_ids"), F.col("text")), {"ignoreNullFields": "false"})
    return F.md5(whole.cast("binary"))


def payload_key(df: DataFrame) -> Column:
    """A training record in canonical form, as a digest: its fields in order, those that it lacks null."""
    names = ["candidate_id", "dataset_id", "label", "language", "summary", "tags", "task", "text", "tokens"]
    fields = [(F.coalesce("text", F.lit("")) if n == "text" else F.col(n) if n in df.columns else F.lit(None).cast("string")).alias(n) for n in names]
    return F.md5(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).cast("binary"))


def source_counts(df: DataFrame, keys: list[str], sources: str = "seeds") -> DataFrame:
    """``keys, source, n``: rows that cite a source, every citation counted."""
    return df.select(*keys, F.explode(sources).alias("source")).filter(F.col("source").isNotNull()).groupBy(*keys, "source").agg(F.count(F.lit(1)).alias("n"))


def overlap(a: DataFrame, b: DataFrame, keys: list[str], item: str, cells: DataFrame | None = None) -> DataFrame:
    """``keys, jaccard, multiset_jaccard, same``: overlap of two pools as sets and as multisets, and whether they are equal; two empty pools overlap whole.

    Of ``cells`` every row gets a result, also those without a pool.
    """
    n = lambda d, c: d.groupBy(*keys, item).agg(F.count(F.lit(1)).alias(c))
    both = n(a, "x").join(n(b, "y"), [*keys, item], "full").na.fill(0, ["x", "y"])
    out = both.groupBy(*keys).agg(
        (F.count_if((F.col("x") > 0) & (F.col("y") > 0)) / F.count(F.lit(1))).alias("jaccard"),
        (F.sum(F.least("x", "y")) / F.sum(F.greatest("x", "y"))).alias("multiset_jaccard"),
        F.every(F.col("x") == F.col("y")).alias("same"),
    )
    if cells is None:
        return out
    return cells.select(*keys).distinct().join(out, keys, "left").select(*keys, F.coalesce("jaccard", F.lit(1.0)).alias("jaccard"), F.coalesce("multiset_jaccard", F.lit(1.0)).alias("multiset_jaccard"), F.coalesce("same", F.lit(True)).alias("same"))


def inconsistent(overlaps: DataFrame, metrics: DataFrame, keys: list[str], a: str, b: str, tolerance: float = 1e-9) -> DataFrame:
    """Adds the metrics of two baselines, their ``delta`` and ``flag``: equal pools with unlike metrics, which no deterministic training gives."""
    of = lambda name, c: metrics.filter(F.col("baseline") == name).select(*keys, F.col("metric").alias(c))
    j = overlaps.join(of(a, "metric_a"), keys, "left").join(of(b, "metric_b"), keys, "left").withColumn("delta", F.col("metric_b") - F.col("metric_a"))
    return j.withColumn("flag", F.col("same") & F.coalesce(F.abs("delta") > tolerance, F.lit(False)))


def selection_summary(selected: DataFrame, gold_shares: DataFrame, keys: list[str], budget: Column, cfg: AuditConfig | None = None, order: str | None = None) -> DataFrame:
    """One row per ``keys`` (with the baseline) of what a selection took.

    ``selected`` has the judge's columns (``with_judgement``), scores, label, text and seeds; ``gold_shares`` has keys without the baseline, label and
    ``share``. Fill rate, distance of label shares from gold (0 where either side has no labels), hard rejects, strict passes, mean re-ranking score,
    the most rows of one source, means of scores and judgements (missing ones and NaN count as 0), and the overlap with each anchor's selection. With ``order``, a column without ties in a
    selection, means are summed in it and don't depend on partitions.
    """
    cfg = cfg or AuditConfig()
    cell = [k for k in keys if k != "baseline"]
    zero = lambda c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0))
    means = {"hard_reject_rate": F.col("hard_reject").cast("double"), "strict_pass_rate": sc.passes(cfg, cfg.tau_c).cast("double"), "proxy_score": sc.rerank_score(cfg)}
    means |= {f"score_{c}": zero(c) for c in SCORES} | {f"judge_{n}": zero(f"judge_{n}") for n in sc.JUDGED}
    base = selected.groupBy(*keys).agg(F.count(F.lit(1)).alias("selected"), (F.count(F.lit(1)) / F.max(budget)).alias("fill_rate"), *([] if order else [F.avg(v).alias(n) for n, v in means.items()]))
    if order:
        base = base.join(means_in_order(selected, keys, order, means).drop("rows"), keys)
    top = source_counts(selected, keys).groupBy(*keys).agg(F.max("n").alias("source_max"))
    mine = selected.filter(F.col("label").isNotNull()).groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))
    total = mine.groupBy(*keys).agg(F.sum("n").alias("_of"))
    # labels of gold that a selection lacks count too: all of a selection's gold labels, then its own counts
    whole = total.select(*keys).join(gold_shares, cell)
    full = mine.join(total, keys).withColumn("p", F.col("n") / F.col("_of")).select(*keys, "label", "p").join(whole, [*keys, "label"], "full")
    tvd = full.groupBy(*keys).agg(F.when((F.count("p") > 0) & (F.count("share") > 0), F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("share", F.lit(0.0)))) / 2).otherwise(0.0).alias("label_tvd"))
    out = base.join(top, keys, "left").join(tvd, keys, "left").na.fill(0, ["source_max"]).na.fill(0.0, ["label_tvd"])
    items = selected.select(*keys, row_key().alias("_k")).distinct()
    sizes = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    anchors = items.filter(F.col("baseline").isin(*ANCHORS)).withColumnRenamed("baseline", "_anchor")
    common = items.join(anchors, [*cell, "_k"]).groupBy(*keys, "_anchor").agg(F.count(F.lit(1)).alias("_c"))
    met = common.join(sizes, keys).join(sizes.select(*cell, F.col("baseline").alias("_anchor"), F.col("_n").alias("_m")), [*cell, "_anchor"])
    jaccard = met.groupBy(*keys).pivot("_anchor", list(ANCHORS)).agg(F.first(F.col("_c") / (F.col("_n") + F.col("_m") - F.col("_c"))))
    out = out.join(jaccard, keys, "left")
    return out.select(*out.columns[: -len(ANCHORS)], *[F.coalesce(a, F.lit(0.0)).alias(f"jaccard_vs_{a}") for a in ANCHORS])


def across_cells(summaries: DataFrame, by: str = "baseline") -> DataFrame:
    """``by, n`` and the means over cells of every number of a summary but its sizes and the later anchors, whatever the order of cells."""
    left_out = {"selected", *(f"jaccard_vs_{a}" for a in ANCHORS[1:])}
    names = [f.name for f in summaries.schema.fields if f.dataType.typeName() in ("double", "long", "integer") and f.name not in left_out | {"run_id", by}]
    return summaries.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[exact_mean(c).alias(c) for c in names])


def judge_means(selected: DataFrame, scores: DataFrame, keys: list[str], by: str = "baseline", score: str = "score") -> DataFrame:
    """``by, mean``: a judge's mean over the selected rows that it scored, cell by cell and then over cells; cells without any are left out."""
    per = selected.select(*keys, by, "candidate_id").join(scores.filter(F.col(score).isNotNull()).select("candidate_id", score), "candidate_id").groupBy(*keys, by).agg(F.avg(score).alias("m"))
    return per.groupBy(by).agg(F.avg("m").alias("mean"))


def seed_means(results: DataFrame, by: str = "baseline", value: str = "macro_f1") -> DataFrame:
    """``by, mean, sd``: mean over cells, then mean and population spread over seeds; rows without a value are left out."""
    per = results.filter(F.col(value).isNotNull()).groupBy(by, "seed").agg(F.avg(value).alias("m"))
    return per.groupBy(by).agg(F.avg("m").alias("mean"), F.coalesce(F.stddev_pop("m"), F.lit(0.0)).alias("sd"))


def agreement(results: DataFrame, quality: DataFrame, cell: list[str], by: str = "baseline", value: str = "macro_f1", least: int = 3) -> DataFrame:
    """``seed, selector_rho, within_mean, within_median, cells``: rank correlation of selectors' quality with their results, seed by seed.

    ``quality`` has ``by`` and ``quality``. Over selectors' means, and within each cell, where at least ``least`` selectors have both; the median is
    the upper one. Seeds with fewer selectors are left out.
    """
    both = results.filter(F.col(value).isNotNull()).join(quality.select(by, "quality"), by).groupBy("seed", *cell, by).agg(F.avg(value).alias("v"), F.first("quality").alias("q"))

    def rho(df: DataFrame, keys: list[str]) -> DataFrame:
        enough = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).drop("_n")
        return spearman(df.join(enough, keys), keys, "q", "v")

    within = rho(both, ["seed", *cell]).groupBy("seed").agg(F.avg("rho").alias("within_mean"), F.sort_array(F.collect_list("rho")).alias("_r"))
    within = within.select("seed", "within_mean", F.element_at("_r", F.floor(F.size("_r") / 2).cast("int") + 1).alias("within_median"), F.size("_r").alias("cells"))
    means = both.groupBy("seed", by).agg(F.avg("v").alias("v"), F.first("q").alias("q"))
    return rho(means, ["seed"]).withColumnRenamed("rho", "selector_rho").join(within, "seed", "left")


def instability(agreements: DataFrame) -> DataFrame:
    """The least, largest and mean correlation over seeds, of selectors and within cells."""
    of = lambda c, n: [F.min(c).alias(f"{n}_min"), F.max(c).alias(f"{n}_max"), F.avg(c).alias(f"{n}_mean")]
    return agreements.agg(F.count(F.lit(1)).alias("seeds"), *of("selector_rho", "selector"), *of("within_mean", "within"))


def decision(wins: DataFrame, means: DataFrame, candidate: str, base: str, least_wins: int = 3) -> DataFrame:
    """``story, wins, cells, mean_delta``: A where the candidate wins at least ``least_wins`` cells, by a positive mean, and its mean is above the base's; else B."""
    w = wins.filter(F.col("baseline") == candidate).select("wins", (F.col("wins") + F.col("losses") + F.col("ties")).alias("cells"), F.coalesce("mean_delta", F.lit(0.0)).alias("mean_delta"))
    m = means.agg(F.coalesce(F.max(F.when(F.col("baseline") == candidate, F.col("mean"))), F.lit(0.0)).alias("_c"), F.coalesce(F.max(F.when(F.col("baseline") == base, F.col("mean"))), F.lit(0.0)).alias("_b"))
    good = (F.col("cells") > 0) & (F.col("wins") >= least_wins) & (F.col("mean_delta") > 0) & (F.col("_c") > F.col("_b"))
    return w.join(m, F.lit(True)).select(F.when(good, "A").otherwise("B").alias("story"), "wins", "cells", "mean_delta")


def preflight(fills: DataFrame, gold: DataFrame, metrics: DataFrame, keys: list[str], own: str = "audited", base: str = "naive") -> DataFrame:
    """``keys, fill, imbalance, warnings`` of every cell: a hard gate that fills under half, over six tenths of gold of one label, results under the base's.

    ``fills`` has keys and ``fill`` of the hard variant; ``gold`` keys and label; ``metrics`` keys, baseline and macro_f1.
    """
    n = gold.filter(F.col("label").isNotNull()).groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg((F.max("n") / F.sum("n")).alias("imbalance"))
    m = metrics.groupBy(*keys).agg(F.max(F.when(F.col("baseline") == own, F.col("macro_f1"))).alias("_o"), F.max(F.when(F.col("baseline") == base, F.col("macro_f1"))).alias("_b"))
    j = fills.select(*keys, "fill").join(n, keys, "left").join(m, keys, "left").withColumn("imbalance", F.coalesce("imbalance", F.lit(0.0)))
    warnings = [F.when(F.col("fill") < 0.5, "underfills_budget"), F.when(F.col("imbalance") > 0.6, "gold_label_imbalance"), F.when(F.col("_o") < F.col("_b"), "loses_to_naive")]
    return j.select(*keys, "fill", "imbalance", F.concat_ws(",", *warnings).alias("warnings"))


def preflight_totals(cells: DataFrame, metrics: DataFrame, keys: list[str], own: str = "audited", base: str = "naive") -> DataFrame:
    """One row: cells, mean and least fill, wins, ties and losses against the base, cells without both, and ``claim_ready``: some win and no loss."""
    m = metrics.groupBy(*keys).agg(F.max(F.when(F.col("baseline") == own, F.col("macro_f1"))).alias("o"), F.max(F.when(F.col("baseline") == base, F.col("macro_f1"))).alias("b"))
    d = m.withColumn("d", F.col("o") - F.col("b")).agg(F.count_if(F.col("d") >= 1e-12).alias("wins"), F.count_if(F.abs("d") < 1e-12).alias("ties"), F.count_if(F.col("d") <= -1e-12).alias("losses"), F.count_if(F.col("d").isNull()).alias("missing"))
    f = cells.agg(F.count(F.lit(1)).alias("cells"), F.avg("fill").alias("mean_fill"), F.min("fill").alias("min_fill"), F.count_if(F.col("warnings") != "").alias("warned"))
    return f.join(d, F.lit(True)).withColumn("claim_ready", (F.col("losses") == 0) & (F.col("wins") > 0))


def ledger_rows(df: DataFrame, claim: Column, where: str, metric: str, value: Column, source: str, how: str) -> DataFrame:
    """Rows of the six-column ledger: claim, place, metric, value to four digits, its file and how it was computed."""
    return df.select(claim.alias("claim_id"), F.lit(where).alias("paper_location"), F.lit(metric).alias("metric"), F.format_string("%.4f", value.cast("double")).alias("value"), F.lit(source).alias("result_file"), F.lit(how).alias("computation")).filter(F.col("value").isNotNull() & (F.col("value") != "null"))


def markdown(df: DataFrame, title: str, most_rows: int = 1000) -> str:
    """A report's table as text; for summaries of few rows."""
    rows = df.limit(most_rows).collect()
    cell = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join(map(cell, r)) + " |" for r in rows]) + "\n"
