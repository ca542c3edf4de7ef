"""Quotas, caps and takes over ranked candidates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftline.operators.grouping import first_k, quality_order, top_k
from siftline.operators.staging import written


def quota_caps(gold: DataFrame, cell: list[str], label: str, order: str, budget: int) -> DataFrame:
    """Per cell and label the places of a budget, in proportion to the gold labels.

    ``max(1, round half even of budget * n / N)``, then one place more or less from the most common
    label on until the places sum to the budget; equal counts go by the label's first row in ``order``.
    Null labels are left out. Where labels outnumber the budget, a label may end with none.
    """
    n = gold.filter(F.col(label).isNotNull()).groupBy(*cell, label).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    w = Window.partitionBy(*cell)
    all_n = n.withColumn("_all", F.sum("n").over(w)).withColumn("_labels", F.count(F.lit(1)).over(w))
    cap = F.greatest(F.lit(1), F.bround(budget * F.col("n") / F.col("_all"), 0).cast("int"))
    c = all_n.withColumn("cap", cap).withColumn("_diff", budget - F.sum("cap").over(w))
    c = c.withColumn("_k", F.row_number().over(Window.partitionBy(*cell).orderBy(F.desc("n"), "_first")))
    # the difference is dealt out one by one, round after round
    deal = F.floor((F.abs("_diff") - F.col("_k")) / F.col("_labels")).cast("int") + 1
    moved = F.when(F.col("_diff") == 0, 0).otherwise(F.signum(F.col("_diff").cast("double")).cast("int") * F.greatest(F.lit(0), deal))
    return c.select(*cell, label, "n", F.greatest(F.lit(0), F.col("cap") + moved).alias("cap"))


def _within_sources(df: DataFrame, cell: list[str], source: str, score: str, tie: str, cap: int) -> DataFrame:
    """The best ``cap`` rows of each source; rows without a source meet no cap."""
    rows = df.withColumn("_source", F.coalesce(F.concat(F.lit("s"), F.col(source)), F.concat(F.lit("r"), F.col(tie).cast("string"))))
    return top_k(rows, [*cell, "_source"], quality_order(score), F.lit(cap), tie).drop("rank", "_source")


def source_capped(df: DataFrame, cell: list[str], source: str, score: str, tie: str, cap: int, budget: int) -> DataFrame:
    """The best ``budget`` rows of each cell with at most ``cap`` rows of a source; rows without a source meet no cap.

    Hot cells and sources are ranked in parts (``top_k``). A budget of 0 gives no rows.
    """
    return top_k(_within_sources(df, cell, source, score, tie, cap), cell, quality_order(score), F.lit(budget), tie)


def laminar_take(df: DataFrame, caps: DataFrame, cell: list[str], label: str, source: str, score: str, tie: str, cap: int, budget: int) -> DataFrame:
    """Quota and source-capped take where each source has one label, as a plain plan of ranks.

    The best ``cap`` rows of each source; of these the best of each label up to its quota; then, of the rest,
    the best until the budget is full. Labels without a quota may take the whole budget. The rank is that of taking.
    """
    live = _within_sources(df, cell, source, score, tie, cap).withColumn("_label", F.coalesce(label, F.lit("None")))
    quota = caps.select(*cell, F.col(label).alias("_label"), F.col("cap").alias("_cap"))
    live = live.join(quota, [*cell, "_label"], "left").withColumn("_cap", F.coalesce("_cap", F.lit(budget)))
    first = first_k(live, [*cell, "_label"], quality_order(score), F.col("_cap"), tie).withColumn("_late", F.col("rank").isNull().cast("int")).drop("rank")
    return top_k(first, cell, [F.col("_late"), *quality_order(score)], F.lit(budget), tie).drop("_late", "_label", "_cap")


def is_laminar(df: DataFrame, cell: list[str], label: str, sources: str) -> bool:
    """Whether every row has at most one source and every source of a cell one label; then ``laminar_take`` equals ``greedy_take``."""
    one = df.select(*cell, F.size(F.array_distinct(F.coalesce(sources, F.array().cast("array<string>")))).alias("_n"), F.get(sources, F.lit(0)).alias("_s"), F.coalesce(label, F.lit("None")).alias("_l"))
    per = one.groupBy(*cell, "_s").agg(F.max("_n").alias("n"), F.when(F.col("_s").isNotNull(), F.min("_l") != F.max("_l")).alias("mixed"))
    worst = per.agg(F.max("n").alias("n"), F.max("mixed").alias("mixed")).first()
    return (worst.n or 0) <= 1 and not worst.mixed


class Take:
    """The walk through one cell's ranked rows: what was taken, how often each label and source was, and whether a row fits."""

    def __init__(self, cap: int, budget: int, taken=(), labels=None, sources=None) -> None:
        self.cap, self.budget = cap, budget
        self.taken, self.labels, self.sources = list(taken), dict(labels or {}), dict(sources or {})

    def full(self) -> bool:
        return len(self.taken) >= self.budget

    def offer(self, record: str, sources: list[str], label: str | None = None, quota: int = 0) -> bool:
        """Takes a row unless a source is used up or its label's quota is; without a label the quota isn't asked."""
        if self.full() or any(self.sources.get(x, 0) >= self.cap for x in sources) or (label is not None and self.labels.get(label, 0) >= quota):
            return False
        self.taken.append(record)
        for x in sources:
            self.sources[x] = self.sources.get(x, 0) + 1
        if label is not None:
            self.labels[label] = self.labels.get(label, 0) + 1
        return True


def _walker(cell: list[str], tie: str, cap: int, budget: int, start: bool):
    """The function that walks through a round's rows of one cell and returns its new state."""

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rank")
        one = part.iloc[0]
        t = Take(cap, budget, one["_taken"], one["_labels"], one["_used"])
        waiting = [(str(r), list(s), q, int(c)) for r, s, q, c in zip(part[tie], part["_sources"], part["_label"], part["_cap"])]
        if one["_pass"] == 1:
            waiting = [x for x in waiting if not t.offer(*x)]
        whole = bool(one["_n"] <= len(part))
        last = bool(one["_pass"] == 2)
        if last or (whole and start):  # all rows are here: the waiting fill up at once
            for r, s, _, _ in waiting:
                t.offer(r, s)
        # a first pass that has seen all its rows is followed by a second one
        state = {"_taken": [t.taken], "_labels": [t.labels], "_used": [t.sources], "_pass": [2 if last or whole else 1], "_more": [not (whole and (last or start))]}
        return pd.DataFrame({k: [one[k]] for k in cell} | state)

    return walk


#: Rows of a cell that one task walks through at a time.
WALK_ROWS = 50_000


def greedy_take(df: DataFrame, caps: DataFrame, cell: list[str], label: str, sources: str, score: str, tie: str, cap: int, budget: int, walk_rows: int = WALK_ROWS) -> DataFrame:
    """The quota and source-capped take in general: in rank order, rows over a quota or a source cap wait; then the waiting fill up.

    A cell is walked through in rounds of its best ``walk_rows`` rows that may still be taken: the counts of labels and sources
    of a round are a small table, and before the next round rows of full labels and used-up sources are joined
    away, which no walk could take. When none are left, the second pass over the waiting rows goes in the same rounds,
    without quotas. So a task sees ``walk_rows`` rows whatever the cell's size; cells within it need one round.
    Rows without a source meet no source cap. Null labels count as "None"; labels without a quota may take the whole budget.
    """
    quota = caps.select(*cell, F.col(label).alias("_label"), F.col("cap").alias("_cap"))
    rows = df.select(*cell, F.col(tie), F.coalesce(F.col(label), F.lit("None")).alias("_label"), F.filter(F.array_distinct(F.coalesce(sources, F.array().cast("array<string>"))), lambda x: x.isNotNull()).alias("_sources"), F.col(score).alias("_score"))
    rows = written(rows.join(quota, [*cell, "_label"], "left").withColumn("_cap", F.coalesce("_cap", F.lit(budget))), "ranked")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    state_type = "_taken array<string>, _labels map<string,int>, _used map<string,int>, _pass int, _more boolean"
    state = None
    while True:
        live = rows
        if state is not None:
            live = live.join(state.filter(F.col("_more") & (F.size("_taken") < budget)), cell)
            live = live.filter(~F.array_contains("_taken", F.col(tie).cast("string")))
            live = live.filter(~F.exists("_sources", lambda x: F.coalesce(F.try_element_at("_used", x), F.lit(0)) >= cap))
            live = live.filter((F.col("_pass") == 2) | (F.coalesce(F.try_element_at("_labels", F.col("_label")), F.lit(0)) < F.col("_cap")))
        n = live.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
        head = top_k(live, cell, quality_order("_score"), F.lit(walk_rows), tie).join(n, cell)
        if state is None:
            head = head.withColumns({"_taken": F.array().cast("array<string>"), "_labels": F.create_map().cast("map<string,int>"), "_used": F.create_map().cast("map<string,int>"), "_pass": F.lit(1)})

        done = head.groupBy(*cell).applyInPandas(_walker(cell, tie, cap, budget, state is None), ", ".join(f"{k} {kinds[k]}" for k in cell) + ", " + state_type)
        if state is not None:  # cells that had nothing left to offer in the first pass go on with the second; others are finished
            rest = state.join(done.select(*cell), cell, "left_anti")
            rest = rest.withColumn("_more", F.col("_more") & (F.col("_pass") == 1) & (F.size("_taken") < budget)).withColumn("_pass", F.lit(2))
            done = done.unionByName(rest)
        state = written(done, "taken")
        if not state.filter(F.col("_more") & (F.size("_taken") < budget)).limit(1).count():
            break
    out = state.select(*cell, F.posexplode("_taken").alias("rank", "_record"))
    return out.select(*cell, F.col("_record").cast(kinds[tie]).alias(tie), (F.col("rank") + 1).cast("int").alias("rank"))


def budgeted_take(df: DataFrame, caps: DataFrame, cell: list[str], label: str, sources: str, score: str, tie: str, cap: int, budget: int) -> DataFrame:
    """``cell, tie, rank`` of the quota and source-capped take: by plain ranks where sources and labels allow it, walked through where not."""
    if is_laminar(df, cell, label, sources):
        taken = laminar_take(df.withColumn("_first", F.get(sources, F.lit(0))), caps, cell, label, "_first", score, tie, cap, budget)
        return taken.select(*cell, tie, F.col("rank").cast("int").alias("rank"))
    return greedy_take(df, caps, cell, label, sources, score, tie, cap, budget)


def hashed_order(record: str, seed: int):
    """A random order that any engine can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(record)).cast("binary"))


def sample_flat(df: DataFrame, cell: list[str], record: str, budget: int, seed: int) -> DataFrame:
    """``budget`` random rows of each cell."""
    return top_k(df, cell, [hashed_order(record, seed)], F.lit(budget), record).drop("rank")


def sample_balanced(df: DataFrame, cell: list[str], label: str, record: str, budget: int, seed: int) -> DataFrame:
    """Random rows of each cell, one of each label in turn, until the budget is full."""
    turn = top_k(df.filter(F.col(label).isNotNull()), [*cell, label], [hashed_order(record, seed)], F.lit(budget), record).withColumnRenamed("rank", "_k")
    return top_k(turn.withColumn("_l", F.col(label)), cell, [F.col("_k"), F.col("_l")], F.lit(budget), record).drop("_k", "_l", "rank")


def sample_per_class(df: DataFrame, cell: list[str], label: str, record: str, budget: int, seed: int) -> DataFrame:
    """``budget`` rows of every label where all have as many; else ``budget`` rows in all, in proportion.

    In proportion: labels in order take at least one and their half-even share, as long as the budget has places left, one where
    it has none, and the last label what is left; then rows that were left out fill up, and what is too much is cut,
    both in the random order. Null labels are one label, "None". Of a label only the rows that can be taken are sorted with others.
    """
    rows = df.withColumn("_label", F.coalesce(F.col(label), F.lit("None")))
    n = rows.groupBy(*cell, "_label").agg(F.count(F.lit(1)).alias("_n"))
    c = Window.partitionBy(*cell)
    up = Window.partitionBy(*cell).orderBy("_label")
    n = n.withColumn("_least", F.min("_n").over(c)).withColumn("_all", F.sum("_n").over(c)).withColumn("_i", F.row_number().over(up)).withColumn("_of", F.count(F.lit(1)).over(c))
    n = n.withColumn("_share", F.least("_n", F.greatest(F.lit(1), F.bround(budget * F.col("_n") / F.col("_all"), 0).cast("int"))))
    left = F.greatest(F.lit(0), budget - F.coalesce(F.sum("_share").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = n.withColumn("_left", left)
    part = F.when(F.col("_i") == F.col("_of"), F.col("_left")).when(F.col("_left") > 0, F.least("_share", "_left")).otherwise(1)
    n = n.withColumn("_take", F.when(F.col("_least") >= budget, budget).otherwise(part))
    # beside its own places a label can fill up at most the whole budget
    rows = top_k(rows, [*cell, "_label"], [hashed_order(record, seed)], F.lit(2 * budget), record).withColumnRenamed("rank", "_k")
    rows = rows.join(n.select(*cell, "_label", "_take", "_least"), [*cell, "_label"]).withColumn("_late", (F.col("_k") > F.col("_take")).cast("int"))
    full = rows.filter((F.col("_least") >= budget) & (F.col("_late") == 0))
    rest = top_k(rows.filter(F.col("_least") < budget), cell, [F.col("_late"), hashed_order(record, seed)], F.lit(budget), record).drop("rank")
    return full.unionByName(rest).drop("_k", "_take", "_least", "_late", "_label")


#: Tasks whose seeds may be sampled by label; others are sampled flat.
LABELLED_TASKS = ("news_topic_classification", "sentiment_classification", "intent_slot_filling")


def sample_gold(df: DataFrame, cell: list[str], task: str, label: str, record: str, budget: int, seed: int, strategy: str = "per_class") -> DataFrame:
    """Seeds of each cell by a strategy: per_class, balanced or random; cells of tasks without labels, and all under random, are sampled flat.

    An unknown strategy raises ValueError.
    """
    if strategy not in ("random", "balanced", "per_class"):
        raise ValueError(f"unknown sampling strategy {strategy}")
    labelled = F.coalesce(F.col(task).isin(*LABELLED_TASKS), F.lit(False)) if strategy != "random" else F.lit(False)
    flat = sample_flat(df.filter(~labelled), cell, record, budget, seed)
    by = sample_per_class if strategy == "per_class" else sample_balanced
    return flat if strategy == "random" else flat.unionByName(by(df.filter(labelled), cell, label, record, budget, seed))
