"""The audit of candidates against gold and held-out texts, and selection from it, as whole plans."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions.embedding import CHUNK, embedder
from siftline.functions.text import stripped, tokens
from siftline.operators import scoring as sc
from siftline.operators import selection as sel
from siftline.operators.config import AuditConfig
from siftline.operators.generation import consistency, has_judgement, utility
from siftline.operators.grouping import quality_order, top_k
from siftline.operators.leakage import HeldGrams, leakage
from siftline.operators.shortcut import form_features, label_word, shortcut_score
from siftline.operators.staging import written
from siftline.operators.vectors import BLOCK_REFERENCE, against_all, centroids, nearest_of, slack

#: What ``compared`` and ``joined`` add to candidates.
COMPARED = ["_teacher", "_vote", "_closest", "_held", "_expected", "exact", "jaccard"]


def audit(candidates: DataFrame, gold: DataFrame, heldout: DataFrame, cfg: AuditConfig | None = None, cell: str = "run_id", embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per candidate with the scores u, l, h, d, c, s, their parts, hard_reject and reject_reasons.

    Candidates have candidate_id, the cell column, text, label, generator_confidence, metadata and counterfactual; gold has id, text,
    label; held-out texts have item_id and text. Of a candidate sent again the latest row counts. A curated gold and held-out side and an
    embedder that has ``rows`` meet the candidates in one pass without a shuffle (``compared``); else texts are embedded and written, and the sets meet as
    vectors and by joins (``joined``), with the same result. Defaults stand where a side is empty: teacher and vote 0.5, diversity 1, leakage 0.
    """
    cfg = cfg or AuditConfig()
    embed = embed or embedder(cfg.embedder, dim=cfg.embedding_dim)
    order = [F.col(c) for c in ("received_at", "generator_confidence") if c in candidates.columns]
    kept = list(dict.fromkeys([cell, "text", "label", "source_seed_ids", "metadata", "generator_confidence", "counterfactual"]))
    base = candidates.filter(F.col("candidate_id").isNotNull()).groupBy("candidate_id").agg(F.max_by(F.struct(*kept), F.struct(*order) if order else F.lit(0)).alias("_r")).select("candidate_id", "_r.*")
    there = stripped(F.coalesce("text", F.lit(""))) != ""  # withheld texts are no neighbours
    g = gold.filter(F.col("id").isNotNull() & there).select("id", "label", "text")
    curated = hasattr(embed, "rows") and g.count() + heldout.count() <= BLOCK_REFERENCE
    fields = {f.name for f in base.schema["counterfactual"].dataType.fields}
    validity = F.col("counterfactual.judge_validity") if "judge_validity" in fields else F.lit(None).cast("double")
    known = {"_quality": F.col("judge_quality_score"), "_judged": has_judgement(F.col("metadata")), "_semantic": F.col("counterfactual.semantic_edit_score"), "_validity": validity}
    x = form_features(sc.with_judgement((compared if curated else joined)(base, g, heldout, cfg, embed, there)).withColumns(known), "text")
    x = written(x.select("candidate_id", *[c for c in kept if c != "counterfactual"], *known, *COMPARED, "length", "template", "names", "punctuation"), "compared")
    x = shortcut_score(label_word(x, cell, "text", "label"), cell)
    risk = F.greatest(F.lit(0.0), (F.col("_held") - cfg.embedding_threshold) / max(1 - cfg.embedding_threshold, 1e-6))
    x = x.withColumns({
        "u": utility(F.col("_quality"), F.col("generator_confidence"), F.col("_teacher"), F.col("_vote")),
        "l": F.greatest("exact", "jaccard", risk),
        "d": F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("_closest"))),
        "c": consistency(F.col("_semantic"), F.col("_validity"), F.col("_judged"), F.col("_expected")),
    })
    x = x.withColumn("s", sc.soft_score(cfg)).withColumn("reject_reasons", sc.reject_reasons(cfg)).withColumn("hard_reject", F.size("reject_reasons") > 0)
    parts = F.struct(F.struct(F.col("_teacher").alias("teacher"), F.col("_vote").alias("vote")).alias("utility"), F.struct("exact", "jaccard", risk.alias("embedding")).alias("leakage"), F.struct("label_word", "template", "length", "names", "punctuation").alias("shortcut"), F.struct(F.col("_expected").alias("expected"), F.coalesce("_validity", "_semantic", F.lit(0.0)).alias("semantic")).alias("consistency"))
    return x.select("candidate_id", cell, "text", "label", "source_seed_ids", "metadata", "generator_confidence", "u", "l", "h", "d", "c", "s", parts.alias("score_parts"), "hard_reject", "reject_reasons")


def compared(base: DataFrame, gold: DataFrame, heldout: DataFrame, cfg: AuditConfig, embed: Callable[[Column], Column], there: Column) -> DataFrame:
    """Adds to ``base`` what gold and held-out texts tell of it, in one pass that keeps no vector.

    ``_teacher`` and ``_expected`` are the softmax probabilities of the row's and its counterfactual's label (0.5 for a null one or without a teacher, 0 for
    one unknown to it), ``_vote`` the share of the label among the ``neighbor_k`` nearest gold texts, ``_closest`` and ``_held`` the largest cosines to gold
    and held-out texts (the latter rough where it can't reach the threshold), ``exact`` and ``jaccard`` those of ``leakage``. Both sides, BLOCK_REFERENCE rows at most, go to the workers once.
    """
    import numpy as np

    rows = sorted(gold.collect(), key=lambda r: r.id)
    held = heldout.select("text", there.alias("there"), tokens(F.col("text")).alias("t")).collect()
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    vectors = embed.rows([r.text for r in rows]).astype(np.float64)
    classes = sorted({r.label for r in rows if r.label is not None})
    of = {label: i for i, label in enumerate(classes)}
    mine = np.array([of.get(r.label, -1) for r in rows], np.int64)
    many, k, dim = len(rows), min(cfg.neighbor_k, len(rows)), vectors.shape[1]
    centre = unit(np.array([vectors[mine == i].mean(0) for i in range(len(classes))]).reshape(-1, dim))
    reference = np.vstack([unit(vectors), unit(embed.rows([r.text for r in held if r.there]).astype(np.float64).reshape(-1, dim))])
    rough_reference = reference.astype(np.float32)
    grams, rows_of = HeldGrams([r.t for r in held], cfg.ngram_n, cfg.shingle_n), embed.rows

    def chance(x, label):
        if not classes:
            return np.full(len(label), 0.5)
        e = np.exp((np.round(x @ centre.T, 9) - 1) / 0.25)
        known = np.array([-2 if x is None else of.get(x, -1) for x in label], np.int64)
        return np.where(known == -2, 0.5, np.where(known == -1, 0.0, e[np.arange(len(known)), known] / e.sum(1)))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = lambda name: batch.column(names.index(name))
        label = at("label").to_pylist()
        x = unit(rows_of([t or "" for t in at("text").to_pylist()]).astype(np.float64))
        rough = x.astype(np.float32) @ rough_reference.T
        vote, closest = np.full(len(x), 0.5), np.zeros(len(x))
        if k > 0:
            near, best = nearest_of(x, reference[:many], rough[:, :many], k)
            closest = near[:, 0]
            known = np.array([-2 if v is None else of.get(v, -3) for v in label], np.int64)
            vote = np.where(known == -2, 0.5, (mine[best] == known[:, None]).sum(1) / k)
        leaked = rough[:, many:].max(1).astype(np.float64) if len(reference) > many else np.zeros(len(x))
        beyond = np.flatnonzero(leaked > cfg.embedding_threshold - slack(dim))
        if len(beyond):
            leaked[beyond] = np.round(x[beyond] @ reference[many:].T, 9).max(1) if len(reference) > many else 0.0
        expected = np.full(len(x), 0.5)
        edit = at("counterfactual")
        edits = pc.struct_field(edit, "text").to_pylist()
        edited = np.array([i for i, t in enumerate(edits) if t is not None], np.int64)
        if len(edited):
            y = unit(rows_of([edits[i] for i in edited]).astype(np.float64))
            expected[edited] = chance(y, pc.struct_field(edit, "label").take(pa.array(edited)).to_pylist())
        exact, jaccard = grams.scores(at("_tokens"))
        found = [chance(x, label), vote, closest, leaked, expected, exact, jaccard]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, found)], [*names[:-1], *COMPARED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, CHUNK):
                yield one(batch.slice(i, CHUNK))

    names = [*base.columns, "_tokens"]
    kinds = T.StructType([*base.schema.fields, *[T.StructField(n, T.DoubleType()) for n in COMPARED]])
    return base.withColumn("_tokens", tokens(F.col("text"))).mapInArrow(run, kinds)


def joined(base: DataFrame, gold: DataFrame, heldout: DataFrame, cfg: AuditConfig, embed: Callable[[Column], Column], there: Column) -> DataFrame:
    """As ``compared``, for sides of any size and any embedder: vectors are written, held-out n-grams are joined."""
    cf = F.col("counterfactual.text")
    base = written(base.withColumns({"_v": embed(F.coalesce("text", F.lit(""))), "_cv": F.when(cf.isNotNull(), embed(F.coalesce(cf, F.lit(""))))}), "embedded")
    vector = embed(F.coalesce("text", F.lit(""))).alias("vector")
    g = written(gold.select("id", "label", vector), "gold")
    held = heldout.filter(there).select(F.col("item_id").cast("string").alias("id"), vector, F.lit("").alias("label"))
    # as many centroids as classes; they are the reference of the teacher
    centre = centroids(g, "label", "vector").groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "value"))), lambda p: p["value"]).alias("vector")).withColumn("id", F.col("label"))
    classes = g.select("label").na.drop().distinct().count()

    near = against_all(base, "candidate_id", {"_v": [("_near", g, cfg.neighbor_k), ("_held", held, 1), ("_own", centre, max(1, classes))], "_cv": [("_edit", centre, max(1, classes))]})
    leak = leakage(base, "candidate_id", "text", heldout, "item_id", "text", cfg.ngram_n, cfg.shingle_n).drop("l")

    def teacher(near: str, label: Column) -> Column:
        """The softmax probability of a label: 0.5 for a null one or without a teacher, 0 for one unknown to it."""
        e = F.transform(near, lambda n: F.struct(n["label"].alias("label"), F.exp((n["cosine"] - 1) / 0.25).alias("e")))
        mine = F.aggregate(e, F.lit(0.0), lambda s, n: s + F.when(n["label"] == label, n["e"]).otherwise(0.0))
        known = F.exists(near, lambda n: n["label"] == label)
        return F.when(label.isNull() | (F.size(near) == 0), 0.5).when(known, mine / F.aggregate(e, F.lit(0.0), lambda s, n: s + n["e"])).otherwise(0.0)

    first = lambda a: F.coalesce(F.get(F.col(a), F.lit(0))["cosine"], F.lit(0.0))
    hits = F.size(F.filter("_near", lambda n: n["label"] == F.col("label")))
    vote = F.when(F.col("label").isNull() | (F.size("_near") == 0), 0.5).otherwise(hits / F.size("_near"))
    x = base.join(near, "candidate_id").join(leak, "candidate_id")
    found = [teacher("_own", F.col("label")), vote, first("_near"), first("_held"), teacher("_edit", F.col("counterfactual.label")), F.col("exact"), F.col("jaccard")]
    return x.select(*[c for c in base.columns if c not in ("_v", "_cv")], *[f.alias(n) for f, n in zip(found, COMPARED, strict=True)])


def as_candidates(rows: DataFrame) -> DataFrame:
    """Rows of the stages in the form in which the audit takes candidates: one list of seeds, metadata as JSON and the counterfactual as a struct."""
    has = lambda c, kind="string": F.col(c) if c in rows.columns else F.lit(None).cast(kind)
    out = rows
    if "source_seed_ids" not in rows.columns:
        out = out.withColumn("source_seed_ids", F.array(has("seed_id")))
    if "metadata" not in rows.columns:
        judged = F.struct(*[F.col(n) for n in sc.JUDGED if n in rows.columns])
        out = out.withColumn("metadata", F.to_json(F.struct(judged.alias("llm_judge"))) if "quality_score" in rows.columns else F.lit(None).cast("string"))
    if "counterfactual" not in rows.columns:
        cf = F.struct(has("cf_text").alias("text"), has("cf_label").alias("label"), has("cf_score", "double").alias("semantic_edit_score"), has("judge_validity", "double").alias("judge_validity"))
        out = out.withColumn("counterfactual", F.when(has("cf_text").isNotNull(), cf))
    return out


def select_candidates(audited: DataFrame, gold: DataFrame, baseline: str, budget: int, cfg: AuditConfig | None = None, cell: str = "run_id", max_per_source: int = 3, seed: int = 13) -> DataFrame:
    """``cell, candidate_id, rank``: a baseline's pool, ranked and taken within label quotas and source caps.

    naive and random take by their order alone; with one gold label or none there are no quotas. Unknown baselines raise ValueError.
    """
    cfg = cfg or AuditConfig()
    rows = sc.with_judgement(audited).filter(sc.pool_filter(baseline, cfg)).withColumn("_score", F.round(sc.rank_score(baseline, cfg, seed), 9))
    if baseline in ("naive", "random"):
        return top_k(rows, [cell], quality_order("_score"), F.lit(budget), "candidate_id").select(cell, "candidate_id", "rank")
    caps = sel.quota_caps(gold.withColumn("_all", F.lit(0)), ["_all"], "label", "id", budget)
    if caps.count() <= 1:
        caps = caps.filter("false")
    per_cell = rows.select(cell).distinct().withColumn("_all", F.lit(0)).join(caps, "_all").select(cell, "label", "cap")
    return sel.budgeted_take(rows, per_cell, [cell], "label", "source_seed_ids", "_score", "candidate_id", max_per_source, budget)


def select_all(audited: DataFrame, gold: DataFrame, budget: int, baselines: list[str] | None = None, **options) -> DataFrame:
    """``baseline`` and the columns of ``select_candidates`` for several baselines, all those known where none are named."""
    each = [select_candidates(audited, gold, b, budget, **options).withColumn("baseline", F.lit(b)) for b in baselines or list(sc.POOLS)]
    out = each[0]
    for d in each[1:]:
        out = out.unionByName(d)
    return out
