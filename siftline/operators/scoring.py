"""Gates, soft scores and rank scores of audited candidates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import bounded, word_count
from siftline.operators.config import AuditConfig


def _at_most(x: str, most: float) -> Column:
    """A missing score counts as 0; NaN is beyond no threshold."""
    return F.coalesce(F.nanvl(F.col(x), F.lit(0.0)), F.lit(0.0)) <= most


def passes(cfg: AuditConfig, tau_c: float | None = None, l: str = "l", h: str = "h", c: str = "c") -> Column:
    """Whether leakage and shortcut are at most, and consistency at least, their thresholds; missing scores count as 0, NaN passes each."""
    ok = _at_most(l, cfg.tau_l) & _at_most(h, cfg.tau_h)
    return ok if tau_c is None else ok & (F.coalesce(F.col(c), F.lit(0.0)) >= tau_c)


def reject_reasons(cfg: AuditConfig) -> Column:
    """Names of the gates that a row fails, in order."""
    hits = F.array(
        F.when(~_at_most("l", cfg.tau_l), F.lit("leakage")),
        F.when(F.coalesce(F.col("c"), F.lit(0.0)) < cfg.tau_c, F.lit("counterfactual")),
        F.when(~_at_most("h", cfg.tau_h), F.lit("shortcut")),
    )
    return F.filter(hits, lambda x: x.isNotNull())


def soft_score(cfg: AuditConfig) -> Column:
    """Utility, consistency and diversity upwards, leakage and shortcut downwards, by their weights."""
    return cfg.alpha_u * F.col("u") + cfg.alpha_c * F.col("c") + cfg.alpha_d * F.col("d") - cfg.alpha_l * F.col("l") - cfg.alpha_h * F.col("h")


JUDGED = ["label_correctness", "fluency", "cultural_plausibility", "leakage_suspicion", "counterfactual_validity", "quality_score"]


def with_judgement(df: DataFrame) -> DataFrame:
    """Typed numbers of the judge from the JSON column ``metadata``: null where missing, 0 for what is there but no number."""

    def number(path: str) -> Column:
        raw = F.get_json_object("metadata", path)
        return F.when(raw.isNotNull(), F.coalesce(raw.try_cast("double"), F.lit(0.0)))

    return df.withColumns({f"judge_{n}": number(f"$.llm_judge.{n}") for n in JUDGED} | {"judge_score": number("$.judge_score"), "influence_score": number("$.influence_score")})


# Weights of the re-ranking score's gains and losses, and its bonuses.
GAIN = {"correct": 1.25, "quality": 0.85, "fluent": 0.45, "fits": 0.35, "utility": 0.35, "keep": 0.65, "diverse": 0.45}
LOSS = {"leak": 1.40, "shortcut": 1.00, "suspect": 1.10, "under_c": 0.55, "over_l": 0.45, "over_h": 0.35}
STRICT_BONUS, RELAXED_BONUS = 0.25, 0.10


def rerank_score(cfg: AuditConfig) -> Column:
    """The re-ranking score of quality and audit terms, with bonuses for the gates and penalties beyond them.

    Missing audit scores fall back on the judge's numbers, and those on each other; each is held in [0, 1], NaN at 1. The
    bonuses go by the gates' own reading of missing and NaN scores.
    """
    judge = lambda n: F.col(f"judge_{n}")
    first = lambda *x: bounded(F.coalesce(*x))
    x = {"shortcut": bounded(F.col("h")), "diverse": bounded(F.col("d"))}
    x["utility"] = first(F.col("u"), judge("quality_score"))
    x["leak"] = first(F.col("l"), judge("leakage_suspicion"))
    x["keep"] = first(F.col("c"), judge("counterfactual_validity"))
    x["quality"] = first(judge("quality_score"), x["utility"])
    x["correct"] = first(judge("label_correctness"), x["utility"])
    x["fluent"] = first(judge("fluency"), x["quality"])
    x["fits"] = first(judge("cultural_plausibility"), x["quality"])
    x["suspect"] = first(judge("leakage_suspicion"), x["leak"])
    beyond = lambda a, b: F.greatest(F.lit(0.0), a - b)
    x |= {"under_c": beyond(F.lit(cfg.tau_c), x["keep"]), "over_l": beyond(x["leak"], F.lit(cfg.tau_l)), "over_h": beyond(x["shortcut"], F.lit(cfg.tau_h))}
    bonus = F.when(passes(cfg, cfg.tau_c), STRICT_BONUS).otherwise(0.0) + F.when(passes(cfg, cfg.relaxed_tau_c), RELAXED_BONUS).otherwise(0.0)
    return sum((w * x[k] for k, w in GAIN.items()), F.lit(0.0)) + bonus - sum((w * x[k] for k, w in LOSS.items()), F.lit(0.0))


#: Baselines by the pool that they rank: rows within the strict gate, the relaxed one, the one without consistency, or all.
POOLS = {
    "audited": "strict",
    "audited_hard": "strict",
    "quality_judge_hardreject": "strict",
    "audited_relaxed": "relaxed",
    "audited_soft": "soft",
    "equal_budget": "all",
    "rerank_v2": "all",
    "quality_only": "all",
    "diversity_only": "all",
    "quality_judge": "all",
    "quality_diversity": "all",
    "influence_style": "all",
    "naive": "all",
    "random": "all",
}


def pool_filter(baseline: str, cfg: AuditConfig) -> Column:
    if baseline not in POOLS:
        raise ValueError(f"unknown baseline {baseline}; known are {sorted(POOLS)}")
    kind = POOLS[baseline]
    if kind == "all":
        return F.lit(True)
    return passes(cfg, {"strict": cfg.tau_c, "relaxed": cfg.relaxed_tau_c, "soft": None}[kind])


def rank_score(baseline: str, cfg: AuditConfig, seed: int = 13) -> Column:
    """The score by which a baseline ranks its pool; needs the columns of ``with_judgement``."""
    if baseline in ("naive", "random"):
        at = seed + (7919 if baseline == "random" else 0)
        return F.conv(F.substring(F.md5(F.concat(F.lit(f"{at}|"), F.col("candidate_id")).cast("binary")), 1, 12), 16, 10).cast("double")
    u, d, soft = (F.coalesce(F.col(c), F.lit(0.0)) for c in "uds")
    quality = F.coalesce(F.col("judge_quality_score"), u)
    scores = {
        "equal_budget": F.when(F.col("hard_reject"), 0.0).otherwise(100.0) + soft,
        "rerank_v2": rerank_score(cfg),
        "quality_only": u,
        "diversity_only": d,
        "quality_judge": F.coalesce(F.col("judge_score"), quality),
        "quality_judge_hardreject": F.coalesce(F.col("judge_score"), quality),
        "quality_diversity": 0.45 * quality + 0.35 * d + 0.20 * F.least(F.lit(1.0), word_count(F.col("text")) / 256.0),
        "influence_style": F.coalesce(F.col("influence_score"), u + 0.25 * d),
    }
    return scores.get(baseline, soft)
