"""Plans of runs: cells of a grid, the commands of their stages, ablations and checks of what they left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators.config import RunConfig


def cell_filter(datasets: list[str], tasks: list[str], languages: list[str]) -> Column:
    """Whether a row's cell is asked for; an empty list asks for all."""
    out = F.lit(True)
    for name, wanted in (("dataset_id", datasets), ("task", tasks), ("language", languages)):
        if wanted:
            out = out & F.col(name).isin(wanted)
    return out


def expand(manifest: DataFrame, cfg: RunConfig) -> DataFrame:
    """Every cell of a configuration: dataset, task, language, budget, multiplier, selection_multiplier, seed and slug."""
    g = manifest.filter(cell_filter(cfg.datasets, cfg.tasks, cfg.languages)).select("dataset_id", "task", "language").distinct()
    for name, values in (("budget", cfg.budgets), ("multiplier", cfg.multipliers), ("seed", cfg.seeds)):
        g = g.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    own = F.col("multiplier") if cfg.selection_multiplier is None else F.lit(cfg.selection_multiplier)
    return g.withColumn("selection_multiplier", own).withColumn("slug", F.format_string("b%d_m%d_s%d", "budget", "multiplier", "seed"))


GOLD_ONLY = "gold_only"
_PROGRAM = "python -m siftline"


def _cell_folder(cfg: RunConfig, run: str) -> Column:
    return F.concat_ws("/", F.lit(cfg.output_dir), F.lit(run), "task", "language", "slug")


def _steps(cells: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """One row per cell and step: stage, step and command."""
    listed = F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(i).alias("step"), c.alias("command")) for i, (s, c) in enumerate(steps)])
    return cells.select("dataset_id", "task", "language", "slug", F.explode(listed).alias("x")).select("dataset_id", "task", "language", "slug", "x.*")


def commands(cells: DataFrame, cfg: RunConfig, run: str, config: str) -> DataFrame:
    """The commands of every cell from seeds to evaluations, in order: seeds, candidates, counterfactuals, judgements unless disabled, audit, and of each baseline the selection and evaluation.

    ``gold_only`` is evaluated without a selection.
    """
    cells = cells.withColumn("_b", _cell_folder(cfg, run))
    b, text = F.col("_b"), lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    cell = text("--manifest ", cfg.manifest_path, " --dataset-id ", F.col("dataset_id"), " --language ", F.col("language"))
    own = text(cell, " --budget ", F.col("budget"), " --seed ", F.col("seed"))
    strategy = f" --sampling-strategy {cfg.seed_sampling}" if cfg.seed_sampling else "" if cfg.sample_per_class_when_possible else " --sampling-strategy random"
    judge = cfg.judge.backend not in ("disabled", "none", "")
    last = "candidates_judged" if judge else "candidates_cf"
    out = [
        ("make-seeds", text(f"{_PROGRAM} make-seeds ", own, " --out ", b, "/gold", strategy)),
        ("generate", text(f"{_PROGRAM} generate --config {config} --seed-file ", b, "/gold --out ", b, "/candidates --candidates-per-seed ", F.col("multiplier"), " --resume")),
        ("counterfactuals", text(f"{_PROGRAM} counterfactuals --config {config} --candidates ", b, "/candidates --out ", b, "/candidates_cf --resume")),
    ]
    if judge:
        out.append(("judge", text(f"{_PROGRAM} judge --config {config} --candidates ", b, "/candidates_cf --out ", b, "/candidates_judged --resume")))
    out.append(("audit", text(f"{_PROGRAM} audit --config {config} ", own, " --gold ", b, "/gold --candidates ", b, f"/{last} --out ", b, "/audit")))
    for name in cfg.baselines or ["audited"]:
        chosen = "" if name == GOLD_ONLY else f"/selected/{name}"
        if chosen:
            out.append(("select", text(f"{_PROGRAM} select --config {config} --audit ", b, "/audit --gold ", b, "/gold --out ", b, chosen, " --multiplier ", F.col("selection_multiplier"), f" --baseline {name} --seed ", F.col("seed"))))
        out.append(("evaluate", text(f"{_PROGRAM} evaluate ", cell, " --gold ", b, "/gold", *([" --selected ", b, chosen] if chosen else []), " --out ", b, f"/results/{name}")))
    return _steps(cells, out)


def training_commands(cells: DataFrame, cfg: RunConfig, run: str, trainer: str, classifier: str, summarizer: str, deterministic: bool = False) -> DataFrame:
    """The fine-tuning commands of every cell and baseline for an external ``trainer``; summarization has its own model, batch size and length."""
    cells = cells.withColumn("_b", _cell_folder(cfg, run))
    b, text = F.col("_b"), lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    by = lambda a, c: F.when(F.col("task") == "summarization", a).otherwise(c)
    out = []
    for name in cfg.baselines or ["audited"]:
        chosen = [" --selected ", b, f"/selected/{name}"] if name != GOLD_ONLY else []
        out.append(("train", text(f"{trainer} --manifest {cfg.manifest_path} --dataset-id ", F.col("dataset_id"), " --language ", F.col("language"), " --gold ", b, "/gold", *chosen, " --out-dir ", b, f"/hf/{name} --model ", by(summarizer, classifier), " --epochs 3 --batch-size ", by("4", "16"), " --max-length ", by("512", "256"), " --seed ", F.col("seed"), " --deterministic" if deterministic else "")))
    return _steps(cells, out)


#: Stages that a phase keeps.
PHASES = {"generation": ("make-seeds", "generate", "counterfactuals"), "judge": ("make-seeds", "judge", "audit", "select", "evaluate"), "selection": ("select", "evaluate")}


def phase(plan: DataFrame, name: str) -> DataFrame:
    """The commands of one phase, of cells of which more than one remains; an unknown phase raises ValueError."""
    if name not in PHASES:
        raise ValueError(f"unknown phase {name}")
    cell = ["dataset_id", "language", "slug"]
    kept = plan.filter(F.col("stage").isin(*PHASES[name]))
    return kept.join(kept.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*cell), cell, "left_semi")


# The ablations, each with what it sets in the audit's parameters; the last ones change the take.
ABLATIONS = {
    "full": {},
    "no_leakage_filter": {"tau_l": 1e9, "alpha_l": 0.0},
    "no_counterfactual_score": {"tau_c": -1.0, "alpha_c": 0.0},
    "no_shortcut_score": {"tau_h": 1e9, "alpha_h": 0.0},
    "no_diversity_score": {"alpha_d": 0.0},
    "no_class_balancing": {"quotas": False},
    "hard_filter_only": {"alpha_u": 0.0, "alpha_c": 0.0, "alpha_d": 0.0, "alpha_l": 0.0, "alpha_h": 0.0},
    "soft_rank_only": {"tau_l": 1e9, "tau_c": -1.0, "tau_h": 1e9},
}


def checks(expected: DataFrame, found: DataFrame, keys: list[str], minimum: int = 1) -> DataFrame:
    """``keys, rows, ok``: whether every expected file or table has at least ``minimum`` rows; ``found`` has keys and ``rows``, those that are missing have none."""
    j = expected.select(*keys).distinct().join(found.select(*keys, "rows"), keys, "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    return j.withColumn("ok", F.col("rows") >= minimum)


# Phrases that claim people's judgements where models judged.
PHRASES = {
    "human_audit": r"(?i)\bhuman audit\b", "krippendorff": r"(?i)\bKrippendorff", "kappa": r"(?i)\bCohen'?s?\s+kappa\b|\bκ\b",
    "native_speaker": r"(?i)\bnative[- ]speaker validation\b", "annotator_agreement": r"(?i)\bannotator agreement\b",
}


def lint(df: DataFrame, key: str, text: str, rules: dict[str, str] | None = None) -> DataFrame:
    """``key, line, rule``: the lines of a text that match a rule's pattern, counted from 1."""
    lines = df.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, r"\r?\n")).alias("_i", "_l"))
    hits = F.filter(F.array(*[F.when(F.col("_l").rlike(p), F.lit(n)) for n, p in (rules or PHRASES).items()]), lambda x: x.isNotNull())
    return lines.select(key, (F.col("_i") + 1).alias("line"), F.explode(hits).alias("rule"))


def read_config_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]
