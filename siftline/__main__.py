"""Command line: the stages of a run over tables in folders, plans, ledgers and the catalogue's queries.

    python -m siftline make-seeds --manifest M --dataset-id D --language L --budget 64 --seed 13 --out GOLD
    python -m siftline generate --config C --seed-file GOLD --out CANDIDATES --resume
    python -m siftline audit --config C --dataset-id D --language L --gold GOLD --candidates CANDIDATES --out AUDIT
    python -m siftline select --config C --audit AUDIT --gold GOLD --out SELECTED --baseline audited --multiplier 1
    python -m siftline evaluate --dataset-id D --language L --gold GOLD --selected SELECTED --out RESULT
    python -m siftline run QUERY FOLDER OUT

Tables are folders of Parquet; a manifest is a table, beside which "records" (training) and "benchmark" (held out) lie.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siftline", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="what", required=True)

    def command(name: str, *required: str, **optional):
        s = sub.add_parser(name)
        for r in required:
            s.add_argument(f"--{r}", required=True)
        for key, default in optional.items():
            if isinstance(default, bool):
                s.add_argument(f"--{key.replace('_', '-')}", action="store_true")
            else:
                s.add_argument(f"--{key.replace('_', '-')}", default=default, type=type(default) if default is not None else str)
        return s

    cell = {"manifest": "data/manifest", "dataset_id": None, "language": None, "budget": 64, "seed": 13}
    command("make-seeds", "out", sampling_strategy="per_class", **cell)
    command("generate", "seed-file", "out", config=None, candidates_per_seed=0, limit=0, resume=False)
    command("counterfactuals", "candidates", "out", config=None, manifest="data/manifest", resume=False)
    command("judge", "candidates", "out", config=None, resume=False)
    command("audit", "gold", "candidates", "out", config=None, **cell)
    command("select", "audit", "gold", "out", config=None, budget=0, multiplier=1, baseline="audited", seed=13, max_per_source=3)
    command("evaluate", "gold", "out", selected=None, embedder="hash", manifest="data/manifest", dataset_id=None, language=None)
    command("plan-scenario", "config", run_name="scenario", phase=None, out=None)
    command("plan-training", "config", run_name="scenario", trainer="train", classification_model="classifier", summarization_model="summarizer", deterministic=False, out=None)
    command("plan-summary", "config", out=None)
    command("claim-ledger", "out", runs_dir="runs")
    s = sub.add_parser("run")
    for name in ("query", "folder", "out"):
        s.add_argument(name)
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    from siftline.functions.embedding import embedder
    from siftline.operators import evaluation, generation, planning, selection
    from siftline.operators.config import RunConfig, load_config
    from siftline.plans import audit as plans
    from siftline.sources import sinks
    from siftline.sources.readers import catalogue

    path = getattr(a, "config", None)
    cfg = load_config(planning.read_config_text(spark, path)) if path else RunConfig()
    read = spark.read.parquet
    manifest = getattr(a, "manifest", None) or cfg.manifest_path
    beside = lambda name: read(f"{manifest.rstrip('/').rpartition('/')[0] or '.'}/{name}")

    def asked(rows: DataFrame) -> DataFrame:
        return rows.filter(planning.cell_filter([a.dataset_id] if a.dataset_id else [], [], [a.language] if a.language else []))

    def earlier(out: str) -> DataFrame | None:
        """What an earlier run of the stage has written; the new table goes beside it and takes its place."""
        from pyspark.errors import AnalysisException

        try:
            return read(out) if a.resume else None
        except AnalysisException:
            return None

    def labels(rows: DataFrame) -> DataFrame:
        m = read(manifest).filter("split = 'train'").select("dataset_id", "language", F.array_sort(F.map_keys("labels")).alias("labels"))
        return rows.join(m, ["dataset_id", "language"], "left")

    def save(rows: DataFrame, out: str | None, stage: bool = False) -> None:
        if out is None:
            rows.show(1000, truncate=False)
        elif stage and a.resume:
            from siftline.operators.staging import written

            written(rows, "stage").write.mode("overwrite").parquet(out)  # not while it is read
        else:
            rows.write.mode("overwrite").parquet(out)

    if a.what == "run":
        from siftline.plans.catalogue import QUERIES

        save(QUERIES[a.query](spark, a.folder), a.out)
    elif a.what == "make-seeds":
        save(selection.sample_gold(asked(beside("records")), ["dataset_id", "language"], "task", "label", "id", a.budget, a.seed, a.sampling_strategy), a.out)
    elif a.what == "generate":
        n = a.candidates_per_seed or cfg.generation.candidates_per_seed
        save(generation.generated(read(a.seed_file), earlier(a.out), n, a.limit or None, work=generation.backend("generate", cfg.generation.backend, variants=n)), a.out, True)
    elif a.what == "counterfactuals":
        rows = labels(read(a.candidates))
        save(generation.counterfactuals(rows, F.col("labels"), earlier(a.out), generation.backend("counterfactual", cfg.generation.backend, labels=F.col("labels"))), a.out, True)
    elif a.what == "judge":
        save(generation.judged(read(a.candidates), earlier(a.out), generation.backend("judge", cfg.judge.backend)) if cfg.judge.backend not in ("disabled", "none", "") else read(a.candidates), a.out, True)
    elif a.what == "audit":
        c = plans.as_candidates(read(a.candidates)).withColumn("cell", F.lit("cell"))
        save(plans.audit(c, read(a.gold), asked(beside("benchmark")), cfg.audit, cell="cell"), a.out)
    elif a.what == "select":
        gold = read(a.gold)
        budget = a.budget or gold.count() * a.multiplier
        chosen = plans.select_candidates(read(a.audit), gold, a.baseline, budget, cfg.audit, cell="cell", max_per_source=a.max_per_source, seed=a.seed)
        save(read(a.audit).join(chosen.select("candidate_id", "rank"), "candidate_id"), a.out)
    elif a.what == "evaluate":
        gold = read(a.gold)
        cell = gold.select("dataset_id", "task", "language").distinct()
        synthetic = evaluation.training_records(read(a.selected).crossJoin(F.broadcast(cell.limit(1)))) if a.selected else None
        test = asked(beside("benchmark").filter("split = 'test'")).withColumn("id", F.col("item_id").cast("string"))
        save(evaluation.evaluate(gold, synthetic, test, embedder(a.embedder), a.embedder), a.out)
    elif a.what == "claim-ledger":
        sinks.write_ledger(sinks.scan_ledger(spark, a.runs_dir), a.out)
    else:
        cells = planning.expand(read(cfg.manifest_path), cfg)
        if a.what == "plan-summary":
            train = catalogue(read(cfg.manifest_path).filter("split = 'train'")).select("dataset_id", "language", "n")
            per = cells.join(train, ["dataset_id", "language"]).groupBy("dataset_id", "language", "slug", "multiplier", "selection_multiplier").agg(F.sum(F.least("n", "budget")).alias("gold"))
            save(per.agg(F.count(F.lit(1)).alias("cells"), F.sum("gold").alias("gold"), F.sum(F.col("gold") * F.col("multiplier")).alias("candidates"), F.sum(F.col("gold") * F.col("selection_multiplier")).alias("selected")), a.out)
        elif a.what == "plan-training":
            save(planning.training_commands(cells, cfg, a.run_name, a.trainer, a.classification_model, a.summarization_model, a.deterministic), a.out)
        else:
            plan = planning.commands(cells, cfg, a.run_name, a.config)
            save(planning.phase(plan, a.phase) if a.phase else plan, a.out)


if __name__ == "__main__":
    main()
