"""The tables in the form that the operators and their SQL take, and the register of queries.

Each view has its text in SQL beside it, so that query and oracle start from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query of (spark, folder) with the SQL that it must equal."""

    def keep(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per candidate, the latest; its first seed as ``source``."""
    c = table(spark, sf_dir, "candidates").filter(F.col("candidate_id").isNotNull())
    latest = F.max_by(F.struct("run_id", "dataset_id", "task", "language", "text", "label", F.get("source_seed_ids", F.lit(0)).alias("source"), F.col("source_seed_ids").alias("seeds"), "prompt_hash", "generator", "generator_confidence", "metadata", "counterfactual"), F.struct("received_at", "generator_confidence"))
    return c.groupBy("candidate_id").agg(latest.alias("r")).select("candidate_id", "r.*")


CANDIDATES = """cand AS (
  SELECT candidate_id, run_id, dataset_id, task, language, text, label, source_seed_ids[1] AS source, source_seed_ids AS seeds, prompt_hash, generator, generator_confidence, metadata, counterfactual
  FROM candidates WHERE candidate_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY received_at DESC, generator_confidence DESC NULLS LAST) = 1)"""


def _with_audit(spark: SparkSession, sf_dir: str, value) -> DataFrame:
    a = table(spark, sf_dir, "audit").filter(F.col("candidate_id").isNotNull())
    a = a.groupBy("candidate_id").agg(F.max_by(F.struct("scores", "hard_reject"), F.struct("audited_at", "ingested_at")).alias("a"))
    c = candidates(spark, sf_dir).select("candidate_id", "run_id", "label", "source", "seeds", "text", "metadata", "generator_confidence")
    return c.join(a, "candidate_id").select(*c.columns, *[value(x).alias(x) for x in "ulhdcs"], F.coalesce("a.hard_reject", F.lit(False)).alias("hard_reject"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with their latest audit: run_id, candidate_id, label, source, u, l, h, d, c, s; NaN and missing scores are 0, for statistics."""
    return _with_audit(spark, sf_dir, lambda x: F.coalesce(F.nanvl(F.col(f"a.scores.{x}"), F.lit(0.0)), F.lit(0.0)))


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with scores as they stand, null and NaN among them: what gates, ranks and selections read."""
    return _with_audit(spark, sf_dir, lambda x: F.col(f"a.scores.{x}"))


def _audit_sql(name: str, value: str) -> str:
    return (
        f""", latest AS (
  SELECT candidate_id, scores, hard_reject FROM audit WHERE candidate_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY audited_at DESC, ingested_at DESC) = 1),
{name} AS (
  SELECT c.candidate_id, c.run_id, c.label, c.source, c.seeds, c.text, c.metadata, c.generator_confidence,
"""
        + ",\n".join(f"    ({value.format(x=f'a.scores.{x}')})::DOUBLE AS {x}" for x in "ulhdcs")
        + """, coalesce(a.hard_reject, FALSE) AS hard_reject
  FROM cand c JOIN latest a USING (candidate_id))"""
    )


SCORED = CANDIDATES + _audit_sql("scored", "coalesce(CASE WHEN isnan({x}) THEN 0 ELSE {x} END, 0)")
AUDITED = CANDIDATES + _audit_sql("scored", "{x}")


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "gold").filter(F.col("id").isNotNull())


CELL = ["dataset_id", "language"]


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record, the one loaded last."""
    r = table(spark, sf_dir, "records").filter(F.col("id").isNotNull())
    names = ["dataset_id", "task", "language", "split", "text", "label", "summary", "url"]
    return r.groupBy("id").agg(F.max_by(F.struct(*names), F.struct("loaded_at", "created_at")).alias("r")).select("id", "r.*")


RECORDS = "rec AS (SELECT id, dataset_id, task, language, split, text, label, summary, url FROM records WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, created_at DESC) = 1)"
#: Outer blanks of any kind, in SQL.
_BLANK = r"[\s\p{Z}\x1c-\x1f\x{85}]+"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_BLANK}|{_BLANK}$', '', 'g')"


def words_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{_BLANK}'), lambda w: w <> '')"


def compact_sql(x: str, most: int) -> str:
    """A compacted text: of a longer one the head, 65 % of the room beside the marker, the marker and the tail."""
    marker = "\n[... excerpt truncated ...]\n"
    room = most - len(marker)
    head = int(room * 0.65)
    s = strip_sql(f"coalesce({x}, '')")
    quoted = "chr(10) || '[... excerpt truncated ...]' || chr(10)"
    return f"(CASE WHEN length({s}) <= {most} THEN {s} ELSE regexp_replace(substr({s}, 1, {head}), '{_BLANK}$', '') || {quoted} || regexp_replace(right({s}, {room - head}), '^{_BLANK}', '') END)"
