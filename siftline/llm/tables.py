"""The tables of the training-data problems, in the form in which the operators take them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Outer blanks of every kind, byte order marks and zero-width characters.
BLANK = r"[\s\p{Z}\p{Cc}\p{Cf}]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest_audit(audit: DataFrame, *scores: str) -> DataFrame:
    """One row per candidate: ``candidate_id`` and the named scores of its latest audit.

    Equal ``audited_at`` are decided by ``ingested_at``, then by the scores themselves, so
    exact repeats change nothing. Rows without a candidate are left out.
    """
    latest = F.max_by(F.struct(*[F.col(f"scores.{s}").alias(s) for s in scores]), F.struct("audited_at", "ingested_at", "scores"))
    return (
        audit.filter(F.col("candidate_id").isNotNull())
        .groupBy("candidate_id")
        .agg(latest.alias("_s"))
        .select("candidate_id", *[F.col(f"_s.{s}").cast("double").alias(s) for s in scores])
    )


def seed_key(seed: Column) -> Column:
    """The part of a seed id that every spelling keeps: lower-case words and numbers without padding."""
    parts = F.filter(F.split(F.lower(seed), r"[^\p{L}\p{N}]+"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")), ":")


def label_key(label: Column) -> Column:
    """A label without case, outer blanks and outer marks."""
    edge = r"[\s\p{Z}\p{Cc}\p{Cf}\p{P}]+"
    return F.lower(F.regexp_replace(label, f"^{edge}|{edge}$", ""))
