"""Writers: JSON lines, ledgers, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """One object a line; null fields are left out, other signs than ASCII stay as they are."""
    df.write.mode("append" if append else "overwrite").json(path)


def ledger(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """``claim_id, metric, value``: one row per key and metric; booleans count as numbers, nulls are left out."""
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")
    rows = df.select(F.concat_ws(":", *[F.col(k).cast("string") for k in keys]).alias("_k"), cells).filter(F.col("m.value").isNotNull())
    return rows.select(F.concat("_k", F.lit(":"), "m.metric").alias("claim_id"), "m.metric", "m.value")


def scan_ledger(spark: SparkSession, root: str) -> DataFrame:
    """``claim_id, metric, value, result_file`` of the JSON files below ``root`` that lie in a folder named results or are test_metrics.json.

    Metrics are the numbers of the object under "metrics", or of the whole; booleans count as numbers, other values and unreadable files are left out.
    """
    f = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").format("binaryFile").load(root)
    parts = F.split("path", "/")
    kept = f.filter(F.array_contains(F.slice(parts, F.lit(1), F.size(parts) - 1), "results") | (F.element_at(parts, -1) == "test_metrics.json"))
    whole = F.col("content").cast("string")
    flat = F.coalesce(F.from_json(F.get_json_object(whole, "$.metrics"), "map<string,string>"), F.from_json(whole, "map<string,string>"))
    rows = kept.select("path", F.element_at(parts, -2).alias("_in"), F.explode(flat).alias("metric", "_v"))
    number = F.when(F.col("_v") == "true", 1.0).when(F.col("_v") == "false", 0.0).otherwise(F.col("_v").try_cast("double"))
    return rows.select(F.concat_ws(":", "_in", "metric").alias("claim_id"), "metric", number.alias("value"), F.col("path").alias("result_file")).filter(F.col("value").isNotNull())


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A report's rows as one folder of CSV with a header, or of JSON lines."""
    if kind == "csv":
        write_ledger(df, path)
    else:
        write_jsonl(df, path)


def sparse_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of both tables with the columns of both as text; what a row lacks is empty."""
    both = a.unionByName(b, allowMissingColumns=True)
    return both.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in both.columns])


# What a bundle takes, and what it never does.
BUNDLED = (".json", ".jsonl", ".csv", ".md", ".txt", ".yaml", ".log", ".parquet")
UNBUNDLED = (".safetensors", ".bin", ".pt", ".ckpt")


def bundle_manifest(spark: SparkSession, root: str, most_bytes: int = 50_000_000, suffixes: tuple[str, ...] = BUNDLED) -> DataFrame:
    """``path, bytes, sha256`` of the files below ``root`` that go into a bundle: of the given kinds, of at most ``most_bytes``, in no checkpoint folder.

    Sizes and names are read first; only files that go in are read whole.
    """
    f = spark.read.option("recursiveFileLookup", True).format("binaryFile").load(root)
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    named = lambda ends: F.exists(F.array(*[F.lit(e) for e in ends]), lambda e: F.endswith(name, e))
    kept = f.filter((F.col("length") <= most_bytes) & named(suffixes) & ~named(UNBUNDLED) & ~F.col("path").rlike(r"/checkpoint-[^/]*/"))
    return kept.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


#: The tables of a run from which a replay starts.
RUN_INPUTS = ("gold", "candidates", "candidates_cf", "candidates_judged", "audit")


def clone_inputs(spark: SparkSession, source: str, target: str, overwrite: bool = False) -> list[str]:
    """Copies the input tables of a run's folder to another; those that are there already stay unless ``overwrite``. Returns the copied ones."""
    from pyspark.errors import AnalysisException

    done = []
    for name in RUN_INPUTS:
        try:
            rows = spark.read.parquet(f"{source}/{name}")
        except AnalysisException:
            continue
        try:
            spark.read.parquet(f"{target}/{name}")
            there = True
        except AnalysisException:
            there = False
        if overwrite or not there:
            rows.write.mode("overwrite").parquet(f"{target}/{name}")
            done.append(name)
    return done


def write_ledger(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def digests(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path, sha, bytes`` of files: the first 16 hex digits of each content's SHA-256."""
    f = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).format("binaryFile").load(path)
    return f.select("path", F.substring(F.sha2("content", 256), 1, 16).alias("sha"), F.col("length").alias("bytes"))


def check_digests(present: DataFrame, listed: DataFrame) -> DataFrame:
    """Listed files that are missing or stale, as ``path, state``."""
    j = listed.select("path", F.col("sha").alias("_want")).join(present.select("path", "sha"), "path", "left")
    state = F.when(F.col("sha").isNull(), "missing").when(F.col("sha") != F.col("_want"), "stale")
    return j.select("path", state.alias("state")).filter(F.col("state").isNotNull())
