"""Readers of records, candidates, raw corpora and run trees. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftline.functions.text import stripped
from siftline.operators.grouping import means_in_order

RECORD = "id string, dataset_id string, task string, language string, split string, text string, label string, tokens array<string>, tags array<string>, summary string, metadata map<string,string>"
CANDIDATE = "candidate_id string, dataset_id string, task string, language string, text string, label string, source_seed_ids array<string>, generator string, generator_confidence double, prompt_hash string, metadata string, counterfactual struct<text: string, label: string, semantic_edit_score: double, method: string, failed: boolean>"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are no rows."""
    return spark.read.schema(schema).json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def decode_records(df: DataFrame) -> DataFrame:
    """Defaults of records: an empty text; ids are strings."""
    return df.withColumns({"id": F.col("id").cast("string"), "text": F.coalesce("text", F.lit(""))})


def decode_candidates(df: DataFrame) -> DataFrame:
    """Defaults of candidates: empty text and prompt hash, no seeds, generator "unknown", confidence 0.5."""
    return df.withColumns({
        "candidate_id": F.col("candidate_id").cast("string"), "text": F.coalesce("text", F.lit("")), "source_seed_ids": F.coalesce("source_seed_ids", F.array().cast("array<string>")),
        "generator": F.coalesce("generator", F.lit("unknown")), "generator_confidence": F.coalesce("generator_confidence", F.lit(0.5)), "prompt_hash": F.coalesce("prompt_hash", F.lit("")),
    })


def _numbered(df: DataFrame) -> DataFrame:
    """Rows of one file with their place.

    Partitions of a file are in its order, and an id grows within each; the rows of a partition are counted first, and a row's place is its
    own in the partition after those before. Windows see one partition or one row per partition.
    """
    rows = df.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)).withColumn("_in", F.col("_id").bitwiseAND((1 << 33) - 1))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(F.broadcast(starts), "_part").withColumn("pos", F.col("_start") + F.col("_in")).drop("_id", "_part", "_in", "_start")


def _record_id(dataset: str, language: str, split: str) -> Column:
    return F.concat(F.lit(f"{dataset}:{language}:{split}:"), F.col("pos").cast("string"))


def _tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    options = {"sep": "\t", "quote": '"', "escape": '"', "multiLine": True, "header": True}
    return _numbered(spark.read.options(**options).schema(", ".join(f"{c} string" for c in columns)).csv(path))


def read_news(spark: SparkSession, path: str, dataset: str, language: str, split: str) -> DataFrame:
    """Headline, blank line and body as text; the category as label; the row's place in the id."""
    t = _tsv(spark, path, ["headline", "text", "category", "url"])
    text = stripped(F.concat(F.coalesce("headline", F.lit("None")), F.lit("\n\n"), F.coalesce("text", F.lit("None"))))
    return t.select(_record_id(dataset, language, split).alias("id"), text.alias("text"), F.col("category").alias("label"), "url")


def read_sentiment(spark: SparkSession, path: str, dataset: str, language: str, split: str) -> DataFrame:
    t = _tsv(spark, path, ["tweet", "label"])
    return t.select(_record_id(dataset, language, split).alias("id"), F.col("tweet").alias("text"), "label")


def read_conll(spark: SparkSession, path: str, dataset: str, language: str, split: str) -> DataFrame:
    """Sentences parted by blank lines; the first and last field of a line are token and tag, lines of one field are left out."""
    whole = spark.read.text(path, wholetext=True)
    s = whole.select(F.posexplode(F.filter(F.split("value", r"\r?\n[ \t]*\r?\n"), lambda x: F.trim(x) != "")).alias("pos", "s"))
    lines = F.filter(F.transform(F.split("s", r"\r?\n"), lambda x: F.split(F.trim(x), r"\s+")), lambda x: F.size(x) > 1)
    s = s.withColumn("w", lines).filter(F.size("w") > 0)
    return s.select(_record_id(dataset, language, split).alias("id"), F.transform("w", lambda x: x[0]).alias("tokens"), F.transform("w", lambda x: F.element_at(x, -1)).alias("tags"), F.lit("ner").alias("label")).withColumn("text", F.array_join("tokens", " "))


def read_intents(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Utterances of one partition with their intent and, as metadata, locale, scenario, annotated utterance and the methods of their slots."""
    s = "id string, partition string, utt string, intent string, locale string, scenario string, annot_utt string, slot_method array<struct<slot: string, method: string>>"
    rows = read_jsonl(spark, path, s).filter(F.col("partition") == split)
    slots = F.coalesce("slot_method", F.array().cast("array<struct<slot: string, method: string>>"))
    return rows.select("id", F.coalesce("utt", F.lit("")).alias("text"), F.col("intent").alias("label"), F.struct("locale", "scenario", "annot_utt", slots.alias("slot_method")).alias("metadata"))


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Articles with summary and title; a missing id becomes the line's place."""
    t = _numbered(read_jsonl(spark, path, "id string, url string, title string, summary string, text string"))
    return t.select(F.coalesce("id", F.col("pos").cast("string")).alias("id"), "text", "summary", "title", "url")


READERS = {"news_topic_classification": read_news, "sentiment_classification": read_sentiment, "ner": read_conll}


def read_records(spark: SparkSession, task: str, path: str, dataset: str, language: str, split: str) -> DataFrame:
    """Records of a raw file by its task; other tasks raise ValueError."""
    if task == "intent_classification":
        return read_intents(spark, path, split)
    if task == "summarization":
        return read_summaries(spark, path)
    if task not in READERS:
        raise ValueError(f"unsupported task {task}")
    return READERS[task](spark, path, dataset, language, split)


def catalogue(manifest: DataFrame) -> DataFrame:
    """One row per file and label of a manifest."""
    return manifest.select("dataset_id", "task", "language", "split", "path", "n_rows", F.explode_outer("labels").alias("label", "n"))


def catalogue_entry(manifest: DataFrame, dataset_id: str | None = None, task: str | None = None) -> DataFrame:
    """The files of the first dataset, by name, with the id and the task that are given; KeyError where there is none."""
    rows = manifest.filter((F.lit(True) if dataset_id is None else F.col("dataset_id") == dataset_id) & (F.lit(True) if task is None else F.col("task") == task))
    first = rows.agg(F.min(F.struct("dataset_id", "task")).alias("e")).first().e
    if first is None:
        raise KeyError(f"no dataset {dataset_id or ''} {task or ''}".strip())
    return rows.filter((F.col("dataset_id") == first.dataset_id) & (F.col("task") == first.task))


#: Names under which a result's main metric may be stored, the first that is there counts; validation knows two more.
METRICS = ["test_macro_f1", "eval_macro_f1", "macro_f1", "f1_macro"]
ENTITY_METRICS = ["test_entity_f1", "entity_f1"]


def metric(df_metrics: str = "metrics", entities: bool = False) -> Column:
    """The main metric of a map of metrics."""
    return F.coalesce(*[F.try_element_at(df_metrics, F.lit(n)) for n in METRICS + (ENTITY_METRICS if entities else [])])


def read_run_tree(spark: SparkSession, root: str, name: str = "test_metrics.json") -> DataFrame:
    """Metric files below ``root``/task/language/slug/hf/baseline with the parts of their paths as columns."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).format("binaryFile").load(root)
    parts = F.split("path", "/")
    at = lambda i: F.element_at(parts, i)
    m = F.from_json(F.col("content").cast("string"), "map<string,double>")
    rows = files.filter(F.size(parts) > 6).select(at(-6).alias("task"), at(-5).alias("language"), at(-4).alias("slug"), at(-2).alias("baseline"), m.alias("metrics"))
    return rows.withColumn("macro_f1", metric())


SELECTED = "candidate_id string, label string, text string, hard_reject boolean, scores struct<U: double, L: double, H: double, D: double, C: double, S: double>, metadata struct<llm_judge: struct<label_correctness: double, quality_score: double>>"


def read_selections(spark: SparkSession, root: str) -> DataFrame:
    """Selected rows of files below ``root``/task/language/slug/selected/baseline.jsonl, with the parts of their paths as columns."""
    rows = spark.read.schema(SELECTED).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").json(root).withColumn("_p", F.split(F.input_file_name(), "/"))
    at = lambda i: F.element_at("_p", i)
    rows = rows.filter((F.size("_p") > 5) & (at(-2) == "selected"))
    return rows.select(at(-5).alias("task"), at(-4).alias("language"), at(-3).alias("slug"), F.regexp_replace(at(-1), r"\.jsonl$", "").alias("baseline"), "candidate_id", "label", "hard_reject", F.col("scores.C").alias("c"), F.col("scores.L").alias("l"), F.col("scores.H").alias("h"), F.col("metadata.llm_judge.label_correctness").alias("judge_label_correctness"), F.col("metadata.llm_judge.quality_score").alias("judge_quality_score"))


def selection_quality(rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """``keys, selected`` and the means of judgements, scores and rejects; what is missing or NaN counts as 0.

    With ``order``, a column without ties in a selection, means are summed in it and don't depend on partitions.
    """
    zero = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    values = {c: zero(c) for c in ("judge_label_correctness", "judge_quality_score", "c", "l", "h")} | {"hard_reject_rate": zero("hard_reject")}
    if order is None:
        return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("selected"), *[F.avg(v).alias(n) for n, v in values.items()])
    return means_in_order(rows, keys, order, values).withColumnRenamed("rows", "selected")


def labelled(rows: DataFrame, gold: DataFrame, label: str = "label", text: str = "text") -> DataFrame:
    """Rows whose label is one of gold's and whose text isn't blank; gold's labels are as few as classes."""
    known = gold.select(label).na.drop().distinct()
    return rows.filter(stripped(F.coalesce(text, F.lit(""))) != "").join(known, label, "left_semi")


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a result file; none where there is no such file."""
    from pyspark.errors import AnalysisException

    try:
        return read_json(spark, path, schema)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_artifact(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a packaged run tree: ``task, language, slug, kind, baseline, line``.

    Kinds: "audit" and "gold" of a cell, "selected" and "metrics" of its baselines; members of fewer than five parts are left out.
    Metric files are one line.
    """
    m = read_archives(spark, path, "").withColumn("_p", F.split("name", "/"))
    at = lambda i: F.element_at("_p", i)
    m = m.filter(F.size("_p") >= 5)
    file, n = at(-1), F.size("_p")
    kind = F.when(file == "audit.jsonl", "audit").when(file == "gold.jsonl", "gold").when((n >= 6) & (at(-2) == "selected") & file.endswith(".jsonl"), "selected").when((n >= 7) & (F.try_element_at("_p", F.lit(-3)) == "hf") & (file == "test_metrics.json"), "metrics")
    base = F.when(kind == "selected", F.regexp_replace(file, r"\.jsonl$", "")).when(kind == "metrics", at(-2))
    rows = m.select(at(2).alias("task"), at(3).alias("language"), at(4).alias("slug"), kind.alias("kind"), base.alias("baseline"), F.explode(F.when(kind == "metrics", F.array("content")).otherwise(F.split("content", r"\r?\n"))).alias("line"))
    return rows.filter(F.col("kind").isNotNull() & (F.trim("line") != ""))


def read_archives(spark: SparkSession, path: str, member: str) -> DataFrame:
    """Members of tar.gz artifacts whose names end in ``member``: ``archive, name, content``; unpacked by the tasks that read them."""
    import pandas as pd

    def unpack(batches):
        import io
        import tarfile

        for batch in batches:
            rows = []
            for p, c in zip(batch["path"], batch["content"]):
                with tarfile.open(fileobj=io.BytesIO(c), mode="r:*") as t:
                    for m in t:
                        if m.isfile() and m.name.endswith(member) and ".." not in m.name.split("/"):
                            rows.append((p, m.name, t.extractfile(m).read().decode("utf-8", "replace")))
            yield pd.DataFrame(rows, columns=["archive", "name", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, "archive string, name string, content string")
