"""Generation, counterfactuals and judgements: heuristic forms, endpoints, and stages that resume."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.prompts import generation_prompt, prompt_limit
from siftline.functions.replies import canonical_json
from siftline.functions.text import bounded, stable_hash, stripped, was_compacted, word_count
from siftline.operators.staging import written

# Texts that the heuristic forms add, and their scores.
VARIANT, SUMMARY_TARGET = " [variant {i}]", "\n\nSynthetic summary target: "
CUE, FACT_CHANGED, TAGGED_CHANGED = "\nCounterfactual label cue: {label}.", "\n[COUNTERFACTUAL: salient fact changed]", " CF"
GENERATED_CONFIDENCE, ENDPOINT_CONFIDENCE = 0.62, 0.70
OTHER_LABEL, SAME_LABEL = 0.65, 0.40
JUDGE_MODEL, RATIONALE = "heuristic_judge", "Heuristic local smoke-test judgment; not a paper metric."
JUDGED = ["label_correctness", "fluency", "cultural_plausibility", "leakage_suspicion", "counterfactual_validity", "quality_score"]
SUMMARY, TAGGING = "summarization", "named_entity_recognition"
FAILED_POLICY = "retained_for_audit_with_zero_counterfactual_score"


def _has(df: DataFrame, name: str, kind: str = "string") -> Column:
    """A column of the table, or null where it has none of that name."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _none(x: Column) -> Column:
    return F.coalesce(x, F.lit("None"))


def generate(seeds: DataFrame, variants: int, labels: Column | None = None) -> DataFrame:
    """``variants`` candidates of every seed; confidence 0.62.

    Seeds have id, text and label, and may have task, language, summary and tokens; null texts count as empty. The
    first variant is the seed's text, later ones carry a mark; summaries carry their target and tagged
    texts are their tokens, in every variant. Ids are hashes of seed, variant, text and label; the prompt's hash is that of the
    task's prompt with ``labels`` (an array column) as the allowed ones.
    """
    i, task = F.col("variant"), _has(seeds, "task")
    base, tokens = F.coalesce("text", F.lit("")), _has(seeds, "tokens", "array<string>")
    rows = seeds.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(variants - 1)) if variants > 0 else F.array().cast("array<int>")))
    marked = F.concat(base, F.when(i == 0, "").otherwise(F.concat(F.lit(VARIANT.split("{i}")[0]), i.cast("string"), F.lit(VARIANT.split("{i}")[1]))))
    text = F.when(task == SUMMARY, F.concat(base, F.lit(SUMMARY_TARGET), F.coalesce(_has(seeds, "summary"), F.lit("")))).otherwise(marked)
    text = F.when((task == TAGGING) & (F.size(tokens) > 0), F.array_join(tokens, " ")).otherwise(stripped(text))
    prompt = generation_prompt(_none(task), _none(_has(seeds, "language")), F.col("label"), base, labels if labels is not None else F.array().cast("array<string>"), 1, _has(seeds, "summary"), tokens, _has(seeds, "tags", "array<string>"))
    rows = rows.withColumn("_text", text)
    key = F.concat_ws(":", "id", i.cast("string"), "_text", _none(F.col("label")))
    kept = [c for c in ("dataset_id", "task", "language") if c in seeds.columns]
    return rows.select(stable_hash(key).alias("candidate_id"), F.col("id").alias("seed_id"), *kept, "variant", F.col("_text").alias("text"), "label", F.lit(GENERATED_CONFIDENCE).alias("generator_confidence"), stable_hash(prompt).alias("prompt_hash"), stable_hash(base).alias("seed_text_hash"))


def counterfactual(df: DataFrame, labels: list[str] | Column) -> DataFrame:
    """Adds cf_label, the next label in order, cf_text by the task, cf_score (0.65 for another label, else 0.40) and cf_id.

    ``labels`` is a list or an array column, in order. Unknown and null labels, and the only one, get the first label; without labels the label stays.
    """
    known = F.array(*[F.lit(x) for x in labels]).cast("array<string>") if isinstance(labels, list) else F.coalesce(labels, F.array().cast("array<string>"))
    n = F.size(known)
    at = F.coalesce(F.array_position(known, F.col("label")), F.lit(0))
    out = df.withColumn("cf_label", F.when(n > 0, F.try_element_at(known, (at % F.greatest(n, F.lit(1)) + 1).cast("int"))).otherwise(F.col("label")))
    task, text = _has(df, "task"), F.coalesce("text", F.lit(""))
    cue = F.concat(text, F.lit(CUE.split("{label}")[0]), _none(F.col("cf_label")), F.lit(CUE.split("{label}")[1]))
    out = out.withColumn("cf_text", F.when(task == SUMMARY, F.concat(text, F.lit(FACT_CHANGED))).when(task == TAGGING, F.concat(text, F.lit(TAGGED_CHANGED))).otherwise(cue))
    out = out.withColumn("cf_score", F.when(F.col("cf_label").eqNullSafe(F.col("label")), SAME_LABEL).otherwise(OTHER_LABEL))
    return out.withColumn("cf_id", stable_hash(F.concat_ws(":", _none(_has(df, "candidate_id")), "cf_text", _none(F.col("cf_label")))))


def judge(df: DataFrame, text: str = "text", cf_text: str = "cf_text", cf_label: str = "cf_label", label: str = "label") -> DataFrame:
    """Adds the heuristic judgement: judge_id, the six scores of JUDGED and the rationale.

    Quality is 0.75 for 4 to 256 words, else 0.45, and 0.15 less for a variant mark in any case; leakage is suspected more of
    texts of at most 20 characters; a counterfactual holds if it has a text and another label.
    """
    body = F.coalesce(text, F.lit(""))
    quality = F.when(word_count(F.col(text)).between(4, 256), 0.75).otherwise(0.45) - F.when(F.contains(F.lower(body), F.lit("[variant")), 0.15).otherwise(0.0)
    valid = F.coalesce(F.col(cf_text) != "", F.lit(False)) & ~F.col(cf_label).eqNullSafe(F.col(label))
    out = df.withColumn("quality_score", quality).withColumns({
        "label_correctness": F.col("quality_score"),
        "fluency": F.least(F.lit(1.0), F.col("quality_score") + 0.10),
        "cultural_plausibility": F.lit(0.70),
        "leakage_suspicion": F.when(F.length(body) > 20, 0.15).otherwise(0.30),
        "counterfactual_validity": F.when(valid, 1.0).otherwise(0.35),
        "judge_model": F.lit(JUDGE_MODEL), "rationale": F.lit(RATIONALE),
    })
    # the id is the hash of the judgement as JSON with sorted keys
    number = lambda c: F.concat(F.lit(f'"{c}": '), F.col(c).cast("string"))
    word = lambda c: F.concat(F.lit(f'"{c}": "'), F.col(c), F.lit('"'))
    fields = [word(c) if c in ("judge_model", "rationale") else number(c) for c in sorted([*JUDGED, "judge_model", "rationale"])]
    return out.withColumn("judge_id", stable_hash(F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))))


def normalised_judgement(reply: Column, with_id: bool = True) -> Column:
    """A judgement from a judge's JSON: scores held in [0, 1], 0.5 for missing ones and what is no number, and the first 500 characters of the rationale.

    ``judge_id`` is the hash of the JSON with sorted keys, which only Python writes; leave it out where it isn't needed.
    """
    raw = lambda n: F.get_json_object(reply, f"$.{n}")
    scores = [bounded(raw(n).try_cast("double"), 0.5).alias(n) for n in JUDGED]
    parts = [F.coalesce(raw("judge_model"), F.lit("unknown")).alias("judge_model"), *scores, F.substring(F.coalesce(raw("rationale"), F.lit("")), 1, 500).alias("rationale")]
    return F.struct(*([stable_hash(canonical_json(reply)).alias("judge_id")] if with_id else []), *parts)


def candidates_of_items(items: DataFrame, model: str, seed: str = "seed_id", item: str = "item", index: str = "index", raw: str = "raw") -> DataFrame:
    """Candidates of generated items: one row per item (JSON) with its seed's id, task, language, label and text, its place and the raw reply.

    A missing label is the seed's, a missing text the item's "input", a missing confidence 0.70, held in [0, 1]; summaries
    are labelled "summary". The id is the hash of seed, place, text, label and reply.
    """
    get = lambda n: F.get_json_object(item, f"$.{n}")
    label = F.coalesce(get("label"), F.col("label"))
    text = F.coalesce(F.nullif(get("text"), F.lit("")), F.nullif(get("input"), F.lit("")), F.lit(""))
    rows = items.withColumns({"_text": text, "_label": label})
    key = F.concat_ws(":", seed, F.col(index).cast("string"), "_text", _none(F.col("_label")), raw)
    confidence = bounded(F.coalesce(get("confidence").try_cast("double"), F.lit(ENDPOINT_CONFIDENCE)))
    return rows.select(
        stable_hash(key).alias("candidate_id"), F.col(seed).alias("seed_id"), "task", "language", F.col("_text").alias("text"), F.when(F.col("task") == SUMMARY, "summary").otherwise(F.col("_label")).alias("label"),
        F.lit(model).alias("generator"), confidence.alias("generator_confidence"), get("summary").alias("summary"), was_compacted(F.col("seed_text"), prompt_limit(F.col("task"))).alias("seed_text_compacted"),
    )


def consistency(semantic: Column, judge_validity: Column, judged: Column, probability: Column) -> Column:
    """How well a counterfactual holds: the judge's validity before the edit score (0 where there is neither), weighed by the teacher.

    With a judge's validity or any judgement (``judged``) the teacher's probability of the expected label only moderates; without,
    it is a factor. A null probability is 0.5.
    """
    value, p = F.coalesce(judge_validity, semantic, F.lit(0.0)), F.coalesce(probability, F.lit(0.5))
    return F.when(judge_validity.isNotNull() | F.coalesce(judged, F.lit(False)), value * (0.75 + 0.25 * p)).otherwise(value * p)


def has_judgement(metadata: Column) -> Column:
    """Whether JSON metadata holds a judgement that isn't empty."""
    found = F.get_json_object(metadata, "$.llm_judge")
    return F.coalesce(~found.isin("", "{}", "[]", "null", "false", "0", "0.0"), F.lit(False))


def utility(quality: Column, confidence: Column, teacher: Column, vote: Column) -> Column:
    """Mean of quality, or the generator's confidence, of the teacher's confidence and of the neighbours' vote."""
    return (F.coalesce(quality, confidence, F.lit(0.5)) + F.coalesce(teacher, F.lit(0.5)) + F.coalesce(vote, F.lit(0.5))) / 3


def pending(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has nothing yet: what a resumed stage still has to do."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def first_generated(df: DataFrame, seed: str, text: str, label: str, order: str) -> DataFrame:
    """Of items of a seed with the same stripped text and label the first; blank texts are dropped."""
    rows = df.withColumn("_t", stripped(F.coalesce(text, F.lit("")))).filter(F.col("_t") != "")
    first = rows.groupBy(seed, "_t", label).agg(F.min(order).alias(order))
    return rows.join(first.withColumnRenamed(label, "_l"), [seed, "_t", order]).filter(F.col(label).eqNullSafe(F.col("_l"))).drop("_t", "_l")


def resumed(df: DataFrame, done: DataFrame | None, key: str, work: Callable[[DataFrame], DataFrame], done_key: str | None = None) -> DataFrame:
    """A stage that goes on where it stopped: what is there already, and ``work`` over the rows whose key has nothing yet.

    ``done_key`` names the key's column in ``done``; of an array column, such as a candidate's seeds, every element counts as done, so a seed with
    any candidate isn't filled up. Without ``done`` all rows are worked on.
    """
    if done is None:
        return work(df)
    name = done_key or key
    keys = done.select(F.explode(name).alias(key)) if done.schema[name].dataType.typeName() == "array" else done.select(F.col(name).alias(key))
    return done.unionByName(work(pending(df, keys.filter(F.col(key).isNotNull()), key)), allowMissingColumns=True)


def generated(seeds: DataFrame, done: DataFrame | None = None, variants: int = 1, limit: int | None = None, labels: Column | None = None, work: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The generation stage: the first ``limit`` seeds by id (all where it is None or 0), through ``work`` or the heuristic generator, resumed after ``done``."""
    seeds = seeds.orderBy("id").limit(limit) if limit else seeds
    return resumed(seeds, done, "id", work or (lambda d: generate(d, variants, labels)), "seed_id")


def counterfactuals(df: DataFrame, labels: list[str] | Column, done: DataFrame | None = None, work: Callable[[DataFrame], DataFrame] | None = None, most_failed: float = 0.10) -> DataFrame:
    """The counterfactual stage, resumed after ``done``; a builder's failures are kept, marked, with a score of 0.

    ``work`` gives candidates cf_text, cf_label, cf_score and ``cf_error``, null where it held. The result is one written table, so that
    nothing is built twice; RuntimeError after writing if more than the larger of 5 and ``most_failed`` of all rows failed.
    """
    build = work or (lambda d: counterfactual(d, labels).withColumn("cf_error", F.lit(None).cast("string")))

    def marked(d: DataFrame) -> DataFrame:
        out, failed = build(d), F.col("cf_error").isNotNull()
        return out.withColumns({
            "cf_text": F.when(failed, "").otherwise(F.col("cf_text")), "cf_label": F.when(failed, F.col("label")).otherwise(F.col("cf_label")), "cf_score": F.when(failed, 0.0).otherwise(F.col("cf_score")),
            "cf_error": F.substring("cf_error", 1, 500), "cf_policy": F.when(failed, FAILED_POLICY),
        })

    out = written(resumed(df, done, "candidate_id", marked), "counterfactuals")
    n = out.agg(F.count(F.lit(1)).alias("rows"), F.count("cf_error").alias("failed")).first()
    if n.failed > max(5, int(most_failed * max(n.rows, 1))):
        raise RuntimeError(f"{n.failed} of {n.rows} counterfactuals failed")
    return out


def judged(df: DataFrame, done: DataFrame | None = None, work: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The judge's stage, resumed after ``done``: the judgement, judge_score (its quality) and judge_validity of rows with a counterfactual.

    ``work`` adds the columns of ``judge``; without it the heuristic judge does.
    """

    def attached(d: DataFrame) -> DataFrame:
        out = (work or judge)(d)
        return out.withColumns({"judge_score": F.col("quality_score"), "judge_validity": F.when(F.col("cf_text").isNotNull(), F.col("counterfactual_validity"))})

    return resumed(df, done, "candidate_id", attached)


#: Builders of the three stages by the name of their backend; endpoints need the function that calls them.
ENDPOINTS = ("openai_compatible", "vllm", "sglang", "bedrock")
#: Replies of a server after which a request is tried again; others, and what is no reply at all, see ``may_retry``.
RETRIED = {408, 409, 429}


def backend(stage: str, name: str, call: Callable[[pd.DataFrame], pd.DataFrame] | None = None, schema: str | None = None, **options) -> Callable[[DataFrame], DataFrame] | None:
    """The work of a stage ("generate", "counterfactual", "judge"): heuristic, an endpoint through ``call``, or for a judge none at all.

    Unknown names, and endpoints without a call, raise ValueError.
    """
    if name == "heuristic":
        return {"generate": lambda d: generate(d, options.get("variants", 1), options.get("labels")), "counterfactual": lambda d: counterfactual(d, options["labels"]).withColumn("cf_error", F.lit(None).cast("string")), "judge": judge}[stage]
    if stage == "judge" and name in ("disabled", "none", ""):
        return lambda d: d
    if name not in ENDPOINTS:
        raise ValueError(f"unknown backend {name}")
    if call is None or schema is None:
        raise ValueError(f"backend {name} needs a call and its schema")
    return lambda d: call_endpoint(d, schema, call, options.get("retries", 3), options.get("wait", 1.0))


def may_retry(error: Exception) -> bool:
    """Whether a failed request is worth another try: no reply, or a reply of 408, 409, 429 or 500 and above.

    A reply's code is looked for on the error (``status``, ``code``) and on its ``response``.
    """
    for holder in (error, getattr(error, "response", None)):
        for name in ("status_code", "status", "code"):
            code = getattr(holder, name, None)
            if isinstance(code, int):
                return code in RETRIED or code >= 500
    return isinstance(error, (OSError, TimeoutError))


def call_endpoint(df: DataFrame, schema: str, call: Callable[[pd.DataFrame], pd.DataFrame], retries: int = 3, wait: float = 1.0) -> DataFrame:
    """Rows through a model endpoint, batch by batch and partition by partition.

    ``call`` raises to be tried again where ``may_retry`` says so. Waits double up to 30 s; the last failure ends the task, which Spark tries again elsewhere.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for batch in batches:
            for i in range(retries + 1):
                try:
                    yield call(batch)
                    break
                except Exception as e:
                    if i == retries or not may_retry(e):
                        raise
                    time.sleep(min(30.0, wait * 2**i))

    return df.mapInPandas(run, schema)
