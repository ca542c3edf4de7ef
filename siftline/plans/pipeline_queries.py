"""Queries of scalar functions, sources, generation, planning and ledger operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftline.functions import prompts as pr
from siftline.functions import text as tx
from siftline.functions.embedding import embedder
from siftline.functions.replies import reply_objects
from siftline.operators import generation as gen
from siftline.operators.grouping import rank_in_groups
from siftline.plans.metric_queries import _NEAR, _RES, _T, _proba, _results, knn_vote
from siftline.plans.views import CANDIDATES, RECORDS, candidates, compact_sql, gold, query, records, strip_sql, table, words_sql
from siftline.sources import readers as rd
from siftline.sources.sinks import ledger


@query("SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 16) AS hash FROM documents")
def stable_hash_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.stable_hash(F.coalesce("text", F.lit(""))).alias("hash"))


@query(f"SELECT doc_id, md5({compact_sql('text', 600)}) AS md5, length({strip_sql('text')}) > 600 AS compacted FROM documents WHERE text IS NOT NULL")
def text_compaction(spark, d):
    t = table(spark, d, "documents").filter(F.col("text").isNotNull())
    return t.select("doc_id", F.md5(tx.compact_text(F.col("text"), 600).cast("binary")).alias("md5"), tx.was_compacted(F.col("text"), 600).alias("compacted"))


@query(f"WITH {CANDIDATES} SELECT candidate_id, row_number() OVER (PARTITION BY run_id ORDER BY coalesce(source, ''), candidate_id) AS pos FROM cand")
def canonical_sort(spark, d):
    """The order in which stages write: by first seed, then by id. A seed's rows are ranked, and start after those of the seeds before it."""
    rows = candidates(spark, d).select("run_id", "candidate_id", F.coalesce("source", F.lit("")).alias("_s"), F.lit(0.0).alias("_q"))
    ranked = rank_in_groups(rows, ["run_id", "_s"], "_q", "candidate_id")
    n = ranked.groupBy("run_id", "_s").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("run_id").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)  # one row per seed
    starts = n.select("run_id", "_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return ranked.join(starts, ["run_id", "_s"]).select("candidate_id", (F.col("_start") + F.col("rank")).cast("bigint").alias("pos"))


_ORDER = f"""WITH {RECORDS}, k AS (SELECT id, dataset_id, language, sha256(concat_ws(chr(9), coalesce(dataset_id, ''), coalesce(task, ''), coalesce(language, ''), coalesce(split, ''), id, coalesce(label, 'None'), coalesce(text, ''), '[]', '[]', coalesce(summary, ''))) AS key FROM rec)
SELECT id, key, row_number() OVER (PARTITION BY dataset_id, language ORDER BY md5('13|' || key), id) AS place FROM k"""


@query(_ORDER)
def training_order(spark, d):
    """The key of ten fields by which training records get a stable order, and each cell's seeded shuffle of it."""
    text = lambda c, none="": F.coalesce(F.col(c), F.lit(none))
    parts = [*map(text, ("dataset_id", "task", "language", "split")), F.col("id"), text("label", "None"), text("text"), F.lit("[]"), F.lit("[]"), text("summary")]
    keyed = records(spark, d).select("id", "dataset_id", "language", F.sha2(F.concat_ws("\t", *parts).cast("binary"), 256).alias("key"))
    keyed = keyed.select("*", F.concat(F.md5(F.concat(F.lit("13|"), "key").cast("binary")), "id").alias("_o"), F.lit(0.0).alias("_q"))
    return rank_in_groups(keyed, ["dataset_id", "language"], "_q", "_o").select("id", "key", F.col("rank").cast("bigint").alias("place"))


@query(f"SELECT prompt_hash, candidate_id, t AS text, label FROM (SELECT DISTINCT prompt_hash, candidate_id, {strip_sql('text')} AS t, label FROM candidates WHERE text IS NOT NULL AND prompt_hash IS NOT NULL) WHERE t <> '' QUALIFY candidate_id = min(candidate_id) OVER (PARTITION BY prompt_hash, t, label)")
def dedup_generated(spark, d):
    """Of a prompt's items with the same stripped text and label, the first."""
    c = table(spark, d, "candidates").select("prompt_hash", "candidate_id", "text", "label").distinct()
    return gen.first_generated(c.filter(F.col("prompt_hash").isNotNull()), "prompt_hash", "text", "label", "candidate_id").withColumn("text", tx.stripped(F.col("text")))


@query("SELECT id FROM gold WHERE id IS NOT NULL AND id NOT IN (SELECT unnest(source_seed_ids) FROM candidates WHERE source_seed_ids IS NOT NULL EXCEPT SELECT NULL)")
def resume_pending(spark, d):
    """Seeds without a candidate yet."""
    done = table(spark, d, "candidates").select(F.explode("source_seed_ids").alias("id")).filter(F.col("id").isNotNull())
    return gen.pending(gold(spark, d).select("id"), done, "id")


@query(f"WITH {CANDIDATES} SELECT id AS id, 'gold' AS origin, label FROM gold WHERE id IS NOT NULL UNION ALL SELECT candidate_id, 'synthetic', label FROM cand")
def union_train_pool(spark, d):
    g = gold(spark, d).select("id", F.lit("gold").alias("origin"), "label")
    return g.unionByName(candidates(spark, d).select(F.col("candidate_id").alias("id"), F.lit("synthetic").alias("origin"), "label"))


_LABELS = "labs AS (SELECT dataset_id, language, list_sort(map_keys(labels)) AS ls FROM manifest WHERE split = 'train')"
_GEN = f"""{_LABELS}, v AS (SELECT g.id, g.dataset_id, g.task, g.language, g.label, coalesce(g.text, '') AS seed_text, coalesce(l.ls, []) AS ls, i AS variant, {strip_sql("coalesce(g.text, '') || CASE WHEN i = 0 THEN '' ELSE ' [variant ' || i || ']' END")} AS text
  FROM gold g LEFT JOIN labs l USING (dataset_id, language), (SELECT unnest(range(0, 3)) AS i) WHERE g.id IS NOT NULL),
g AS (SELECT substr(sha256(concat_ws(':', id, variant::VARCHAR, text, coalesce(label, 'None'))), 1, 16) AS candidate_id, * FROM v)"""


def _seeds(spark, d):
    """Gold with the labels of its cell, from the manifest."""
    labels = table(spark, d, "manifest").filter("split = 'train'").select("dataset_id", "language", F.array_sort(F.map_keys("labels")).alias("labels"))
    return gold(spark, d).join(labels, ["dataset_id", "language"], "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))


def _generated(spark, d):
    g = gen.generate(_seeds(spark, d), 3, F.col("labels"))
    labels = _seeds(spark, d).select("dataset_id", "language", "labels").distinct()  # one row per cell
    return g.join(labels, ["dataset_id", "language"], "left")


_ALLOWED = "CASE WHEN len(ls) > 0 THEN array_to_string(ls, ', ') ELSE 'task-specific output' END"


def _quoted(x: str) -> str:
    """A text with line ends as an SQL string."""
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in x.split("\n"))


def _filled(template: str, **values: str) -> str:
    """A prompt's template in SQL with expressions in its places."""
    import re

    parts = re.split(r"\{(" + "|".join(values) + r")\}", template)
    return " || ".join(_quoted(x) if i % 2 == 0 else f"coalesce(({values[x]})::VARCHAR, 'None')" for i, x in enumerate(parts))


_LENGTH = f"CASE WHEN task = 'news_topic_classification' THEN {_quoted(pr.NEWS_LENGTH)} ELSE {_quoted(pr.SHORT_LENGTH)} END"
_BODY = f"CASE WHEN task = 'news_topic_classification' THEN {compact_sql('seed_text', 2200)} ELSE {compact_sql('seed_text', 1200)} END"
_PROMPT = _filled(pr.CLASSIFY, task="task", language="language", labels=_ALLOWED, label="label", text=_BODY, n="1", length=_LENGTH)


@query(f"WITH {_GEN} SELECT candidate_id, id AS seed_id, variant, label, md5(text) AS text_md5, 0.62::DOUBLE AS generator_confidence, substr(sha256({_PROMPT}), 1, 16) AS prompt_hash, substr(sha256(seed_text), 1, 16) AS seed_text_hash FROM g")
def heuristic_generate(spark, d):
    g = _generated(spark, d)
    return g.select("candidate_id", "seed_id", F.col("variant").cast("bigint").alias("variant"), "label", F.md5(F.col("text").cast("binary")).alias("text_md5"), "generator_confidence", "prompt_hash", "seed_text_hash")


@query(f"WITH {_GEN} SELECT id, length({_PROMPT}) AS length, md5({_PROMPT}) AS md5 FROM g WHERE variant = 0")
def generation_prompts(spark, d):
    """The prompt of every gold record, by its task and the labels of its cell."""
    s = _seeds(spark, d)
    p = s.select("id", pr.generation_prompt(F.col("task"), F.col("language"), F.col("label"), F.col("text"), F.col("labels")).alias("p"))
    return p.select("id", F.length("p").cast("bigint").alias("length"), F.md5(F.col("p").cast("binary")).alias("md5"))


_ASKED = _filled(pr.JUDGE_USER, task="task", language="language", label="label", text=compact_sql("text", 2200), cf_label="counterfactual.label", cf_text=compact_sql("counterfactual.text", 1400))


@query(f"WITH {CANDIDATES} SELECT candidate_id, md5({_ASKED}) AS md5 FROM cand")
def judge_prompts(spark, d):
    """What a judge is asked of every candidate."""
    p = pr.judge_prompt(F.col("task"), F.col("language"), F.col("label"), F.col("text"), F.col("counterfactual.label"), F.col("counterfactual.text"))
    return candidates(spark, d).select("candidate_id", F.md5(p.cast("binary")).alias("md5"))


_CF = f"""WITH {_GEN}, c0 AS (SELECT g.*, CASE WHEN len(ls) > 0 THEN ls[coalesce(list_position(ls, label), 0) % len(ls) + 1] ELSE label END AS cf_label FROM g),
c AS (SELECT *, text || chr(10) || 'Counterfactual label cue: ' || coalesce(cf_label, 'None') || '.' AS cf_text FROM c0)"""


@query(_CF + " SELECT candidate_id, cf_label, md5(cf_text) AS cf_md5, CASE WHEN cf_label IS NOT DISTINCT FROM label THEN 0.4::DOUBLE ELSE 0.65::DOUBLE END AS cf_score, substr(sha256(candidate_id || ':' || cf_text || ':' || coalesce(cf_label, 'None')), 1, 16) AS cf_id FROM c")
def heuristic_counterfactual(spark, d):
    c = gen.counterfactual(_generated(spark, d), F.col("labels"))
    return c.select("candidate_id", "cf_label", F.md5(F.col("cf_text").cast("binary")).alias("cf_md5"), "cf_score", "cf_id")


_JUDGE = f""", j AS (SELECT *, len({words_sql('text')}) AS words, contains(lower(text), '[variant') AS marked FROM c),
q AS (SELECT *, CASE WHEN words BETWEEN 4 AND 256 THEN 0.75::DOUBLE ELSE 0.45::DOUBLE END - CASE WHEN marked THEN 0.15::DOUBLE ELSE 0 END AS quality_score, CASE WHEN cf_text <> '' AND cf_label IS DISTINCT FROM label THEN 1.0::DOUBLE ELSE 0.35::DOUBLE END AS counterfactual_validity, CASE WHEN length(text) > 20 THEN 0.15::DOUBLE ELSE 0.3::DOUBLE END AS leakage_suspicion, 0.7::DOUBLE AS cultural_plausibility FROM j),
f AS (SELECT *, quality_score AS label_correctness, least(1, quality_score + 0.1::DOUBLE) AS fluency FROM q)"""
_JUDGE_ID = """substr(sha256('{"counterfactual_validity": ' || counterfactual_validity || ', "cultural_plausibility": ' || cultural_plausibility || ', "fluency": ' || fluency || ', "judge_model": "heuristic_judge", "label_correctness": ' || label_correctness || ', "leakage_suspicion": ' || leakage_suspicion || ', "quality_score": ' || quality_score || ', "rationale": "Heuristic local smoke-test judgment; not a paper metric."}'), 1, 16)"""


@query(_CF + _JUDGE + f" SELECT candidate_id, {_JUDGE_ID} AS judge_id, round(quality_score, 6) AS quality_score, round(label_correctness, 6) AS label_correctness, counterfactual_validity, leakage_suspicion, round(fluency, 6) AS fluency, cultural_plausibility FROM f")
def heuristic_judge(spark, d):
    j = gen.judge(gen.counterfactual(_generated(spark, d), F.col("labels")))
    return j.select("candidate_id", "judge_id", F.round("quality_score", 6).alias("quality_score"), F.round("label_correctness", 6).alias("label_correctness"), "counterfactual_validity", "leakage_suspicion", F.round("fluency", 6).alias("fluency"), "cultural_plausibility")


_RAW = "json_extract_string(CASE WHEN json_valid(metadata) THEN metadata END, '$.llm_judge')"
_HAS = f"coalesce({_RAW} NOT IN ('', '{{}}', '[]', 'null', 'false', '0', '0.0'), FALSE)"


@query(f"WITH {CANDIDATES}, x AS (SELECT candidate_id, {_HAS} AS judged, coalesce(counterfactual.semantic_edit_score, 0) AS sem, CASE WHEN counterfactual.label IS NULL THEN 0.5::DOUBLE ELSE coalesce(generator_confidence, 0.5) END AS p FROM cand) SELECT candidate_id, judged, round(CASE WHEN judged THEN sem * (0.75::DOUBLE + 0.25::DOUBLE * p) ELSE sem * p END + 1e-10, 6) AS c FROM x")
def consistency_score(spark, d):
    """Consistency of the stored counterfactuals; the generator's confidence stands for the teacher's probability (``audit_scores`` has the teacher's own)."""
    judged = gen.has_judgement(F.col("metadata"))
    p = F.when(F.col("counterfactual.label").isNull(), 0.5).otherwise(F.col("generator_confidence"))
    c = gen.consistency(F.col("counterfactual.semantic_edit_score"), F.lit(None).cast("double"), judged, p)
    return candidates(spark, d).select("candidate_id", judged.alias("judged"), F.round(c + 1e-10, 6).alias("c"))


@query(f"WITH {_NEAR}, vote AS (SELECT query AS vec_id, avg((ql = rl)::INT) AS vote FROM top GROUP BY ALL), {_T.replace('e AS (', 'e2 AS (', 1).replace('FROM e ', 'FROM e2 ').replace('e.vec_id', 'e2.vec_id').replace('e.label', 'e2.label').replace('e.v,', 'e2.v,')} SELECT vec_id, round(((vec_id * 37 % 100) / 100::DOUBLE + p + vote) / 3, 6) AS u FROM vote JOIN pr USING (vec_id) WHERE class = truth")
def utility_score(spark, d):
    """Utility of the query vectors, with a quality made from their ids."""
    e, p = _proba(spark, d)
    own = p.join(e.select("vec_id", F.col("label").alias("class")), ["vec_id", "class"]).join(knn_vote(spark, d), "vec_id")
    quality = (F.col("vec_id") * 37 % 100) / 100
    return own.select("vec_id", F.round(gen.utility(quality, F.lit(None).cast("double"), F.col("p"), F.col("vote")), 6).alias("u"))


@query("SELECT run_id, try_cast(nullif(regexp_extract(slug, '(?:^|_)b([0-9]+)', 1), '') AS BIGINT) AS budget, try_cast(nullif(regexp_extract(slug, '(?:^|_)m([0-9]+)', 1), '') AS BIGINT) AS multiplier, try_cast(nullif(regexp_extract(slug, '(?:^|_)s([0-9]+)', 1), '') AS BIGINT) AS seed FROM runs")
def slug_parts(spark, d):
    return table(spark, d, "runs").select("run_id", *[tx.slug_part(F.col("slug"), c).alias(n) for c, n in (("b", "budget"), ("m", "multiplier"), ("s", "seed"))])


@query("SELECT dataset_id, language, split, label, count(*) AS n FROM (SELECT dataset_id, language, split, label FROM gold UNION ALL SELECT dataset_id, language, split, label FROM benchmark) GROUP BY ALL")
def manifest_histogram(spark, d):
    """Label counts of every file, as a manifest holds them."""
    cols = ["dataset_id", "language", "split", "label"]
    return table(spark, d, "gold").select(*cols).unionByName(table(spark, d, "benchmark").select(*cols)).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT dataset_id, language, split, label, n FROM (SELECT dataset_id, language, split, unnest(map_keys(labels)) AS label, unnest(map_values(labels)) AS n FROM manifest)")
def manifest_catalogue(spark, d):
    return rd.catalogue(table(spark, d, "manifest")).select("dataset_id", "language", "split", "label", "n")


@query("SELECT dataset_id, language, array_to_string(list_sort(map_keys(labels)), ',') AS labels FROM manifest WHERE split = 'train'")
def label_domain(spark, d):
    return table(spark, d, "manifest").filter("split = 'train'").select("dataset_id", "language", F.array_join(F.array_sort(F.map_keys("labels")), ",").alias("labels"))


@query("SELECT m.dataset_id, m.task, m.language, b.budget, k.multiplier, s.seed, 'b' || b.budget || '_m' || k.multiplier || '_s' || s.seed AS slug FROM (SELECT DISTINCT dataset_id, task, language FROM manifest) m, (SELECT unnest([32, 64, 128]) AS budget) b, (SELECT unnest([2, 3]) AS multiplier) k, (SELECT unnest([13, 21, 42]) AS seed) s WHERE m.language IN ('hau', 'swa')")
def grid_expand(spark, d):
    """Every cell of a grid of budgets, multipliers and seeds, for two languages."""
    g = table(spark, d, "manifest").filter(F.col("language").isin("hau", "swa")).select("dataset_id", "task", "language").distinct()
    for n, v in (("budget", [32, 64, 128]), ("multiplier", [2, 3]), ("seed", [13, 21, 42])):
        g = g.withColumn(n, F.explode(F.array(*[F.lit(x) for x in v])))
    return g.withColumn("slug", F.format_string("b%d_m%d_s%d", "budget", "multiplier", "seed"))


_PLAN = """cls AS (SELECT dataset_id, language, sum(v) AS n, count(*) AS labels, sum(least(v, {b})) AS per FROM (SELECT dataset_id, language, unnest(map_values(labels)) AS v FROM manifest WHERE split = 'train') GROUP BY ALL),
plan AS (SELECT r.run_id, least(c.per, c.n) AS gold, least(c.per, c.n) * r.multiplier AS candidates FROM runs r JOIN (SELECT r2.run_id, sum(least(v, r2.budget)) AS per, sum(v) AS n FROM runs r2 JOIN (SELECT dataset_id, language, unnest(map_values(labels)) AS v FROM manifest WHERE split = 'train') m USING (dataset_id, language) GROUP BY ALL) c USING (run_id))"""
_PLAN = _PLAN[_PLAN.index("plan AS") :]


def _planned(spark, d):
    m = rd.catalogue(table(spark, d, "manifest").filter("split = 'train'")).select("dataset_id", "language", "n")
    r = table(spark, d, "runs")
    return r.join(m, ["dataset_id", "language"]).groupBy("run_id", "multiplier").agg(F.sum(F.least("n", "budget")).alias("gold")).withColumn("candidates", F.col("gold") * F.col("multiplier"))


@query(f"WITH {_PLAN} SELECT run_id, gold::BIGINT AS gold, candidates::BIGINT AS candidates, (gold + 2 * candidates)::BIGINT AS requests FROM plan")
def plan_summary(spark, d):
    """Gold, candidates and requests (generation by seed, counterfactual and judge by candidate) of every run."""
    p = _planned(spark, d)
    return p.select("run_id", "gold", "candidates", (F.col("gold") + 2 * F.col("candidates")).alias("requests"))


@query(f"WITH {_PLAN}, t AS (SELECT sum(gold) AS g, sum(candidates) AS c, count(*) AS runs FROM plan), p AS (SELECT * FROM (VALUES ('one', 6::DOUBLE, 12::DOUBLE, 1), ('eight', 4, 9, 8), ('eight_fast', 2, 6, 8)) v(profile, low, high, jobs)) SELECT profile, round((g / 4 + c / 4 + c / 2) / 3600::DOUBLE + runs * low / jobs / 60, 6) AS low_hours, round((g / 4 + c / 4 + c / 2) / 3600::DOUBLE + runs * high / jobs / 60, 6) AS high_hours FROM t, p")
def runtime_estimate(spark, d):
    """Hours of requests at their rates and of fine-tunings at their minutes, for three machines."""
    t = _planned(spark, d).agg(F.sum("gold").alias("g"), F.sum("candidates").alias("c"), F.count(F.lit(1)).alias("runs"))
    # Profile, minutes per run, jobs at a time.
    profiles = [("one", 6.0, 12.0, 1), ("eight", 4.0, 9.0, 8), ("eight_fast", 2.0, 6.0, 8)]
    p = F.explode(F.array(*[F.struct(F.lit(a).alias("profile"), F.lit(b).alias("low"), F.lit(c).alias("high"), F.lit(j).alias("jobs")) for a, b, c, j in profiles])).alias("p")
    x = t.select("*", p).select("*", "p.*").withColumn("r", (F.col("g") / 4 + F.col("c") / 4 + F.col("c") / 2) / 3600)
    return x.select("profile", *[F.round(F.col("r") + F.col("runs") * F.col(c) / F.col("jobs") / 60, 6).alias(f"{c}_hours") for c in ("low", "high")])


@query("SELECT id, CASE WHEN text IS NULL THEN 'withheld' WHEN substr(sha256(text), 1, 16) = text_sha256 THEN 'match' ELSE 'mismatch' END AS state FROM gold WHERE id IS NOT NULL")
def gold_digest_check(spark, d):
    """Whether each gold text still is the one of its digest."""
    state = F.when(F.col("text").isNull(), "withheld").when(tx.stable_hash(F.col("text")) == F.col("text_sha256"), "match").otherwise("mismatch")
    return gold(spark, d).select("id", state.alias("state"))


@query(_RES + "SELECT run_id || ':' || generator || ':' || metric AS claim_id, metric, round(value, 3) AS value FROM (UNPIVOT (SELECT run_id, generator, n::DOUBLE AS n, f1, u FROM res) ON n, f1, u INTO NAME metric VALUE value)")
def claim_ledger_unpivot(spark, d):
    return ledger(_results(spark, d), ["run_id", "generator"], ["n", "f1", "u"]).withColumn("value", F.round("value", 3))


@query("SELECT item_id, slot, count(*)::DOUBLE AS value FROM (SELECT item_id, ('0x' || substr(md5(substr(s, i, 3)), 1, 8))::BIGINT % 64 AS slot FROM (SELECT item_id, s, unnest(range(1, length(s) - 1)) AS i FROM (SELECT item_id, '  ' || lower(coalesce(text, '')) || '  ' AS s FROM benchmark))) GROUP BY ALL")
def hash_embed_md5(spark, d):
    """Non-zero slots of the md5 embedding of the held-out texts."""
    e = table(spark, d, "benchmark").select("item_id", F.posexplode(embedder("hash-md5", dim=64)(F.col("text"))).alias("slot", "value"))
    return e.filter("value <> 0").select("item_id", F.col("slot").cast("bigint").alias("slot"), "value")


@query()
def hash_embed_blake2b(spark, d):
    """The hashed embedding of all candidates' texts; its hash has no SQL."""
    return candidates(spark, d).select("candidate_id", embedder("hash", dim=256)(F.col("text")).alias("embedding"))


@query()
def parse_judge_json(spark, d):
    """Objects read leniently from replies: candidates' metadata within prose, as a fenced block, within a list, or cut off, by the first digit of the id."""
    digit = F.conv(F.substring("candidate_id", 1, 1), 16, 10).cast("int") % 4
    m = F.coalesce("metadata", F.lit("{}"))
    reply = F.when(digit == 0, F.concat(F.lit("Here it is: "), m, F.lit(" Done."))).when(digit == 1, F.concat(F.lit("```json\n"), m, F.lit("\n```"))).when(digit == 2, F.concat(F.lit("[1, "), m, F.lit("]"))).otherwise(F.expr("substring(coalesce(metadata, '{}'), 1, length(coalesce(metadata, '{}')) - 1)"))
    return candidates(spark, d).select("candidate_id", reply_objects(reply).alias("objects"))


@query(f"WITH {CANDIDATES} SELECT candidate_id, coalesce(text, '') = '' AS no_text, coalesce(generator, 'unknown') AS generator, coalesce(generator_confidence, 0.5) AS confidence FROM cand")
def decode_defaults(spark, d):
    c = rd.decode_candidates(candidates(spark, d).withColumns({"source_seed_ids": F.lit(None).cast("array<string>"), "prompt_hash": F.lit(None).cast("string")}))
    return c.select("candidate_id", (F.col("text") == "").alias("no_text"), "generator", F.col("generator_confidence").alias("confidence"))


@query("SELECT event_type, count(*) AS n, round(avg(try_cast(value AS DOUBLE)), 6) AS mean FROM events GROUP BY ALL")
def event_summary(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("value").cast("double")), 6).alias("mean"))
