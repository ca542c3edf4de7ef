"""Queries of reading, stages, evaluation, reports and planning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from siftline.functions.embedding import embedder
from siftline.operators import evaluation as ev
from siftline.operators import generation as gen
from siftline.operators import metrics as mt
from siftline.operators import planning as pl
from siftline.operators import reports as rp
from siftline.operators import scoring as sc
from siftline.operators import selection as sel
from siftline.operators.config import RunConfig
from siftline.operators.staging import written
from siftline.plans.audit import audit
from siftline.plans.audit_queries import _CAPS, _NAMES, BUDGET, CFG, SOURCE_CAP, _ranked_sql, _run_caps, best, pool
from siftline.plans.pipeline_queries import _CF, _HAS, _JUDGE, _seeds
from siftline.plans.views import CANDIDATES, RECORDS, SCORED, audited, candidates, gold, query, records, scored, strip_sql, table
from siftline.sources import readers as rd
from siftline.sources import sinks as sk

#: Selections that reports compare: the anchors and the re-ranking.
SELECTORS = [*rp.ANCHORS, "rerank_v2"]


def _rounded(c: str):
    """Six decimals as the SQL rounds: of the double's millionfold, not of its decimal digits, which differ where these end in 5."""
    return (F.round(F.col(c) * 1e6) / 1e6).alias(c)


def _selections(spark, d, names=None):
    """The first rows of each baseline's ranking by run."""
    each = [best(spark, d, b).withColumn("baseline", F.lit(b)) for b in names or SELECTORS]
    return reduce(lambda a, b: a.unionByName(b), each)


def _selections_sql(names=None) -> str:
    each = "\nUNION ALL ".join(f"(WITH {_ranked_sql(b)} SELECT '{b}' AS baseline, * FROM ranked WHERE place <= {BUDGET})" for b in names or SELECTORS)
    return f"chosen AS ({each})"


# --- reading


@query("SELECT dataset_id, task, language, split, n_rows FROM manifest WHERE dataset_id = (SELECT min(dataset_id) FROM manifest WHERE task = 'sentiment_classification') AND task = 'sentiment_classification'")
def catalogue_lookup(spark, d):
    """The files of the first dataset of a task."""
    return rd.catalogue_entry(table(spark, d, "manifest"), task="sentiment_classification").select("dataset_id", "task", "language", "split", "n_rows")


@query(f"WITH {RECORDS} SELECT id FROM rec WHERE label IN (SELECT label FROM gold) AND {strip_sql('text')} <> ''")
def labelled_scan(spark, d):
    """Records with one of gold's labels and a text."""
    return rd.labelled(records(spark, d), gold(spark, d)).select("id")


_META = "CASE WHEN json_valid(metadata) THEN metadata END"


@query(f"""WITH {_selections_sql(['rerank_v2'])} SELECT candidate_id AS id, run_id, 'synthetic' AS split, md5(coalesce(x.text, '')) AS text_md5, x.label,
CASE WHEN json_type({_META.replace('metadata', 'x.metadata')}) = 'OBJECT' AND list_contains(json_keys(x.metadata), 'variant') THEN json_extract_string(x.metadata, '$.variant') END AS variant, 'true' AS synthetic FROM chosen x""")
def selected_training_records(spark, d):
    """Selected candidates as training records."""
    x = _selections(spark, d, ["rerank_v2"])
    cells = table(spark, d, "runs").select("run_id", "dataset_id", "task", "language")
    r = ev.training_records(x.join(cells, "run_id"))
    runs = x.select(F.col("candidate_id").alias("id"), "run_id")
    return r.join(runs, "id").select("id", "run_id", "split", F.md5(F.col("text").cast("binary")).alias("text_md5"), "label", F.try_element_at("metadata", F.lit("variant")).alias("variant"), F.try_element_at("metadata", F.lit("synthetic")).alias("synthetic"))


@query(f"WITH {_selections_sql()} SELECT run_id, baseline, count(*) AS selected, round(avg(coalesce(lc0, 0)), 6) AS judge_label_correctness, round(avg(coalesce(q0, 0)), 6) AS judge_quality_score, round(avg(coalesce(CASE WHEN isnan(c) THEN 0 ELSE c END, 0)), 6) AS c, round(avg(coalesce(CASE WHEN isnan(l) THEN 0 ELSE l END, 0)), 6) AS l, round(avg(coalesce(CASE WHEN isnan(h) THEN 0 ELSE h END, 0)), 6) AS h, round(avg(hard_reject::INT), 6) AS hard_reject_rate FROM chosen GROUP BY ALL")
def selection_quality(spark, d):
    """Means of judgements, scores and rejects of every selection."""
    q = rd.selection_quality(_selections(spark, d), ["run_id", "baseline"], "rank")
    return q.select("run_id", "baseline", "selected", *[_rounded(c) for c in ("judge_label_correctness", "judge_quality_score", "c", "l", "h", "hard_reject_rate")])


# a source in which a few texts have changed since the digests were taken
_SOURCE = "src AS (SELECT dataset_id, language, split, split_part(id, ':', -1) AS idx, CASE WHEN split_part(id, ':', -1)::BIGINT % 61 = 0 THEN text || '!' ELSE text END AS t FROM gold WHERE text IS NOT NULL)"


@query(f"""WITH {_SOURCE}, s AS (SELECT g.id, g.dataset_id, g.language, g.split, CASE WHEN t IS NULL THEN 'missing' WHEN text_sha256 IS NULL OR substr(sha256(t), 1, 16) = text_sha256 THEN 'restored' ELSE 'mismatch' END AS state, t
  FROM gold g LEFT JOIN src ON src.dataset_id = g.dataset_id AND src.language = g.language AND src.split = g.split AND src.idx = split_part(g.id, ':', -1) WHERE g.id IS NOT NULL)
SELECT id, state, count(*) FILTER (state = 'mismatch') OVER (PARTITION BY dataset_id, language, split) = 0 AS writable, CASE WHEN state = 'restored' THEN md5(t) END AS text_md5 FROM s""")
def gold_rehydration(spark, d):
    """Withheld gold filled in from its source by index, checked by digest; a cell with a mismatch isn't writable."""
    g, cell = gold(spark, d), ["dataset_id", "language", "split"]
    index = F.element_at(F.split("id", ":"), -1)
    source = g.filter(F.col("text").isNotNull()).select(*cell, index.alias("index"), F.when(index.cast("bigint") % 61 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    r = ev.rehydrated(g.withColumn("text", F.lit(None).cast("string")), source, cell)
    return r.select("id", "state", "writable", F.md5(F.col("text").cast("binary")).alias("text_md5"))


# --- stages


@query(f"""WITH {CANDIDATES}, done AS (SELECT DISTINCT unnest(source_seed_ids) AS id FROM candidates), v AS (SELECT g.id, g.label, i AS variant, {strip_sql("coalesce(g.text, '') || CASE WHEN i = 0 THEN '' ELSE ' [variant ' || i || ']' END")} AS text FROM gold g, (SELECT unnest(range(0, 2)) AS i) WHERE g.id IS NOT NULL AND g.id NOT IN (SELECT id FROM done WHERE id IS NOT NULL))
SELECT substr(sha256(concat_ws(':', id, variant::VARCHAR, text, coalesce(label, 'None'))), 1, 16) AS candidate_id, TRUE AS added FROM v UNION ALL SELECT candidate_id, FALSE FROM cand""")
def resume_generate(spark, d):
    """The generation stage after an earlier run: what is there, and two variants of every seed without a candidate."""
    seeds = _seeds(spark, d)
    done = candidates(spark, d).select("candidate_id", F.col("seeds").alias("seed_id"), F.lit(False).alias("added"))
    every = table(spark, d, "candidates").select(F.lit(None).cast("string").alias("candidate_id"), F.col("source_seed_ids").alias("seed_id"))
    made = gen.generated(seeds, every, 2, labels=F.col("labels"), work=lambda x: gen.generate(x, 2, F.col("labels")).select("candidate_id", F.array("seed_id").alias("seed_id"), F.lit(True).alias("added")))
    return made.filter("added").select("candidate_id", "added").unionByName(done.select("candidate_id", "added"))


@query(f"WITH {CANDIDATES}, s AS (SELECT c.candidate_id, coalesce(c.counterfactual.failed, FALSE) AS failed, c.counterfactual.label AS cl, c.counterfactual.semantic_edit_score AS sc, c.label, c.counterfactual IS NULL AS none FROM cand c) SELECT candidate_id, CASE WHEN failed THEN label ELSE cl END AS cf_label, CASE WHEN failed THEN 0 ELSE sc END AS cf_score, CASE WHEN failed THEN 'retained_for_audit_with_zero_counterfactual_score' END AS cf_policy FROM s")
def counterfactual_stage(spark, d):
    """The counterfactual stage with the stored counterfactuals as its builder's: failures are kept, marked, with a score of 0."""
    build = lambda x: x.select("candidate_id", "label", F.col("counterfactual.text").alias("cf_text"), F.col("counterfactual.label").alias("cf_label"), F.col("counterfactual.semantic_edit_score").alias("cf_score"), F.when(F.col("counterfactual.failed"), "failed").alias("cf_error"))
    out = gen.counterfactuals(candidates(spark, d), [], work=build, most_failed=1.0)
    return out.select("candidate_id", "cf_label", "cf_score", "cf_policy")


@query(_CF + _JUDGE + ", done AS (SELECT candidate_id FROM f WHERE variant = 0) SELECT candidate_id, round(quality_score, 6) AS judge_score, CASE WHEN cf_text IS NOT NULL THEN counterfactual_validity END AS judge_validity, candidate_id IN (SELECT candidate_id FROM done) AS earlier FROM f")
def judged_stage(spark, d):
    """The judge's stage, resumed after the first variants: judgements of the rest beside those that are there."""
    labels = _seeds(spark, d)
    g = gen.generate(labels, 3, F.col("labels")).join(labels.select("dataset_id", "language", "labels").distinct(), ["dataset_id", "language"], "left")
    c = written(gen.counterfactual(g, F.col("labels")).drop("labels"), "counterfactuals")
    first = gen.judged(c.filter("variant = 0")).withColumn("earlier", F.lit(True))
    out = gen.judged(c, first).withColumn("earlier", F.coalesce("earlier", F.lit(False)))
    return out.select("candidate_id", F.round("judge_score", 6).alias("judge_score"), "judge_validity", "earlier")


_FIELD = lambda n: f"json_extract_string({_META}, '$.llm_judge.{n}')"


@query(f"WITH {CANDIDATES} SELECT candidate_id, coalesce({_FIELD('judge_model')}, 'unknown') AS judge_model, " + ", ".join(f"greatest(0, least(1, coalesce(try_cast({_FIELD(n)} AS DOUBLE), 0.5::DOUBLE))) AS {n}" for n in _NAMES.values()) + f" FROM cand WHERE {_HAS}")
def normalised_judgement(spark, d):
    """The judgements in candidates' metadata with every score in [0, 1], 0.5 for what is missing or no number."""
    rows = candidates(spark, d).filter(gen.has_judgement(F.col("metadata")))
    j = gen.normalised_judgement(F.get_json_object("metadata", "$.llm_judge"), with_id=False)
    return rows.select("candidate_id", j.alias("j")).select("candidate_id", "j.judge_model", *[f"j.{n}" for n in _NAMES.values()])


@query(f"""WITH {CANDIDATES}, i AS (SELECT candidate_id AS seed_id, coalesce(label, 'seed') AS lab, coalesce(text, '') AS t, least(1, greatest(0, coalesce(generator_confidence, 0.7::DOUBLE))) AS conf, coalesce(prompt_hash, '') AS raw FROM cand)
SELECT seed_id, substr(sha256(concat_ws(':', seed_id, '0', t, lab, raw)), 1, 16) AS candidate_id, md5(t) AS text_md5, lab AS label, conf AS generator_confidence FROM i""")
def item_candidates(spark, d):
    """Candidates made of generated items, each with its seed; a label or confidence that the item lacks comes from elsewhere."""
    c = candidates(spark, d)
    item = F.to_json(F.struct("text", F.col("label"), F.col("generator_confidence").alias("confidence")))
    items = c.select(F.col("candidate_id").alias("seed_id"), "task", "language", F.lit("seed").alias("label"), F.col("text").alias("seed_text"), item.alias("item"), F.lit(0).alias("index"), F.coalesce("prompt_hash", F.lit("")).alias("raw"))
    m = gen.candidates_of_items(items, "model")
    return m.select("seed_id", "candidate_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "label", "generator_confidence")


@query()
def audit_scores(spark, d):
    """The whole audit of all candidates: every score from the texts, with the hash embedder."""
    c = table(spark, d, "candidates")
    return audit(c, gold(spark, d), table(spark, d, "benchmark")).select("candidate_id", "run_id", *[F.round(x, 6).alias(x) for x in "ulhdcs"], "hard_reject", F.array_join("reject_reasons", ",").alias("reasons"))


# --- evaluation


_EMBED = r"""gr AS (SELECT id, side, ('0x' || substr(md5(substr(s, i, 3)), 1, 8))::BIGINT % 64 AS slot FROM (SELECT id, side, s, unnest(range(1, length(s) - 1)) AS i FROM (SELECT id, side, '  ' || lower(coalesce(text, '')) || '  ' AS s FROM allrec))),
vec AS (SELECT id, side, slot, count(*)::DOUBLE AS v FROM gr GROUP BY ALL)"""


@query(f"""WITH {_selections_sql(['rerank_v2'])}, allrec AS (
  SELECT 'g' || id AS id, 'train' AS side, 'gold' AS kind, dataset_id, task, language, text, label FROM gold WHERE id IS NOT NULL
  UNION ALL SELECT 's' || x.candidate_id, 'train', 'synthetic', r.dataset_id, r.task, r.language, coalesce(x.text, ''), x.label FROM chosen x JOIN runs r USING (run_id)
  UNION ALL SELECT 't' || item_id, 'test', 'test', dataset_id, task, language, text, label FROM benchmark WHERE split = 'test'),
{_EMBED},
size AS (SELECT dataset_id, task, language, count(*) FILTER (kind = 'gold') AS train_gold, count(*) FILTER (kind = 'synthetic') AS train_synthetic, count(*) FILTER (kind = 'test') AS test_size FROM allrec GROUP BY ALL HAVING test_size > 0),
lab AS (SELECT dataset_id, task, language, label, count(*) AS m FROM allrec WHERE side = 'train' AND label IS NOT NULL GROUP BY ALL),
cen AS (SELECT a.dataset_id, a.task, a.language, a.label, slot, sum(v) AS v FROM allrec a JOIN vec USING (id) WHERE a.side = 'train' AND a.label IS NOT NULL GROUP BY ALL),
cn AS (SELECT dataset_id, task, language, label, sqrt(sum(v * v)) AS norm FROM cen GROUP BY ALL),
tn AS (SELECT id, sqrt(sum(v * v)) AS norm FROM vec WHERE side = 'test' GROUP BY ALL),
dotp AS (SELECT t.id, c.label, sum(x.v * c.v) AS dot FROM allrec t JOIN vec x USING (id) JOIN cen c ON c.dataset_id = t.dataset_id AND c.task = t.task AND c.language = t.language AND c.slot = x.slot WHERE t.side = 'test' GROUP BY ALL),
cosv AS (SELECT t.id, t.dataset_id, t.task, t.language, coalesce(t.label, 'None') AS truth, cn.label AS class, coalesce(d.dot, 0) / (greatest(cn.norm, 1e-12) * greatest(tn.norm, 1e-12)) AS cos FROM allrec t JOIN cn USING (dataset_id, task, language) JOIN tn ON tn.id = t.id LEFT JOIN dotp d ON d.id = t.id AND d.label = cn.label WHERE t.side = 'test'),
pr AS (SELECT id, dataset_id, task, language, truth, class AS guess, 1 / sum(exp(cos - mx)) OVER (PARTITION BY id) AS p, row_number() OVER (PARTITION BY id ORDER BY round(cos, 9) DESC, class) AS k FROM (SELECT *, max(cos) OVER (PARTITION BY id) AS mx FROM cosv)),
pred AS (SELECT * FROM pr WHERE k = 1),
two AS (SELECT dataset_id, task, language, truth AS label, (truth = guess)::INT AS hit, 1 AS seen FROM pred UNION ALL SELECT dataset_id, task, language, guess, 0, 1 FROM pred),
f1 AS (SELECT dataset_id, task, language, avg(f) AS macro_f1 FROM (SELECT dataset_id, task, language, label, 2 * sum(hit) / sum(seen)::DOUBLE AS f FROM two GROUP BY ALL) GROUP BY ALL),
acc AS (SELECT dataset_id, task, language, avg((truth = guess)::INT) AS accuracy FROM pred GROUP BY ALL),
ec AS (SELECT dataset_id, task, language, sum(n * abs(a - c)) / sum(n) AS ece FROM (SELECT dataset_id, task, language, least(9, floor(p * 10)) AS b, count(*) AS n, avg((truth = guess)::INT) AS a, avg(p) AS c FROM pred GROUP BY ALL) GROUP BY ALL)
SELECT dataset_id, task, language, train_gold, train_synthetic, test_size, 'lightweight_hash-md5' AS evaluator, round(macro_f1, 6) AS macro_f1, round(accuracy, 6) AS accuracy, round(ece, 6) AS ece FROM size LEFT JOIN f1 USING (dataset_id, task, language) LEFT JOIN acc USING (dataset_id, task, language) LEFT JOIN ec USING (dataset_id, task, language)""")
def evaluate_cells(spark, d):
    """Gold and the re-ranked selection of every cell's runs as training data, scored on the cell's test items."""
    x = _selections(spark, d, ["rerank_v2"]).select("run_id", "candidate_id", "text", "label", "metadata").join(table(spark, d, "runs").select("run_id", "dataset_id", "task", "language"), "run_id")
    synthetic = ev.training_records(x)
    test = table(spark, d, "benchmark").filter("split = 'test'").withColumn("id", F.col("item_id").cast("string"))
    e = ev.evaluate(gold(spark, d), synthetic, test, embedder("hash-md5", dim=64), "hash-md5")
    m = lambda n: F.round(F.try_element_at("metrics", F.lit(n)), 6).alias(n)
    return e.select("dataset_id", "task", "language", "train_gold", "train_synthetic", "test_size", "evaluator", m("macro_f1"), m("accuracy"), m("ece"))


@query(r"""WITH s AS (SELECT dataset_id, language, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS w FROM gold WHERE text IS NOT NULL), t AS (SELECT dataset_id, language, w FROM s WHERE len(w) > 0), u AS (SELECT dataset_id, language, regexp_matches(unnest(w), '^\p{Lu}') AS n FROM t)
SELECT u.dataset_id, u.language, (SELECT count(*) FROM t WHERE t.dataset_id = u.dataset_id AND t.language = u.language) AS rows, count(*) AS tokens, count(*) FILTER (n) AS names FROM u GROUP BY ALL""")
def tag_counts(spark, d):
    """Sentences, tokens and tags other than O of every cell; words with a capital are tagged as names."""
    words = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    tags = F.transform(words, lambda w: F.when(w.rlike(r"^\p{Lu}"), "N").otherwise("O"))
    n = ev.tag_counts(gold(spark, d).filter(F.col("text").isNotNull()).select("dataset_id", "language", tags.alias("tags")), ["dataset_id", "language"], "tags")
    return n.select("dataset_id", "language", "rows", "tokens", F.coalesce(F.try_element_at("labels", F.lit("N")), F.lit(0)).alias("names"))


@query("SELECT dataset_id, task, language, split, sum(n)::BIGINT AS n_rows, string_agg(l || '=' || n, ',' ORDER BY l) AS labels FROM (SELECT dataset_id, task, language, split, coalesce(label, 'None') AS l, count(*) AS n FROM (SELECT dataset_id, task, language, split, label FROM gold UNION ALL SELECT dataset_id, task, language, split, label FROM benchmark UNION ALL SELECT dataset_id, task, language, split, label FROM records) GROUP BY ALL) GROUP BY ALL")
def manifest_built(spark, d):
    """A manifest of gold, held-out items and records."""
    cols = ["dataset_id", "task", "language", "split", "label"]
    every = reduce(lambda a, b: a.unionByName(b), [table(spark, d, n).select(*cols) for n in ("gold", "benchmark", "records")])
    m = ev.manifest_of(every)
    return m.select("dataset_id", "task", "language", "split", "n_rows", F.array_join(F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("labels"))


# --- reports


_SHARES = "gs AS (SELECT task, label, n / sum(n) OVER (PARTITION BY task) AS share FROM (SELECT task, label, count(*) AS n FROM gold WHERE label IS NOT NULL AND id IS NOT NULL GROUP BY ALL))"
_KEY = "md5(to_json({'label': label, 'source_seed_ids': coalesce(seeds, []), 'text': text}))"
_SUMMARY = f"""WITH {_selections_sql()}, {_SHARES},
base AS (SELECT run_id, baseline, count(*) AS selected, count(*) / {BUDGET}::DOUBLE AS fill_rate, avg(hard_reject::INT) AS hard_reject_rate,
  avg(((coalesce(l, 0) <= 0.15::DOUBLE OR coalesce(isnan(l), FALSE)) AND (coalesce(h, 0) <= 0.7::DOUBLE OR coalesce(isnan(h), FALSE)) AND coalesce(c, 0) >= 0.6::DOUBLE)::INT) AS strict_pass_rate, avg(v2) AS proxy_score,
  {', '.join(f'avg(coalesce(CASE WHEN isnan({c}) THEN 0 ELSE {c} END, 0)) AS score_{c}' for c in rp.SCORES)}, {', '.join(f'avg(coalesce({k}, 0)) AS judge_{v}' for k, v in _NAMES.items())} FROM chosen GROUP BY ALL),
src AS (SELECT run_id, baseline, max(n) AS source_max FROM (SELECT run_id, baseline, s, count(*) AS n FROM (SELECT run_id, baseline, unnest(seeds) AS s FROM chosen) WHERE s IS NOT NULL GROUP BY ALL) GROUP BY ALL),
lp AS (SELECT run_id, baseline, label, n / sum(n) OVER (PARTITION BY run_id, baseline) AS p FROM (SELECT run_id, baseline, label, count(*) AS n FROM chosen WHERE label IS NOT NULL GROUP BY ALL)),
lg AS (SELECT x.run_id, x.baseline, gs.label, gs.share FROM (SELECT DISTINCT run_id, baseline FROM lp) x JOIN runs r USING (run_id) JOIN gs ON gs.task = r.task),
tvd AS (SELECT run_id, baseline, CASE WHEN count(p) > 0 AND count(share) > 0 THEN sum(abs(coalesce(p, 0) - coalesce(share, 0))) / 2 ELSE 0 END AS label_tvd FROM lp FULL JOIN lg USING (run_id, baseline, label) GROUP BY ALL),
items AS (SELECT DISTINCT run_id, baseline, {_KEY} AS k FROM chosen), ni AS (SELECT run_id, baseline, count(*) AS n FROM items GROUP BY ALL),
met AS (SELECT a.run_id, a.baseline, b.baseline AS anchor, count(*) AS c FROM items a JOIN items b ON a.run_id = b.run_id AND a.k = b.k WHERE b.baseline <> 'rerank_v2' GROUP BY ALL),
jac AS (SELECT m.run_id, m.baseline, anchor, c / (x.n + y.n - c)::DOUBLE AS j FROM met m JOIN ni x ON x.run_id = m.run_id AND x.baseline = m.baseline JOIN ni y ON y.run_id = m.run_id AND y.baseline = anchor),
summary AS (SELECT b.*, coalesce(source_max, 0) AS source_max, coalesce(label_tvd, 0) AS label_tvd, {', '.join(f"coalesce((SELECT max(j) FROM jac WHERE jac.run_id = b.run_id AND jac.baseline = b.baseline AND anchor = '{a}'), 0) AS jaccard_vs_{a}" for a in rp.ANCHORS)}
  FROM base b LEFT JOIN src USING (run_id, baseline) LEFT JOIN tvd USING (run_id, baseline))"""
_NUMBERS = ["fill_rate", "hard_reject_rate", "strict_pass_rate", "proxy_score", *(f"score_{c}" for c in rp.SCORES), *(f"judge_{n}" for n in _NAMES.values()), "label_tvd", *(f"jaccard_vs_{a}" for a in rp.ANCHORS)]


def _summaries(spark, d):
    g = gold(spark, d).filter(F.col("label").isNotNull()).groupBy("task", "label").agg(F.count(F.lit(1)).alias("n"))
    shares = g.join(g.groupBy("task").agg(F.sum("n").alias("of")), "task").join(table(spark, d, "runs").select("run_id", "task"), "task").select("run_id", "label", (F.col("n") / F.col("of")).alias("share"))
    return rp.selection_summary(written(_selections(spark, d), "selections"), shares, ["run_id", "baseline"], F.lit(BUDGET), CFG, "rank")


@query(f"{_SUMMARY} SELECT run_id, baseline, selected, source_max, {', '.join(f'round({c}, 6) AS {c}' for c in _NUMBERS)} FROM summary")
def selection_summary(spark, d):
    """What every selection took: fill, label shares, rejects, sources, means of scores and judgements, and overlap with the anchors."""
    return _summaries(spark, d).select("run_id", "baseline", "selected", "source_max", *[_rounded(c) for c in _NUMBERS])


_ACROSS = ["fill_rate", "label_tvd", "hard_reject_rate", "strict_pass_rate", "proxy_score", "source_max", "jaccard_vs_naive", *(f"score_{c}" for c in rp.SCORES), *(f"judge_{n}" for n in _NAMES.values())]


@query(f"{_SUMMARY} SELECT baseline, count(*) AS n, {', '.join(f'round(avg({c}), 6) AS {c}' for c in _ACROSS)} FROM summary GROUP BY ALL")
def selection_across_cells(spark, d):
    """The means over runs of every selector's summaries."""
    return rp.across_cells(_summaries(spark, d)).select("baseline", "n", *[_rounded(c) for c in _ACROSS])


_OVERLAP = f"""{_selections_sql(['rerank_v2', 'naive'])}, p AS (SELECT run_id, {_KEY} AS k, count(*) FILTER (baseline = 'rerank_v2') AS x, count(*) FILTER (baseline = 'naive') AS y FROM chosen GROUP BY ALL),
o AS (SELECT run_id, count(*) FILTER (x > 0 AND y > 0) / count(*)::DOUBLE AS jaccard, sum(least(x, y)) / sum(greatest(x, y))::DOUBLE AS multiset_jaccard, bool_and(x = y) AS same FROM p GROUP BY ALL),
over AS (SELECT r.run_id, coalesce(jaccard, 1) AS jaccard, coalesce(multiset_jaccard, 1) AS multiset_jaccard, coalesce(same, TRUE) AS same FROM runs r LEFT JOIN o USING (run_id))"""


def _overlaps(spark, d):
    side = lambda b: best(spark, d, b).select("run_id", rp.row_key().alias("k"))
    return rp.overlap(side("rerank_v2"), side("naive"), ["run_id"], "k", table(spark, d, "runs"))


@query(f"WITH {_OVERLAP} SELECT run_id, round(jaccard, 6) AS jaccard, round(multiset_jaccard, 6) AS multiset_jaccard, same FROM over")
def pool_overlap(spark, d):
    """Overlap of two selections by label, text and sources, as sets and as multisets."""
    return _overlaps(spark, d).withColumns({c: F.round(c, 6) for c in ("jaccard", "multiset_jaccard")})


@query(f"WITH {_OVERLAP}, m AS (SELECT run_id, baseline, avg(coalesce(CASE WHEN isnan(s) THEN 0 ELSE s END, 0)) AS metric FROM chosen GROUP BY ALL), j AS (SELECT o.*, a.metric AS metric_a, b.metric AS metric_b FROM over o LEFT JOIN m a ON a.run_id = o.run_id AND a.baseline = 'naive' LEFT JOIN m b ON b.run_id = o.run_id AND b.baseline = 'rerank_v2') SELECT run_id, round(metric_a, 6) AS metric_a, round(metric_b, 6) AS metric_b, round(metric_b - metric_a, 6) AS delta, same AND coalesce(abs(metric_b - metric_a) > 1e-9, FALSE) AS flag FROM j")
def selection_consistency(spark, d):
    """Runs whose two selections are equal while their results are not."""
    m = _selections(spark, d, ["rerank_v2", "naive"]).groupBy("run_id", "baseline").agg(F.avg(F.coalesce(F.nanvl("s", F.lit(0.0)), F.lit(0.0))).alias("metric"))
    j = rp.inconsistent(_overlaps(spark, d), m, ["run_id"], "naive", "rerank_v2")
    return j.select("run_id", *[F.round(c, 6).alias(c) for c in ("metric_a", "metric_b", "delta")], "flag")


@query(f"WITH {_selections_sql(['rerank_v2'])}, n AS (SELECT run_id, s, count(*) AS n FROM (SELECT run_id, unnest(seeds) AS s FROM chosen) WHERE s IS NOT NULL GROUP BY ALL) SELECT run_id, count(*) AS sources, max(n) AS source_max FROM n GROUP BY ALL")
def source_counts(spark, d):
    """How many sources a selection cites, all of each row counted, and how often the most cited one."""
    n = rp.source_counts(best(spark, d, "rerank_v2"), ["run_id"])
    return n.groupBy("run_id").agg(F.count(F.lit(1)).alias("sources"), F.max("n").alias("source_max"))


@query(f"WITH {RECORDS} SELECT id, md5(to_json({{'candidate_id': id, 'dataset_id': dataset_id, 'label': label, 'language': language, 'summary': summary, 'tags': NULL::VARCHAR, 'task': task, 'text': coalesce(text, ''), 'tokens': NULL::VARCHAR}})) AS payload FROM rec")
def canonical_payload(spark, d):
    """Records in the form in which two training sets are compared."""
    r = records(spark, d).withColumn("candidate_id", F.col("id"))
    return r.select("id", rp.payload_key(r).alias("payload"))


@query(f"WITH {_selections_sql()}, m AS (SELECT run_id, baseline, avg(lc0) AS m FROM chosen WHERE lc0 IS NOT NULL GROUP BY ALL) SELECT baseline, round(avg(m), 6) AS mean FROM m GROUP BY ALL")
def judge_means_by_selector(spark, d):
    """A judge's mean of every selector's rows, looked up by candidate: over a run's rows, then over runs."""
    judge = sc.with_judgement(candidates(spark, d)).select("candidate_id", F.col("judge_label_correctness").alias("score"))
    return rp.judge_means(_selections(spark, d), judge, ["run_id"]).withColumn("mean", F.round("mean", 6))


#: Replay results: a run's mean score of each generator, by its seed, and the generators' judged quality.
_REPLAY = f"""{SCORED}, res AS (SELECT r.seed, s.run_id, c.generator AS baseline, avg(s.s) AS macro_f1 FROM scored s JOIN cand c USING (candidate_id) JOIN runs r ON r.run_id = s.run_id WHERE c.generator IS NOT NULL GROUP BY ALL),
qual AS (SELECT generator AS baseline, avg(lc) AS quality FROM (SELECT generator, try_cast(json_extract_string(CASE WHEN json_valid(metadata) THEN metadata END, '$.llm_judge.label_correctness') AS DOUBLE) AS lc FROM cand) WHERE generator IS NOT NULL AND lc IS NOT NULL GROUP BY ALL)"""


def _replay(spark, d):
    c = candidates(spark, d).select("candidate_id", F.col("generator").alias("baseline"), "metadata").filter(F.col("baseline").isNotNull())
    r = scored(spark, d).select("candidate_id", "run_id", "s").join(c.drop("metadata"), "candidate_id").join(table(spark, d, "runs").select("run_id", "seed"), "run_id")
    lc = F.get_json_object("metadata", "$.llm_judge.label_correctness").try_cast("double")
    return r.groupBy("seed", "run_id", "baseline").agg(F.avg("s").alias("macro_f1")), c.select("baseline", lc.alias("q")).filter(F.col("q").isNotNull()).groupBy("baseline").agg(F.avg("q").alias("quality"))


@query(f"WITH {_REPLAY}, m AS (SELECT baseline, seed, avg(macro_f1) AS m FROM res GROUP BY ALL), n AS (SELECT baseline, avg(m) AS mean, coalesce(stddev_pop(m), 0) AS sd FROM m GROUP BY ALL) SELECT baseline, round(mean, 6) AS mean, round(sd, 6) AS sd, round(quality, 6) AS quality FROM n JOIN qual USING (baseline)")
def selector_means(spark, d):
    """Means over cells, then over seeds, beside the audit's aggregate of each selector."""
    r, q = _replay(spark, d)
    return rp.seed_means(r).join(q, "baseline").select("baseline", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "quality")])


_RHO = "coalesce(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 0)"
_AGREE = f"""{_REPLAY}, bo AS (SELECT seed, run_id, baseline, macro_f1 AS v, quality AS q FROM res JOIN qual USING (baseline)),
wr AS (SELECT seed, run_id, rank() OVER (PARTITION BY seed, run_id ORDER BY q) + (count(*) OVER (PARTITION BY seed, run_id, q) - 1) / 2.0 AS x, rank() OVER (PARTITION BY seed, run_id ORDER BY v) + (count(*) OVER (PARTITION BY seed, run_id, v) - 1) / 2.0 AS y FROM bo),
w AS (SELECT seed, run_id, {_RHO} AS rho FROM wr GROUP BY ALL HAVING count(*) >= 3),
ws AS (SELECT seed, avg(rho) AS within_mean, list_sort(list(rho))[count(*) // 2 + 1] AS within_median, count(*) AS cells FROM w GROUP BY ALL),
se AS (SELECT seed, baseline, avg(v) AS v, any_value(q) AS q FROM bo GROUP BY ALL),
sr AS (SELECT seed, rank() OVER (PARTITION BY seed ORDER BY q) + (count(*) OVER (PARTITION BY seed, q) - 1) / 2.0 AS x, rank() OVER (PARTITION BY seed ORDER BY v) + (count(*) OVER (PARTITION BY seed, v) - 1) / 2.0 AS y FROM se),
agree AS (SELECT s.seed, s.rho AS selector_rho, within_mean, within_median, cells FROM (SELECT seed, {_RHO} AS rho FROM sr GROUP BY ALL HAVING count(*) >= 3) s LEFT JOIN ws USING (seed))"""


@query(f"WITH {_AGREE} SELECT seed, round(selector_rho, 6) AS selector_rho, round(within_mean, 6) AS within_mean, round(within_median, 6) AS within_median, cells FROM agree")
def selector_agreement(spark, d):
    """Rank correlation of selectors' judged quality with their results: over selectors, and within cells, by seed."""
    a = rp.agreement(*_replay(spark, d), ["run_id"])
    return a.select("seed", *[F.round(c, 6).alias(c) for c in ("selector_rho", "within_mean", "within_median")], F.col("cells").cast("bigint").alias("cells"))


_UNSTABLE = ["selector_min", "selector_max", "selector_mean", "within_min", "within_max", "within_mean"]


@query(f"WITH {_AGREE} SELECT count(*) AS seeds, " + ", ".join(f"round({f}({c}), 6) AS {n}_{f.replace('avg', 'mean')}" for c, n in (("selector_rho", "selector"), ("within_mean", "within")) for f in ("min", "max", "avg")) + " FROM agree")
def selector_instability(spark, d):
    """How far these correlations differ between seeds."""
    return rp.instability(rp.agreement(*_replay(spark, d), ["run_id"])).select("seeds", *[F.round(c, 6).alias(c) for c in _UNSTABLE])


@query(f"WITH {SCORED} SELECT run_id, count(*) FILTER (NOT hard_reject) AS passing FROM scored GROUP BY ALL")
def hard_reject_pool(spark, d):
    """Candidates of each run that no gate rejects."""
    return scored(spark, d).groupBy("run_id").agg(F.count_if(~F.col("hard_reject")).alias("passing"))


_VARIANTS = {"hard": "audited", "relaxed": "audited_relaxed", "soft": "audited_soft"}


def _variant(spark, d, name: str):
    """The rows of a variant by their rank: gated ones by score, or under "equal" all, those that pass the gate first."""
    if name != "equal":
        return pool(spark, d, _VARIANTS[name])
    return sc.with_judgement(audited(spark, d)).withColumn("score", F.round(F.when(sc.passes(CFG, CFG.tau_c), 1e6).otherwise(0.0) + F.coalesce("s", F.lit(0.0)), 9))


_PASS = "((coalesce(l, 0) <= 0.15::DOUBLE OR coalesce(isnan(l), FALSE)) AND (coalesce(h, 0) <= 0.7::DOUBLE OR coalesce(isnan(h), FALSE)){c})"
_KINDS = {"hard": (_PASS.format(c=" AND coalesce(c, 0) >= 0.6::DOUBLE"), "coalesce(s, 0)"), "relaxed": (_PASS.format(c=" AND coalesce(c, 0) >= 0.45::DOUBLE"), "coalesce(s, 0)"), "soft": (_PASS.format(c=""), "coalesce(s, 0)"), "equal": ("TRUE", f"CASE WHEN {_PASS.format(c=' AND coalesce(c, 0) >= 0.6::DOUBLE')} THEN 1e6 ELSE 0 END + coalesce(s, 0)")}
_VARIANT_SQL = "vr AS (" + " UNION ALL ".join(f"SELECT '{k}' AS variant, run_id, candidate_id, source, round({score}, 9) AS sc FROM scored WHERE {where}" for k, (where, score) in _KINDS.items()) + f"""),
vo AS (SELECT vr.*, coalesce(g.label, 'None') AS lab, row_number() OVER (PARTITION BY variant, run_id ORDER BY CASE WHEN isnan(sc) THEN 1 ELSE 0 END, sc DESC, candidate_id) AS place FROM vr LEFT JOIN gold g ON g.id = vr.source),
va AS (SELECT * FROM vo QUALIFY source IS NULL OR row_number() OVER (PARTITION BY variant, run_id, source ORDER BY place) <= {SOURCE_CAP}),
vq AS (SELECT runs.run_id, caps.label, caps.cap FROM runs JOIN caps USING (task)),
vb AS (SELECT va.*, row_number() OVER (PARTITION BY variant, va.run_id, lab ORDER BY place) > coalesce(q.cap, {BUDGET}) AS late FROM va LEFT JOIN vq q ON q.run_id = va.run_id AND q.label = lab),
vc AS (SELECT variant, run_id, candidate_id, row_number() OVER (PARTITION BY variant, run_id ORDER BY late, place) AS p FROM vb),
fill AS (SELECT k.variant, runs.run_id, (SELECT count(*) FROM vc WHERE vc.variant = k.variant AND vc.run_id = runs.run_id AND p <= {BUDGET}) AS n FROM runs, (SELECT unnest(['hard', 'relaxed', 'soft', 'equal']) AS variant) k)"""


def _fills(spark, d, names=("hard", "relaxed", "soft", "equal")):
    """Rows that each variant selects of every run, within gold's quotas and source caps."""
    from siftline.plans.audit_queries import _by_gold_label

    runs = table(spark, d, "runs").select("run_id")
    out = []
    for k in names:
        rows = _by_gold_label(spark, d, _variant(spark, d, k))
        taken = sel.laminar_take(rows, _run_caps(spark, d), ["run_id"], "label", "source", "score", "candidate_id", SOURCE_CAP, BUDGET)
        n = taken.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
        out.append(runs.join(n, "run_id", "left").select(F.lit(k).alias("variant"), "run_id", F.coalesce("n", F.lit(0)).alias("n")))
    return reduce(lambda a, b: a.unionByName(b), out)


@query(f"WITH {SCORED.replace('scored AS', 'scored0 AS')}, scored AS (SELECT c.candidate_id, c.run_id, c.source, a.scores.l::DOUBLE AS l, a.scores.h::DOUBLE AS h, a.scores.c::DOUBLE AS c, a.scores.s::DOUBLE AS s FROM cand c JOIN latest a USING (candidate_id)), {_CAPS}, {_VARIANT_SQL} SELECT variant, run_id, n FROM fill")
def preflight_variants(spark, d):
    """Rows that the hard, relaxed, soft and budget-preserving variants select of every run."""
    return _fills(spark, d)


_METRICS = "m AS (SELECT run_id, baseline, avg(coalesce(CASE WHEN isnan(s) THEN 0 ELSE s END, 0)) AS macro_f1 FROM chosen GROUP BY ALL)"
_PREFLIGHT = f"""WITH {_selections_sql(['audited', 'naive'])}, {_METRICS}, {SCORED.replace('scored AS', 'scored0 AS')}, scored AS (SELECT c.candidate_id, c.run_id, c.source, a.scores.l::DOUBLE AS l, a.scores.h::DOUBLE AS h, a.scores.c::DOUBLE AS c, a.scores.s::DOUBLE AS s FROM cand c JOIN latest a USING (candidate_id)), {_CAPS}, {_VARIANT_SQL},
imb AS (SELECT r.run_id, coalesce(max(n) / sum(n)::DOUBLE, 0) AS imbalance FROM runs r LEFT JOIN (SELECT dataset_id, language, label, count(*) AS n FROM gold WHERE label IS NOT NULL AND id IS NOT NULL GROUP BY ALL) g USING (dataset_id, language) GROUP BY ALL),
pf AS (SELECT f.run_id, f.n / {BUDGET}::DOUBLE AS fill, imbalance, concat_ws(',', CASE WHEN f.n / {BUDGET}::DOUBLE < 0.5 THEN 'underfills_budget' END, CASE WHEN imbalance > 0.6 THEN 'gold_label_imbalance' END, CASE WHEN o.macro_f1 < b.macro_f1 THEN 'loses_to_naive' END) AS warnings, o.macro_f1 AS own, b.macro_f1 AS base
  FROM fill f JOIN imb USING (run_id) LEFT JOIN m o ON o.run_id = f.run_id AND o.baseline = 'audited' LEFT JOIN m b ON b.run_id = f.run_id AND b.baseline = 'naive' WHERE variant = 'hard')"""


def _preflight(spark, d):
    fills = _fills(spark, d, ["hard"]).select("run_id", (F.col("n") / BUDGET).alias("fill"))
    runs = table(spark, d, "runs").select("run_id", "dataset_id", "language")
    g = gold(spark, d).join(runs, ["dataset_id", "language"]).select("run_id", "label")
    m = _selections(spark, d, ["audited", "naive"]).groupBy("run_id", "baseline").agg(F.avg(F.coalesce(F.nanvl("s", F.lit(0.0)), F.lit(0.0))).alias("macro_f1"))
    return rp.preflight(fills, g, m, ["run_id"]), m


@query(f"{_PREFLIGHT} SELECT run_id, round(fill, 6) AS fill, round(imbalance, 6) AS imbalance, warnings FROM pf")
def preflight_warnings(spark, d):
    """Runs whose gated selection is under half full, whose gold is mostly of one label, or that do worse than a random selection."""
    return _preflight(spark, d)[0].select("run_id", F.round("fill", 6).alias("fill"), F.round("imbalance", 6).alias("imbalance"), "warnings")


@query(f"{_PREFLIGHT}, dl AS (SELECT own - base AS d FROM pf), every AS (SELECT DISTINCT run_id FROM m) SELECT count(*) AS cells, round(avg(fill), 6) AS mean_fill, round(min(fill), 6) AS min_fill, count(*) FILTER (warnings <> '') AS warned, (SELECT count(*) FROM dl WHERE d >= 1e-12) AS wins, (SELECT count(*) FROM dl WHERE abs(d) < 1e-12) AS ties, (SELECT count(*) FROM dl WHERE d <= -1e-12) AS losses, (SELECT count(*) FROM pf WHERE run_id IN (SELECT run_id FROM every) AND (own IS NULL OR base IS NULL)) AS missing, (SELECT count(*) FROM dl WHERE d <= -1e-12) = 0 AND (SELECT count(*) FROM dl WHERE d >= 1e-12) > 0 AS claim_ready FROM pf")
def preflight_totals(spark, d):
    """Fill, warnings and wins over all runs, and whether they bear a claim."""
    cells, m = _preflight(spark, d)
    return rp.preflight_totals(cells, m, ["run_id"]).withColumns({c: F.round(c, 6) for c in ("mean_fill", "min_fill")})


@query(f"WITH {_selections_sql(['naive', 'equal_budget', 'quality_judge'])}, n AS (SELECT run_id, count(*) FILTER (baseline = 'naive') AS a, count(*) FILTER (baseline = 'equal_budget') AS b, count(*) FILTER (baseline = 'quality_judge') AS c FROM chosen GROUP BY ALL) SELECT r.run_id, coalesce(nullif(a, 0), nullif(b, 0), nullif(c, 0)) AS budget FROM runs r LEFT JOIN n USING (run_id)")
def existing_budget(spark, d):
    """The budget that earlier selections of a run show: the first of three that isn't empty."""
    n = _selections(spark, d, ["naive", "equal_budget", "quality_judge"]).groupBy("run_id").pivot("baseline", ["naive", "equal_budget", "quality_judge"]).count()
    first = F.coalesce(*[F.nullif(c, F.lit(0)) for c in ("naive", "equal_budget", "quality_judge")])
    return table(spark, d, "runs").select("run_id").join(n, "run_id", "left").select("run_id", first.alias("budget"))


@query(f"WITH {_REPLAY} SELECT run_id, baseline, round(macro_f1 + 1e-9, 6) AS macro_f1 FROM res WHERE seed = 13 UNION ALL SELECT run_id, baseline, round(macro_f1 + 1e-9, 6) FROM res WHERE seed <> 13")
def union_seed_results(spark, d):
    """Results of the first seed with those of the others, rows without a metric left out."""
    r, _ = _replay(spark, d)
    one, other = r.filter("seed = 13"), r.filter("seed <> 13")
    return one.unionByName(other).filter(F.col("macro_f1").isNotNull()).select("run_id", "baseline", F.round(F.col("macro_f1") + 1e-9, 6).alias("macro_f1"))


_DELTA = f"{_REPLAY}, dl AS (SELECT r.run_id, r.baseline, r.macro_f1 - b.macro_f1 AS d FROM res r JOIN res b ON b.run_id = r.run_id AND b.baseline = 'heuristic' WHERE r.baseline <> 'heuristic'), mean AS (SELECT baseline, avg(m) AS mean FROM (SELECT baseline, seed, avg(macro_f1) AS m FROM res GROUP BY ALL) GROUP BY ALL)"


@query(f"WITH {_DELTA}, w AS (SELECT count(*) FILTER (d > 1e-12) AS wins, count(d) AS cells, coalesce(avg(d), 0) AS mean_delta FROM dl WHERE baseline = 'lark-7b') SELECT CASE WHEN cells > 0 AND wins >= 3 AND mean_delta > 0 AND (SELECT mean FROM mean WHERE baseline = 'lark-7b') > (SELECT mean FROM mean WHERE baseline = 'heuristic') THEN 'A' ELSE 'B' END AS story, wins, cells, round(mean_delta, 6) AS mean_delta FROM w")
def replay_decision(spark, d):
    """Whether a selector clearly beats the base: enough wins, by a positive mean, with a higher mean."""
    r, _ = _replay(spark, d)
    w = mt.wins(r, ["run_id"], "baseline", "macro_f1", "heuristic")
    return rp.decision(w, rp.seed_means(r), "lark-7b", "heuristic").withColumn("mean_delta", F.round("mean_delta", 6))


@query(f"WITH {_REPLAY}, n AS (SELECT baseline, avg(m) AS mean, coalesce(stddev_pop(m), 0) AS sd FROM (SELECT baseline, seed, avg(macro_f1) AS m FROM res GROUP BY ALL) GROUP BY ALL) SELECT 'audit:' || baseline || ':LC' AS claim_id, 'audit channels' AS paper_location, 'LC' AS metric, printf('%.4f', quality) AS value, 'audit' AS result_file, 'mean over candidates' AS computation FROM qual UNION ALL SELECT 'means:' || baseline || ':f1', 'selector means', 'macro_f1_mean', printf('%.4f', mean), 'results', 'mean over cells, then over seeds' FROM n UNION ALL SELECT 'means:' || baseline || ':sd', 'selector means', 'macro_f1_sd', printf('%.4f', sd), 'results', 'population sd over seeds' FROM n")
def paper_ledger(spark, d):
    """The six-column ledger of audit channels and selectors' means."""
    r, q = _replay(spark, d)
    m = rp.seed_means(r)
    claim = lambda a, b: F.concat(F.lit(a), F.col("baseline"), F.lit(b))
    rows = [rp.ledger_rows(q, claim("audit:", ":LC"), "audit channels", "LC", F.col("quality"), "audit", "mean over candidates")]
    rows.append(rp.ledger_rows(m, claim("means:", ":f1"), "selector means", "macro_f1_mean", F.col("mean"), "results", "mean over cells, then over seeds"))
    rows.append(rp.ledger_rows(m, claim("means:", ":sd"), "selector means", "macro_f1_sd", F.col("sd"), "results", "population sd over seeds"))
    return reduce(lambda a, b: a.unionByName(b), rows)


@query(f"WITH {_REPLAY} SELECT 'hf' AS kind, run_id::VARCHAR AS run_id, baseline, '' AS passing FROM res UNION ALL SELECT 'selection', run_id::VARCHAR, '', (count(*) FILTER (NOT hard_reject))::VARCHAR FROM scored GROUP BY run_id")
def sparse_rows(spark, d):
    """Results and selections in one sparse table, as a report writes them."""
    r, _ = _replay(spark, d)
    return sk.sparse_union(r.select(F.lit("hf").alias("kind"), "run_id", "baseline"), hard_reject_pool(spark, d).withColumn("kind", F.lit("selection"))).select("kind", "run_id", "baseline", "passing")


# --- planning


_GRID = "cells AS (SELECT m.dataset_id, m.task, m.language, b.budget, 3 AS multiplier, s.seed, 'b' || b.budget || '_m3_s' || s.seed AS slug FROM (SELECT DISTINCT dataset_id, task, language FROM manifest WHERE language IN ('hau', 'swa')) m, (SELECT unnest([32, 64]) AS budget) b, (SELECT unnest([13, 21]) AS seed) s)"


def _cells(spark, d):
    cfg = RunConfig(languages=["hau", "swa"], budgets=[32, 64], seeds=[13, 21], baselines=["gold_only", "audited"], output_dir="runs")
    cfg.judge.backend = "heuristic"
    return pl.expand(table(spark, d, "manifest"), cfg), cfg


_BASE = "'runs/plan/' || task || '/' || language || '/' || slug"
_STEPS = [
    ("make-seeds", f"'python -m siftline make-seeds --manifest data/manifest --dataset-id ' || dataset_id || ' --language ' || language || ' --budget ' || budget || ' --seed ' || seed || ' --out ' || {_BASE} || '/gold --sampling-strategy random'"),
    ("generate", f"'python -m siftline generate --config c.yaml --seed-file ' || {_BASE} || '/gold --out ' || {_BASE} || '/candidates --candidates-per-seed ' || multiplier || ' --resume'"),
    ("counterfactuals", f"'python -m siftline counterfactuals --config c.yaml --candidates ' || {_BASE} || '/candidates --out ' || {_BASE} || '/candidates_cf --resume'"),
    ("judge", f"'python -m siftline judge --config c.yaml --candidates ' || {_BASE} || '/candidates_cf --out ' || {_BASE} || '/candidates_judged --resume'"),
    ("audit", f"'python -m siftline audit --config c.yaml --manifest data/manifest --dataset-id ' || dataset_id || ' --language ' || language || ' --budget ' || budget || ' --seed ' || seed || ' --gold ' || {_BASE} || '/gold --candidates ' || {_BASE} || '/candidates_judged --out ' || {_BASE} || '/audit'"),
    ("evaluate", f"'python -m siftline evaluate --manifest data/manifest --dataset-id ' || dataset_id || ' --language ' || language || ' --gold ' || {_BASE} || '/gold --out ' || {_BASE} || '/results/gold_only'"),
    ("select", f"'python -m siftline select --config c.yaml --audit ' || {_BASE} || '/audit --gold ' || {_BASE} || '/gold --out ' || {_BASE} || '/selected/audited --multiplier ' || multiplier || ' --baseline audited --seed ' || seed"),
    ("evaluate", f"'python -m siftline evaluate --manifest data/manifest --dataset-id ' || dataset_id || ' --language ' || language || ' --gold ' || {_BASE} || '/gold --selected ' || {_BASE} || '/selected/audited --out ' || {_BASE} || '/results/audited'"),
]
_PLANNED = f"{_GRID}, planned AS (" + " UNION ALL ".join(f"SELECT dataset_id, task, language, slug, '{s}' AS stage, {i} AS step, {c} AS command FROM cells" for i, (s, c) in enumerate(_STEPS)) + ")"


@query(f"WITH {_PLANNED} SELECT * FROM planned")
def plan_commands(spark, d):
    """The commands of every cell of a grid, from seeds to evaluations."""
    cells, cfg = _cells(spark, d)
    return pl.commands(cells, cfg, "plan", "c.yaml")


@query(f"WITH {_PLANNED}, k AS (SELECT * FROM planned WHERE stage IN ('select', 'evaluate')) SELECT slug, dataset_id, language, step, command FROM k QUALIFY count(*) OVER (PARTITION BY dataset_id, language, slug) > 1")
def plan_phase(spark, d):
    """The commands of the selection phase."""
    cells, cfg = _cells(spark, d)
    return pl.phase(pl.commands(cells, cfg, "plan", "c.yaml"), "selection").select("slug", "dataset_id", "language", "step", "command")


@query(f"WITH {_GRID} SELECT dataset_id, language, slug, b.name AS baseline, 'train --manifest data/manifest --dataset-id ' || dataset_id || ' --language ' || language || ' --gold ' || {_BASE} || '/gold' || CASE WHEN b.name = 'gold_only' THEN '' ELSE ' --selected ' || {_BASE} || '/selected/' || b.name END || ' --out-dir ' || {_BASE} || '/hf/' || b.name || ' --model small --epochs 3 --batch-size 16 --max-length 256 --seed ' || seed || ' --deterministic' AS command FROM cells, (SELECT unnest(['gold_only', 'audited']) AS name) b")
def plan_training(spark, d):
    """The fine-tuning commands of every cell and baseline."""
    cells, cfg = _cells(spark, d)
    t = pl.training_commands(cells, cfg, "plan", "train", "small", "long", deterministic=True)
    return t.select("dataset_id", "language", "slug", F.element_at(F.array(*[F.lit(b) for b in cfg.baselines]), F.col("step") + 1).alias("baseline"), "command")


_ABLATED = {
    "full": ("u + 0.75::DOUBLE * c + 0.5::DOUBLE * d - l - 0.75::DOUBLE * h", "l <= 0.15::DOUBLE AND c >= 0.6::DOUBLE AND h <= 0.7::DOUBLE"),
    "no_leakage_filter": ("u + 0.75::DOUBLE * c + 0.5::DOUBLE * d - 0.75::DOUBLE * h", "c >= 0.6::DOUBLE AND h <= 0.7::DOUBLE"),
    "no_counterfactual_score": ("u + 0.5::DOUBLE * d - l - 0.75::DOUBLE * h", "l <= 0.15::DOUBLE AND h <= 0.7::DOUBLE"),
    "no_shortcut_score": ("u + 0.75::DOUBLE * c + 0.5::DOUBLE * d - l", "l <= 0.15::DOUBLE AND c >= 0.6::DOUBLE"),
    "no_diversity_score": ("u + 0.75::DOUBLE * c - l - 0.75::DOUBLE * h", "l <= 0.15::DOUBLE AND c >= 0.6::DOUBLE AND h <= 0.7::DOUBLE"),
    "no_class_balancing": ("u + 0.75::DOUBLE * c + 0.5::DOUBLE * d - l - 0.75::DOUBLE * h", "l <= 0.15::DOUBLE AND c >= 0.6::DOUBLE AND h <= 0.7::DOUBLE"),
    "hard_filter_only": ("0", "l <= 0.15::DOUBLE AND c >= 0.6::DOUBLE AND h <= 0.7::DOUBLE"),
    "soft_rank_only": ("u + 0.75::DOUBLE * c + 0.5::DOUBLE * d - l - 0.75::DOUBLE * h", "TRUE"),
}


@query(f"WITH {SCORED} " + " UNION ALL ".join(f"SELECT run_id, '{k}' AS ablation, count(*) FILTER ({p}) AS passed, round(avg({s}) FILTER ({p}), 6) AS mean_soft FROM scored GROUP BY run_id" for k, (s, p) in _ABLATED.items()))
def ablations(spark, d):
    """Each ablation's gate and mean score over the rows that pass it, from one pass over the scored candidates."""
    from dataclasses import replace

    parts = []
    for name, change in pl.ABLATIONS.items():
        cfg = replace(CFG, **{k: v for k, v in change.items() if k != "quotas"})
        ok = sc.passes(cfg, cfg.tau_c)
        parts.append(F.struct(F.lit(name).alias("ablation"), ok.alias("ok"), sc.soft_score(cfg).alias("soft")))
    rows = scored(spark, d).select("run_id", F.explode(F.array(*parts)).alias("x"))
    return rows.groupBy("run_id", "x.ablation").agg(F.count_if("x.ok").alias("passed"), F.round(F.avg(F.when(F.col("x.ok"), F.col("x.soft"))), 6).alias("mean_soft"))


@query(f"WITH {SCORED}, e AS (SELECT run_id, 'candidates' AS name FROM runs UNION ALL SELECT run_id, 'audit' FROM runs), f AS (SELECT run_id, 'candidates' AS name, count(*) AS rows FROM cand GROUP BY ALL UNION ALL SELECT run_id, 'audit', count(*) FROM scored GROUP BY ALL) SELECT run_id, name, coalesce(rows, 0) AS rows, coalesce(rows, 0) >= 1 AS ok FROM e LEFT JOIN f USING (run_id, name)")
def input_checks(spark, d):
    """Whether every run has the candidates and audits that a replay needs."""
    runs = table(spark, d, "runs").select("run_id")
    named = lambda rows, n: rows.withColumn("name", F.lit(n))
    expected = named(runs, "candidates").unionByName(named(runs, "audit"))
    count = lambda rows: rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("rows"))
    return pl.checks(expected, named(count(candidates(spark, d)), "candidates").unionByName(named(count(scored(spark, d)), "audit")), ["run_id", "name"])


@query("WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\r?\\n')) AS t, unnest(range(1, len(regexp_split_to_array(text, '\\r?\\n')) + 1)) AS line FROM documents WHERE text IS NOT NULL) SELECT doc_id, line, 'radio' AS rule FROM l WHERE regexp_matches(t, '(?i)radio') UNION ALL SELECT doc_id, line, 'year' FROM l WHERE regexp_matches(t, '[^0-9][12][0-9]{3}[^0-9]')")
def phrase_lint(spark, d):
    """Lines of documents that match one of two rules."""
    return pl.lint(table(spark, d, "documents"), "doc_id", "text", {"radio": "(?i)radio", "year": "[^0-9][12][0-9]{3}[^0-9]"}).select("doc_id", F.col("line").cast("bigint").alias("line"), "rule")
