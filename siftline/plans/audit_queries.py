"""Queries of leakage, shortcut, gate, rank, selection and sampling operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions.text import token_ngrams, tokens
from siftline.operators import leakage as lk
from siftline.operators import scoring as sc
from siftline.operators import selection as sel
from siftline.operators import shortcut as sh
from siftline.operators.config import AuditConfig
from siftline.operators.grouping import quality_order, rank_in_groups, top_k
from siftline.plans.views import AUDITED, CANDIDATES, CELL, SCORED, audited, candidates, gold, query, scored, table

CFG = AuditConfig()
GRAMS = r"""toks AS (SELECT candidate_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]') AS t FROM cand WHERE text IS NOT NULL),
held AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]') AS t FROM benchmark WHERE text IS NOT NULL)"""


def _gram(table: str, key: str, n: int, name: str) -> str:
    return f"{name} AS (SELECT DISTINCT {key}, array_to_string(t[i:i + {n - 1}], chr(1)) AS g FROM (SELECT {key}, t, unnest(range(1, len(t) - {n - 2})) AS i FROM {table} WHERE len(t) >= {n}))"


_LEAK = f"""WITH {CANDIDATES}, {GRAMS}, {_gram('toks', 'candidate_id', 10, 'c10')}, {_gram('held', 'item_id', 10, 'h10')}, {_gram('toks', 'candidate_id', 5, 'c5')}, {_gram('held', 'item_id', 5, 'h5')},
ex AS (SELECT DISTINCT candidate_id, 1.0::DOUBLE AS exact FROM c10 WHERE g IN (SELECT g FROM h10)),
na AS (SELECT candidate_id, count(*) AS a FROM c5 GROUP BY ALL), nb AS (SELECT item_id, count(*) AS b FROM h5 GROUP BY ALL),
sh AS (SELECT candidate_id, item_id, count(*) AS n FROM c5 JOIN h5 USING (g) GROUP BY ALL),
ja AS (SELECT candidate_id, max(n::DOUBLE / (a + b - n)) AS jaccard FROM sh JOIN na USING (candidate_id) JOIN nb USING (item_id) GROUP BY ALL),
leak AS (SELECT candidate_id, coalesce(exact, 0) AS exact, coalesce(jaccard, 0) AS jaccard, greatest(coalesce(exact, 0), coalesce(jaccard, 0)) AS l FROM cand LEFT JOIN ex USING (candidate_id) LEFT JOIN ja USING (candidate_id))
"""


def _texts(spark, d):
    return candidates(spark, d), table(spark, d, "benchmark")


@query(f"WITH {CANDIDATES}, {GRAMS}, {_gram('toks', 'candidate_id', 10, 'c10')}, {_gram('toks', 'candidate_id', 5, 'c5')} SELECT candidate_id, (SELECT count(*) FROM c10 WHERE c10.candidate_id = cand.candidate_id) AS n10, (SELECT count(*) FROM c5 WHERE c5.candidate_id = cand.candidate_id) AS n5 FROM cand")
def ngram_set_sizes(spark, d):
    t = candidates(spark, d).select("candidate_id", tokens(F.col("text")).alias("t"))
    return t.select("candidate_id", *[F.size(token_ngrams(F.col("t"), n)).cast("bigint").alias(f"n{n}") for n in (10, 5)])


@query(_LEAK + "SELECT candidate_id FROM ex")
def leakage_exact_ngram(spark, d):
    c, b = _texts(spark, d)
    return lk.exact_ngram(c, "candidate_id", "text", b, "text")


@query(_LEAK + "SELECT candidate_id, round(jaccard, 6) AS jaccard FROM ja")
def leakage_max_jaccard(spark, d):
    c, b = _texts(spark, d)
    return lk.max_jaccard(c, "candidate_id", "text", b, "item_id", "text").withColumn("jaccard", F.round("jaccard", 6))


@query(_LEAK + "SELECT candidate_id, exact, round(jaccard, 6) AS jaccard, round(l, 6) AS l, l > 0.15::DOUBLE AS rejected FROM leak")
def leakage_score_gate(spark, d):
    """The leakage of every candidate by n-grams, with the gate's decision; the embedding part is in ``audit_scores``."""
    c, b = _texts(spark, d)
    l = lk.leakage(c, "candidate_id", "text", b, "item_id", "text")
    return l.select("candidate_id", "exact", F.round("jaccard", 6).alias("jaccard"), F.round("l", 6).alias("l"), (F.col("l") > CFG.tau_l).alias("rejected"))


_FEATURES = r"""labs AS (SELECT run_id, list(DISTINCT lower(label)) AS ls FROM cand WHERE label IS NOT NULL AND label <> '' GROUP BY ALL),
body AS (SELECT c.candidate_id, c.run_id, coalesce(text, '') AS t, lower(coalesce(text, '')) AS low, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+') AS w, ls FROM cand c LEFT JOIN labs USING (run_id)),
feat AS (SELECT candidate_id, run_id, len(w) AS length, coalesce(len(list_filter(ls, lambda x: contains(low, x))) > 0, FALSE) AS label_word,
  contains(low, '[variant') OR contains(low, 'counterfactual label cue') AS template,
  len(list_filter(w, lambda x: regexp_matches(x, '^\p{Lu}')))::DOUBLE / greatest(len(w), 1) AS names,
  len(regexp_extract_all(t, '[!?.,;:]'))::DOUBLE / greatest(length(t), 1) AS punctuation FROM body)"""


def _features(spark, d):
    return sh.artifact_features(candidates(spark, d).select("candidate_id", "run_id", "text", "label"), "run_id", "text", "label")


@query(f"WITH {CANDIDATES}, {_FEATURES} SELECT candidate_id, length, label_word, template, round(names, 6) AS names, round(punctuation, 6) AS punctuation FROM feat")
def artifact_features(spark, d):
    f = _features(spark, d)
    return f.select("candidate_id", "length", "label_word", "template", F.round("names", 6).alias("names"), F.round("punctuation", 6).alias("punctuation"))


@query(f"""WITH {CANDIDATES}, {_FEATURES}, pool AS (SELECT run_id, avg(length) AS m, greatest(stddev_pop(length), 1) AS sd FROM feat GROUP BY ALL)
SELECT candidate_id, round(greatest(0, least(1, 0.35::DOUBLE * label_word::INT + 0.30::DOUBLE * template::INT + 0.20::DOUBLE * least(1, abs(length - m) / sd / 3) + 0.10::DOUBLE * names + 0.05::DOUBLE * least(1, 10 * punctuation))), 6) AS h FROM feat JOIN pool USING (run_id)""")
def shortcut_score(spark, d):
    """How far a text gives its label away by form; length is measured against its run's mean and spread."""
    return sh.shortcut_score(_features(spark, d), "run_id").select("candidate_id", F.round("h", 6).alias("h"))


# a missing score counts as 0, and NaN passes every gate
_UNDER = "(coalesce({x}, 0) <= {t}::DOUBLE OR coalesce(isnan({x}), FALSE))"
_STRICT, _RELAXED, _SOFT = (f"({_UNDER.format(x='l', t=0.15)} AND {_UNDER.format(x='h', t=0.7)}{c})" for c in (" AND coalesce(c, 0) >= 0.6::DOUBLE", " AND coalesce(c, 0) >= 0.45::DOUBLE", ""))
_GATES = {"strict": (CFG.tau_c, _STRICT), "relaxed": (CFG.relaxed_tau_c, _RELAXED), "soft": (None, _SOFT)}
for _name, (_tau, _sql) in _GATES.items():
    query(f"WITH {AUDITED} SELECT candidate_id FROM scored WHERE {_sql}", f"gate_{_name}")(lambda spark, d, t=_tau: audited(spark, d).filter(sc.passes(CFG, t)).select("candidate_id"))


@query(f"WITH {AUDITED} SELECT candidate_id, array_to_string(list_filter([CASE WHEN NOT {_UNDER.format(x='l', t=0.15)} THEN 'leakage' END, CASE WHEN coalesce(c, 0) < 0.6::DOUBLE THEN 'counterfactual' END, CASE WHEN NOT {_UNDER.format(x='h', t=0.7)} THEN 'shortcut' END], lambda x: x IS NOT NULL), ',') AS reasons FROM scored")
def reject_reasons(spark, d):
    return audited(spark, d).select("candidate_id", F.array_join(sc.reject_reasons(CFG), ",").alias("reasons"))


@query(f"WITH {SCORED} SELECT candidate_id, round(u + 0.75::DOUBLE * c + 0.5::DOUBLE * d - l - 0.75::DOUBLE * h, 6) AS soft FROM scored")
def soft_score(spark, d):
    return scored(spark, d).select("candidate_id", F.round(sc.soft_score(CFG), 6).alias("soft"))


def _j(name: str, path: str) -> str:
    raw = f"json_extract_string(CASE WHEN json_valid(metadata) THEN metadata END, '$.{path}')"
    return f"CASE WHEN {raw} IS NOT NULL THEN coalesce(try_cast({raw} AS DOUBLE), 0) END AS {name}"


_NAMES = {"lc0": "label_correctness", "fl0": "fluency", "cu0": "cultural_plausibility", "ls0": "leakage_suspicion", "cv0": "counterfactual_validity", "q0": "quality_score"}
_JUDGED = AUDITED + ", judged AS (SELECT *, " + ", ".join(_j(a, b) for a, b in [*((k, f"llm_judge.{v}") for k, v in _NAMES.items()), ("js0", "judge_score"), ("inf0", "influence_score")]) + " FROM scored)"
_B = lambda x: f"greatest(0, least(1, coalesce({x}, 0)))"
_RERANK = (
    _JUDGED
    + f""", parts AS (SELECT *, {_B('coalesce(u, q0)')} AS xu, {_B('coalesce(l, ls0)')} AS xl, {_B('h')} AS xh, {_B('coalesce(c, cv0)')} AS xc, {_B('d')} AS xd FROM judged),
parts2 AS (SELECT *, {_B('coalesce(q0, xu)')} AS xq, {_B('coalesce(lc0, xu)')} AS xlc, {_B('coalesce(ls0, xl)')} AS xls FROM parts),
parts3 AS (SELECT *, {_B('coalesce(fl0, xq)')} AS xf, {_B('coalesce(cu0, xq)')} AS xcu FROM parts2),
rerank AS (SELECT *, 1.25::DOUBLE * xlc + 0.85::DOUBLE * xq + 0.45::DOUBLE * xf + 0.35::DOUBLE * xcu + 0.35::DOUBLE * xu + 0.65::DOUBLE * xc + 0.45::DOUBLE * xd
  + CASE WHEN {_STRICT} THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN {_RELAXED} THEN 0.1::DOUBLE ELSE 0 END
  - (1.4::DOUBLE * xl + xh + 1.1::DOUBLE * xls + 0.55::DOUBLE * greatest(0, 0.6::DOUBLE - xc) + 0.45::DOUBLE * greatest(0, xl - 0.15::DOUBLE) + 0.35::DOUBLE * greatest(0, xh - 0.7::DOUBLE)) AS v2 FROM parts3)"""
)
_WORDS = r"len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\p{Z}\x1c-\x1f\x{85}]+'), lambda w: w <> ''))"


def _random(seed: int) -> str:
    return f"('0x' || substr(md5('{seed}|' || candidate_id), 1, 12))::BIGINT::DOUBLE"


_RANK_SQL = {
    "audited": "coalesce(s, 0)", "audited_hard": "coalesce(s, 0)", "audited_relaxed": "coalesce(s, 0)", "audited_soft": "coalesce(s, 0)",
    "equal_budget": "CASE WHEN hard_reject THEN 0 ELSE 100 END + coalesce(s, 0)",
    "rerank_v2": "v2", "quality_only": "coalesce(u, 0)", "diversity_only": "coalesce(d, 0)",
    "quality_judge": "coalesce(js0, q0, u, 0)", "quality_judge_hardreject": "coalesce(js0, q0, u, 0)",
    "quality_diversity": f"0.45::DOUBLE * coalesce(q0, u, 0) + 0.35::DOUBLE * coalesce(d, 0) + 0.2::DOUBLE * least(1, {_WORDS} / 256::DOUBLE)",
    "influence_style": "coalesce(inf0, coalesce(u, 0) + 0.25::DOUBLE * coalesce(d, 0))",
    "naive": _random(13), "random": _random(13 + 7919),
}
_POOL_SQL = {"all": "TRUE"} | {k: v[1] for k, v in _GATES.items()}


def _ranked_sql(b: str) -> str:
    return f"""{_RERANK}, pool AS (SELECT *, round({_RANK_SQL[b]}, 9) AS score FROM rerank WHERE {_POOL_SQL[sc.POOLS[b]]}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN score IS NULL OR isnan(score) THEN 1 ELSE 0 END, score DESC, candidate_id) AS place FROM pool)"""


def pool(spark, d, b: str):
    """A baseline's pool with the score that ranks it."""
    rows = sc.with_judgement(audited(spark, d)).filter(sc.pool_filter(b, CFG))
    return rows.withColumn("score", F.round(sc.rank_score(b, CFG), 9))


def best(spark, d, b: str, budget: int | None = None):
    """The first rows of a baseline's ranking by run, as ``rank``."""
    return top_k(pool(spark, d, b), ["run_id"], quality_order("score"), F.lit(budget or BUDGET), "candidate_id")


def _rank(spark, d, b: str):
    return rank_in_groups(pool(spark, d, b).select("run_id", "candidate_id", "score"), ["run_id"], "score", "candidate_id").select("run_id", "candidate_id", F.col("rank").cast("bigint").alias("place"))


_CAPS_SQL = """caps0 AS (SELECT task, label, count(*) AS n, min(id) AS first FROM gold WHERE label IS NOT NULL AND id IS NOT NULL GROUP BY ALL),
caps1 AS (SELECT *, greatest(1, round_even({B} * n / sum(n) OVER (PARTITION BY task), 0)::INT) AS cap0, count(*) OVER (PARTITION BY task) AS labels, row_number() OVER (PARTITION BY task ORDER BY n DESC, first) AS k FROM caps0),
caps2 AS (SELECT *, {B} - sum(cap0) OVER (PARTITION BY task) AS diff FROM caps1),
caps AS (SELECT task, label, n, greatest(0, cap0 + CASE WHEN diff = 0 THEN 0 ELSE sign(diff) * greatest(0, floor((abs(diff) - k) / labels::DOUBLE) + 1) END)::INT AS cap FROM caps2)"""
BUDGET, SOURCE_CAP = 32, 3
_CAPS = _CAPS_SQL.replace("{B}", str(BUDGET))


def _caps(spark, d):
    return sel.quota_caps(gold(spark, d), ["task"], "label", "id", BUDGET)


@query(f"WITH {_CAPS} SELECT task, label, n, cap FROM caps")
def quota_caps(spark, d):
    return _caps(spark, d)


def _run_caps(spark, d):
    """The quotas of each run: those of its task."""
    return table(spark, d, "runs").select("run_id", "task").join(_caps(spark, d), "task").select("run_id", "label", "cap")


_RUN_CAPS = f"{_CAPS}, quota AS (SELECT runs.run_id, caps.label, caps.cap FROM runs JOIN caps USING (task))"


def _by_gold_label(spark, d, rows):
    """Rows with the label of their first seed, where it is spelled as in gold; then every source has one label."""
    g = gold(spark, d).select(F.col("id").alias("source"), F.col("label").alias("_gold"))
    return rows.join(g, "source", "left").withColumn("label", F.col("_gold")).drop("_gold")


for _b in sc.POOLS:
    query(f"WITH {_ranked_sql(_b)} SELECT run_id, candidate_id, place FROM ranked", f"rank_{_b}")(lambda spark, d, b=_b: _rank(spark, d, b))

    def _laminar(spark, d, b=_b):
        rows = _by_gold_label(spark, d, pool(spark, d, b))
        return sel.laminar_take(rows, _run_caps(spark, d), ["run_id"], "label", "source", "score", "candidate_id", SOURCE_CAP, BUDGET).select("run_id", "candidate_id", F.col("rank").cast("bigint").alias("place"))

    query(f"""WITH {_ranked_sql(_b)}, {_RUN_CAPS}, a AS (SELECT r.* EXCLUDE (label), coalesce(g.label, 'None') AS lab FROM ranked r LEFT JOIN gold g ON g.id = r.source QUALIFY r.source IS NULL OR row_number() OVER (PARTITION BY run_id, source ORDER BY place) <= {SOURCE_CAP}),
b AS (SELECT a.*, row_number() OVER (PARTITION BY a.run_id, lab ORDER BY place) > coalesce(q.cap, {BUDGET}) AS late FROM a LEFT JOIN quota q ON q.run_id = a.run_id AND q.label = lab),
c AS (SELECT run_id, candidate_id, row_number() OVER (PARTITION BY run_id ORDER BY late, place) AS p FROM b)
SELECT run_id, candidate_id, p AS place FROM c WHERE p <= {BUDGET}""", f"select_laminar_{_b}")(_laminar)  # fmt: skip


@query(f"""WITH {_ranked_sql('audited')}, a AS (SELECT * FROM ranked QUALIFY source IS NULL OR row_number() OVER (PARTITION BY run_id, source ORDER BY place) <= {SOURCE_CAP})
SELECT run_id, candidate_id, p AS place FROM (SELECT run_id, candidate_id, row_number() OVER (PARTITION BY run_id ORDER BY place) AS p FROM a) WHERE p <= {BUDGET}""")
def select_source_capped(spark, d):
    return sel.source_capped(pool(spark, d, "audited"), ["run_id"], "source", "score", "candidate_id", SOURCE_CAP, BUDGET).select("run_id", "candidate_id", F.col("rank").cast("bigint").alias("place"))


def _greedy_sql(b: str) -> str:
    """The walk as a recursion over each run's ranked rows, twice: within quotas, then without; lists carry what was taken."""
    used = "len(list_filter({lst}, lambda y: y = {x}))"
    fits = f"len(list_filter(c.seeds, lambda x: {used.format(lst='w.srcs', x='x')} >= {SOURCE_CAP})) = 0"
    take = f"(len(w.taken) < {BUDGET} AND {fits} AND CASE WHEN w.pos < w.n THEN {used.format(lst='w.labs', x='c.lab')} < c.cap ELSE NOT list_contains(w.taken, c.place) END)"
    return f"""WITH RECURSIVE {_ranked_sql(b)}, {_RUN_CAPS},
c AS (SELECT r.run_id, r.candidate_id, r.place, coalesce(r.label, 'None') AS lab, list_distinct(list_filter(coalesce(r.seeds, []), lambda x: x IS NOT NULL)) AS seeds, coalesce(q.cap, {BUDGET}) AS cap FROM ranked r LEFT JOIN quota q ON q.run_id = r.run_id AND q.label = coalesce(r.label, 'None')),
w AS (SELECT run_id, 0::BIGINT AS pos, count(*) AS n, []::BIGINT[] AS taken, []::VARCHAR[] AS labs, []::VARCHAR[] AS srcs FROM c GROUP BY run_id
  UNION ALL
  SELECT w.run_id, w.pos + 1, w.n, CASE WHEN {take} THEN list_append(w.taken, c.place) ELSE w.taken END,
    CASE WHEN {take} AND w.pos < w.n THEN list_append(w.labs, c.lab) ELSE w.labs END, CASE WHEN {take} THEN list_concat(w.srcs, c.seeds) ELSE w.srcs END
  FROM w JOIN c ON c.run_id = w.run_id AND c.place = w.pos % w.n + 1 WHERE w.pos < 2 * w.n AND len(w.taken) < {BUDGET}),
last AS (SELECT run_id, taken FROM w QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY pos DESC) = 1)
SELECT c.run_id, c.candidate_id, list_position(l.taken, c.place)::INT AS rank FROM last l JOIN c ON c.run_id = l.run_id AND list_contains(l.taken, c.place)"""


@query(_greedy_sql("rerank_v2"))
def select_greedy_general(spark, d):
    """The take in general, over all seeds of a candidate."""
    return sel.greedy_take(pool(spark, d, "rerank_v2"), _run_caps(spark, d), ["run_id"], "label", "seeds", "score", "candidate_id", SOURCE_CAP, BUDGET)


for _b, _seed in (("naive", 13), ("random", 13 + 7919)):
    query(f"WITH {SCORED} SELECT run_id, candidate_id FROM scored QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY md5('{_seed}|' || candidate_id), candidate_id) <= {BUDGET}", f"select_{_b}")(
        lambda spark, d, s=_seed: sel.sample_flat(scored(spark, d), ["run_id"], "candidate_id", BUDGET, s).select("run_id", "candidate_id")
    )

_GOLD = "g AS (SELECT *, md5('13|' || id) AS o FROM gold WHERE id IS NOT NULL)"


@query(f"WITH {_GOLD} SELECT id FROM g QUALIFY row_number() OVER (PARTITION BY dataset_id, language ORDER BY o, id) <= 20")
def sample_flat(spark, d):
    return sel.sample_flat(gold(spark, d), CELL, "id", 20, 13).select("id")


@query(f"""WITH {_GOLD}, k AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, language, label ORDER BY o, id) AS k FROM g WHERE label IS NOT NULL)
SELECT id FROM k QUALIFY row_number() OVER (PARTITION BY dataset_id, language ORDER BY k, label) <= 20""")
def sample_balanced(spark, d):
    return sel.sample_balanced(gold(spark, d), CELL, "label", "id", 20, 13).select("id")


@query(f"""WITH {_GOLD}, k AS (SELECT * EXCLUDE (label), coalesce(label, 'None') AS label, row_number() OVER (PARTITION BY dataset_id, language, coalesce(label, 'None') ORDER BY o, id) AS k FROM g),
n AS (SELECT dataset_id, language, label, count(*) AS n FROM k GROUP BY ALL),
n2 AS (SELECT *, min(n) OVER c AS least_n, row_number() OVER (PARTITION BY dataset_id, language ORDER BY label) AS i, count(*) OVER c AS labels, least(n, greatest(1, round_even(20 * n / sum(n) OVER c, 0)::INT)) AS share FROM n WINDOW c AS (PARTITION BY dataset_id, language)),
n3 AS (SELECT *, greatest(0, 20 - coalesce(sum(share) OVER (PARTITION BY dataset_id, language ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS remaining FROM n2),
n4 AS (SELECT *, CASE WHEN least_n >= 20 THEN 20 WHEN i = labels THEN remaining WHEN remaining > 0 THEN least(share, remaining) ELSE 1 END AS take FROM n3),
r AS (SELECT k.*, n4.take, n4.least_n FROM k JOIN n4 USING (dataset_id, language, label)),
p AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, language ORDER BY k > take, o, id) AS p FROM r)
SELECT id FROM p WHERE (least_n >= 20 AND k <= take) OR (least_n < 20 AND p <= 20)""")
def sample_per_class(spark, d):
    return sel.sample_per_class(gold(spark, d), CELL, "label", "id", 20, 13).select("id")


def _influence(up: bool):
    def f(spark, d):
        rows = scored(spark, d).withColumn("score", F.col("u") if up else -F.col("u"))
        return top_k(rows, ["run_id"], quality_order("score"), F.lit(BUDGET), "candidate_id").select("run_id", "candidate_id")

    return f


for _n, _up in (("topk", True), ("bottomk", False)):
    query(f"WITH {SCORED} SELECT run_id, candidate_id FROM scored QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY u {'DESC' if _up else 'ASC'}, candidate_id) <= {BUDGET}", f"influence_{_n}")(_influence(_up))


@query(f"""WITH {SCORED}, {_CAPS}, r AS (SELECT s.*, coalesce(c.cap, {BUDGET}) AS cap, row_number() OVER (PARTITION BY s.run_id, coalesce(s.label, 'None') ORDER BY u DESC, candidate_id) AS k
  FROM scored s JOIN runs USING (run_id) LEFT JOIN caps c ON c.task = runs.task AND c.label = s.label)
SELECT run_id, candidate_id FROM r QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY k > cap, u DESC, candidate_id) <= {BUDGET}""")
def influence_balanced(spark, d):
    """The most influential rows within label quotas, filled up without them; no source cap."""
    rows = scored(spark, d).withColumn("_own", F.col("candidate_id"))
    return sel.laminar_take(rows, _run_caps(spark, d), ["run_id"], "label", "_own", "u", "candidate_id", 1, BUDGET).select("run_id", "candidate_id")
