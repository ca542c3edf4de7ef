"""Queries of vector, metric, statistic and pool operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions.text import WORD
from siftline.operators import metrics as mt
from siftline.operators import vectors as vc
from siftline.plans.audit_queries import BUDGET, _ranked_sql, best
from siftline.plans.views import CANDIDATES, SCORED, candidates, query, scored, table

_E = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
m AS (SELECT label, p, avg(x) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM e WHERE vec_id % 5 <> 0) GROUP BY ALL),
cen AS (SELECT label, p, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM m),
cv AS (SELECT label, list(x ORDER BY p) AS c FROM cen GROUP BY ALL),
lo AS (SELECT e.vec_id, e.label AS truth, cv.label AS class, list_cosine_similarity(e.v, cv.c) AS cos FROM e CROSS JOIN cv),
pr AS (SELECT vec_id, truth, class, cos, exp((cos - max(cos) OVER w) / {T}) / sum(exp((cos - mx) / {T})) OVER w AS p FROM (SELECT *, max(cos) OVER (PARTITION BY vec_id) AS mx FROM lo) WINDOW w AS (PARTITION BY vec_id))"""
_T = _E.replace("{T}", "0.25::DOUBLE")
_T1 = _E.replace("{T}", "1.0::DOUBLE")


def _fit(spark, d):
    e = table(spark, d, "embeddings")
    return e, vc.centroids(e.filter("vec_id % 5 <> 0"), "label", "embedding")


def _proba(spark, d, t=0.25):
    e, c = _fit(spark, d)
    return e, vc.class_probabilities(e, "vec_id", "embedding", c, "label", t)


@query(f"WITH {_T} SELECT label, p - 1 AS position, round(x, 6) AS value FROM cen")
def centroids(spark, d):
    return _fit(spark, d)[1].select("label", F.col("position").cast("bigint").alias("position"), F.round("value", 6).alias("value"))


@query(f"WITH {_T} SELECT vec_id, class, round(p, 6) AS p FROM pr")
def teacher_proba(spark, d):
    return _proba(spark, d)[1].select("vec_id", "class", F.round("p", 6).alias("p"))


@query(f"WITH {_T} SELECT vec_id, class FROM pr QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(p, 9) DESC, class) = 1")
def teacher_argmax(spark, d):
    p = _proba(spark, d)[1]
    return p.groupBy("vec_id").agg(F.min_by("class", F.struct(-F.round("p", 9), "class")).alias("class"))


@query(f"WITH {_T} SELECT vec_id, round(p, 6) AS confidence FROM pr WHERE class = truth")
def teacher_confidence(spark, d):
    e, p = _proba(spark, d)
    own = p.join(e.select("vec_id", F.col("label").alias("class")), ["vec_id", "class"])
    return own.select("vec_id", F.round("p", 6).alias("confidence"))


_NEAR = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
nn AS (SELECT q.vec_id AS query, q.label AS ql, r.vec_id AS key, r.label AS rl, round(list_cosine_similarity(q.v, r.v), 9) AS cos FROM e q JOIN e r ON q.vec_id % 50 = 0 AND r.vec_id <> q.vec_id),
top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cos DESC, key) AS place FROM nn QUALIFY place <= 5)"""


def _nearest(spark, d, k=5):
    e = table(spark, d, "embeddings")
    return e, vc.nearest(e.filter("vec_id % 50 = 0"), e, "vec_id", "embedding", k)


@query(f"WITH {_NEAR} SELECT query AS vec_id, avg((ql = rl)::INT) AS vote FROM top GROUP BY ALL")
def knn_vote(spark, d):
    """The share of the five nearest with the query's label; queries are the rows whose id 50 divides, against all."""
    e, n = _nearest(spark, d)
    label = e.select("vec_id", "label")
    j = n.join(label.select(F.col("vec_id").alias("query"), F.col("label").alias("ql")), "query").join(label.select(F.col("vec_id").alias("key"), F.col("label").alias("rl")), "key")
    return j.groupBy(F.col("query").alias("vec_id")).agg(F.avg((F.col("ql") == F.col("rl")).cast("double")).alias("vote"))


@query(f"WITH {_NEAR} SELECT query AS vec_id, round(greatest(0, least(1, 1 - cos)), 6) AS diversity, round(greatest(0, (cos - 0.85::DOUBLE) / 0.15::DOUBLE), 6) AS leakage FROM top WHERE place = 1")
def diversity_and_embedding_leakage(spark, d):
    """One less the largest cosine, and how far that is beyond the leakage threshold."""
    n = _nearest(spark, d, 1)[1]
    return n.select(F.col("query").alias("vec_id"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("cosine"))), 6).alias("diversity"), F.round(F.greatest(F.lit(0.0), (F.col("cosine") - 0.85) / (1 - 0.85)), 6).alias("leakage"))


_PRED = f"{_T1}, pred AS (SELECT vec_id, truth, class, p, (class = truth) AS hit FROM pr WHERE vec_id % 5 = 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(p, 9) DESC, class) = 1)"


@query(f"""WITH {_PRED}, l AS (SELECT truth AS label FROM pred UNION SELECT class FROM pred),
f AS (SELECT label, (SELECT count(*) FROM pred WHERE truth = label AND class = label) AS tp, (SELECT count(*) FROM pred WHERE truth = label) + (SELECT count(*) FROM pred WHERE class = label) AS s FROM l),
b AS (SELECT least(9, floor(p * 10)) AS b, count(*) AS n, avg(hit::INT) AS a, avg(p) AS c FROM pred GROUP BY ALL)
SELECT round((SELECT avg(2 * tp / s::DOUBLE) FROM f), 6) AS macro_f1, round((SELECT avg(hit::INT) FROM pred), 6) AS accuracy, round((SELECT sum(n * abs(a - c)) / sum(n) FROM b), 6) AS ece""")
def centroid_eval(spark, d):
    """Macro-F1, accuracy and calibration error of the centroid classifier on held-out vectors."""
    e, p = _proba(spark, d, 1.0)
    best = p.groupBy("vec_id").agg(F.min_by(F.struct("class", "p"), F.struct(-F.round("p", 9), "class")).alias("b")).select("vec_id", "b.class", "b.p")
    pred = e.filter("vec_id % 5 = 0").select("vec_id", "label").join(best, "vec_id")
    f1 = mt.macro_f1(pred, "label", "class")
    ece = mt.calibration_error(pred.withColumn("hit", F.col("label") == F.col("class")), "p", "hit")
    return f1.join(ece, F.lit(True)).select(*[F.round(c, 6).alias(c) for c in ("macro_f1", "accuracy", "ece")])


_TAGS = r"""w AS (SELECT 'train' AS part, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS w FROM gold WHERE text IS NOT NULL UNION ALL SELECT 'test', unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) FROM benchmark WHERE text IS NOT NULL),
t AS (SELECT part, lower(w) AS w, CASE WHEN regexp_matches(w, '^[A-Z]') THEN 'N' ELSE 'O' END AS tag FROM w),
maj AS (SELECT w, tag FROM (SELECT w, tag, count(*) AS n FROM t WHERE part = 'train' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY w ORDER BY n DESC, tag) = 1)"""


def _tags(spark, d):
    words = lambda n: table(spark, d, n).select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("w")).select(F.lower("w").alias("w"), F.when(F.col("w").rlike("^[A-Z]"), "N").otherwise("O").alias("tag"))
    n = words("gold").groupBy("w", "tag").count()
    return words("benchmark"), n.groupBy("w").agg(F.min_by("tag", F.struct(-F.col("count"), "tag")).alias("guess"))


@query(f"WITH {_TAGS} SELECT w, tag AS guess FROM maj")
def majority_tag(spark, d):
    return _tags(spark, d)[1]


@query(f"""WITH {_TAGS}, j AS (SELECT t.tag AS g, coalesce(maj.tag, 'O') AS p FROM t LEFT JOIN maj USING (w) WHERE part = 'test'),
n AS (SELECT count(*) FILTER (g = p AND g <> 'O') AS tp, count(*) FILTER (g <> p AND p <> 'O') AS fp, count(*) FILTER (g <> p AND g <> 'O') AS fn FROM j)
SELECT tp, fp, fn, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1 FROM n""")
def tag_micro_f1(spark, d):
    """Micro-F1 of remembered majority tags on held-out words; unseen words get no tag."""
    test, maj = _tags(spark, d)
    j = test.join(maj, "w", "left").withColumn("p", F.coalesce("guess", F.lit("O")))
    g, p = F.col("tag"), F.col("p")
    n = j.agg(F.count_if((g == p) & (g != "O")).alias("tp"), F.count_if((g != p) & (p != "O")).alias("fp"), F.count_if((g != p) & (g != "O")).alias("fn"))
    return n.withColumn("f1", F.round(F.coalesce(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), F.lit(0.0)), 6))


@query(f"""WITH {_NEAR}, words AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS w FROM documents WHERE text IS NOT NULL)
SELECT query AS vec_id, round(coalesce(len(list_intersect(a.w, b.w))::DOUBLE / nullif(len(list_distinct(list_concat(a.w, b.w))), 0), 0), 6) AS jaccard FROM top JOIN words a ON a.doc_id = query JOIN words b ON b.doc_id = key WHERE place = 1""")
def summary_retrieval_jaccard(spark, d):
    """Overlap of the words of a query's text with those of its nearest row's, where both have a document."""
    n = _nearest(spark, d, 1)[1]
    w = table(spark, d, "documents").filter(F.col("text").isNotNull()).select("doc_id", F.array_distinct(F.filter(F.split("text", r"[ \t\n\f\r]+"), lambda x: x != "")).alias("w"))
    j = n.join(w.select(F.col("doc_id").alias("query"), F.col("w").alias("a")), "query").join(w.select(F.col("doc_id").alias("key"), F.col("w").alias("b")), "key")
    score = F.size(F.array_intersect("a", "b")) / F.nullif(F.size(F.array_union("a", "b")), F.lit(0))
    return j.select(F.col("query").alias("vec_id"), F.round(F.coalesce(score, F.lit(0.0)), 6).alias("jaccard"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(coalesce(stddev_samp(l_extendedprice), 0), 4) AS std, round(stddev_pop(l_extendedprice), 4) AS pop_std, min(l_extendedprice) AS low, max(l_extendedprice) AS high
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_returnflag, l_linestatus), ())""")
def group_stats(spark, d):
    """The three fixed groupings of a result table in one pass."""
    t = table(spark, d, "lineitem")
    p = "l_extendedprice"
    sets = t.groupingSets([["l_returnflag"], ["l_returnflag", "l_linestatus"], []], "l_returnflag", "l_linestatus")
    return sets.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(p), 4).alias("mean"), F.round(F.coalesce(F.stddev_samp(p), F.lit(0.0)), 4).alias("std"), F.round(F.stddev_pop(p), 4).alias("pop_std"), F.min(p).alias("low"), F.max(p).alias("high"))


#: Results of a replay: a run's mean score of each generator.
_RES = f"WITH {SCORED}, res AS (SELECT run_id, generator, count(*) AS n, avg(s.s) AS f1, avg(s.d - s.l - s.h) AS composite, avg(s.u) AS u FROM scored s JOIN cand USING (candidate_id, run_id) WHERE generator IS NOT NULL GROUP BY ALL)"


def _results(spark, d):
    g = candidates(spark, d).select("candidate_id", "generator").filter(F.col("generator").isNotNull())
    return scored(spark, d).join(g, "candidate_id").groupBy("run_id", "generator").agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("f1"), F.avg(F.col("d") - F.col("l") - F.col("h")).alias("composite"), F.avg("u").alias("u"))


@query(_RES + "SELECT generator, round(avg(m), 6) AS mean, round(coalesce(stddev_pop(m), 0), 6) AS sd FROM (SELECT r.generator, runs.seed, avg(f1) AS m FROM res r JOIN runs USING (run_id) GROUP BY ALL) GROUP BY ALL")
def macro_average(spark, d):
    """Mean over cells, then over seeds."""
    r = _results(spark, d).join(table(spark, d, "runs").select("run_id", "seed"), "run_id").groupBy("generator", "seed").agg(F.avg("f1").alias("m"))
    return r.groupBy("generator").agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.coalesce(F.stddev_pop("m"), F.lit(0.0)), 6).alias("sd"))


@query(_RES + """, b AS (SELECT run_id, f1 AS b FROM res WHERE generator = 'heuristic'), g AS (SELECT b.run_id, b.b, n.generator FROM b CROSS JOIN (SELECT DISTINCT generator FROM res WHERE generator <> 'heuristic') n),
dl AS (SELECT g.generator, r.f1 - g.b AS d FROM g LEFT JOIN res r USING (run_id, generator))
SELECT generator, count(*) FILTER (d > 1e-12) AS wins, count(*) FILTER (abs(d) <= 1e-12) AS ties, count(*) FILTER (d < -1e-12) AS losses, count(*) FILTER (d IS NULL) AS missing, round(avg(d), 6) AS mean_delta, round(coalesce(stddev_samp(d), 0), 6) AS std_delta FROM dl GROUP BY ALL""")
def win_tie_loss(spark, d):
    w = mt.wins(_results(spark, d), ["run_id"], "generator", "f1", "heuristic")
    return w.withColumns({c: F.round(c, 6) for c in ("mean_delta", "std_delta")})


@query(_RES + "SELECT count(DISTINCT run_id) AS cells, count(DISTINCT generator) AS selectors, count(DISTINCT run_id) * count(DISTINCT generator) AS expected, count(*) AS present FROM res")
def coverage(spark, d):
    return _results(spark, d).agg(F.countDistinct("run_id").alias("cells"), F.countDistinct("generator").alias("selectors"), (F.countDistinct("run_id") * F.countDistinct("generator")).alias("expected"), F.count(F.lit(1)).alias("present"))


_RANKED = f"WITH {SCORED}, rk AS (SELECT run_id, rank() OVER a + (count(*) OVER (PARTITION BY run_id, d) - 1) / 2.0 AS x, rank() OVER b + (count(*) OVER (PARTITION BY run_id, s) - 1) / 2.0 AS y FROM scored WINDOW a AS (PARTITION BY run_id ORDER BY d), b AS (PARTITION BY run_id ORDER BY s))"
_CORR = "coalesce(covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0), 0)"


@query(_RANKED + f" SELECT run_id, round({_CORR.format(x='x', y='y')}, 6) AS rho FROM rk GROUP BY ALL")
def spearman_by_group(spark, d):
    return mt.spearman(scored(spark, d), ["run_id"], "d", "s").withColumn("rho", F.round("rho", 6))


@query(f"WITH {SCORED} SELECT run_id, round({_CORR.format(x='d', y='s')}, 6) AS rho FROM scored GROUP BY ALL")
def pearson_by_group(spark, d):
    return mt.pearson(scored(spark, d), ["run_id"], "d", "s").withColumn("rho", F.round("rho", 6))


@query(_RANKED + f", r AS (SELECT run_id, round({_CORR.format(x='x', y='y')}, 6) AS rho FROM rk GROUP BY ALL) SELECT round(min(rho), 6) AS low, round(max(rho), 6) AS high, round(avg(rho), 6) AS mean, list_sort(list(rho))[count(*) // 2 + 1] AS upper_median, round(median(rho), 6) AS median FROM r")
def instability_summary(spark, d):
    """Rank correlations within runs: range, mean, the upper median and the true one."""
    r = spearman_by_group(spark, d)
    up = F.sort_array(F.collect_list("rho"))
    return r.agg(F.min("rho").alias("low"), F.max("rho").alias("high"), F.round(F.avg("rho"), 6).alias("mean"), F.element_at(up, F.floor(F.count("rho") / 2).cast("int") + 1).alias("upper_median"), F.round(F.median("rho"), 6).alias("median"))




def _cell_values(spark, d):
    r = table(spark, d, "runs").select("run_id", "dataset_id", "language")
    c = candidates(spark, d).select("run_id", "generator_confidence").join(r, "run_id")
    return c.groupBy(F.concat_ws(":", "dataset_id", "language").alias("cell")).agg((F.avg("generator_confidence") - 0.5).alias("x"))


@query(f"""WITH RECURSIVE {CANDIDATES}, vals AS (SELECT r.dataset_id || ':' || r.language AS cell, avg(c.generator_confidence) - 0.5::DOUBLE AS x FROM cand c JOIN runs r USING (run_id) GROUP BY ALL),
xs AS (SELECT list(x ORDER BY cell) AS x, count(*) AS n FROM vals),
rec(i, rest, total, weight) AS (SELECT 0, n, 0.0::DOUBLE, 1.0::DOUBLE FROM xs
  UNION ALL SELECT rec.i + 1, rec.rest - k.c, rec.total + k.c * xs.x[rec.i + 1], rec.weight / factorial(k.c::INT)::DOUBLE FROM rec, xs, (SELECT unnest(range(0, 13)) AS c) k WHERE rec.i < xs.n AND k.c <= rec.rest AND (rec.i + 1 < xs.n OR k.c = rec.rest)),
ms AS (SELECT round(total / n, 12) AS m, sum(weight) AS w FROM rec, xs WHERE i = n GROUP BY ALL),
cum AS (SELECT m, sum(w) OVER (ORDER BY m) AS c, sum(w) OVER () AS a FROM ms)
SELECT round((SELECT list_sum(x) / n FROM xs), 6) AS mean, round(min(m) FILTER (c >= 0.025::DOUBLE * a * (1 - 1e-12)), 6) AS lo, round(min(m) FILTER (c >= 0.975::DOUBLE * a * (1 - 1e-12)), 6) AS hi FROM cum""")
def bootstrap_exact_ci(spark, d):
    return mt.exact_bootstrap(_cell_values(spark, d), "x", "cell").select(*[F.round(c, 6).alias(c) for c in ("mean", "lo", "hi")])


@query(f"WITH {CANDIDATES}, vals AS (SELECT r.dataset_id || ':' || r.language AS cell, avg(c.generator_confidence) - 0.5::DOUBLE AS x FROM cand c JOIN runs r USING (run_id) GROUP BY ALL) SELECT cell, round((sum(x) OVER () - x) / (count(*) OVER () - 1), 6) AS others FROM vals")
def leave_one_out(spark, d):
    """The mean of all other groups."""
    v = _cell_values(spark, d)
    total = v.agg(F.sum("x").alias("t"), F.count("x").alias("n"))
    return v.join(F.broadcast(total), F.lit(True)).select("cell", F.round((F.col("t") - F.col("x")) / F.nullif(F.col("n") - 1, F.lit(0)), 6).alias("others"))


#: Spread up to which a cell hardly tells selectors apart.
DEGENERATE = 0.07


@query(_RES + f"SELECT run_id, round(max(f1) - min(f1), 6) AS spread, max(f1) - min(f1) <= {DEGENERATE}::DOUBLE AS degenerate FROM res GROUP BY ALL")
def degenerate_groups(spark, d):
    """The spread of every run's generators, and whether they hardly differ."""
    g = _results(spark, d).groupBy("run_id").agg((F.max("f1") - F.min("f1")).alias("spread"))
    return g.select("run_id", F.round("spread", 6).alias("spread"), (F.col("spread") <= DEGENERATE).alias("degenerate"))


@query(_RES + "SELECT run_id, generator, round(composite, 6) AS composite FROM res")
def composite_channel(spark, d):
    return _results(spark, d).select("run_id", "generator", F.round("composite", 6).alias("composite"))


@query(_RES + "SELECT run_id, round(max(f1) FILTER (generator = 'lark-7b') - max(f1) FILTER (generator = 'heuristic'), 6) AS delta FROM res GROUP BY ALL HAVING delta IS NOT NULL")
def ablation_delta(spark, d):
    p = _results(spark, d).groupBy("run_id").pivot("generator", ["lark-7b", "heuristic"]).agg(F.max("f1"))
    return p.select("run_id", F.round(F.col("lark-7b") - F.col("heuristic"), 6).alias("delta")).filter(F.col("delta").isNotNull())


def _selected(spark, d, b):
    return best(spark, d, b)


def _sel_sql(b: str, name: str) -> str:
    return f"{name} AS (WITH {_ranked_sql(b)} SELECT * FROM ranked WHERE place <= {BUDGET})"


_TWO = f"WITH {_sel_sql('rerank_v2', 'x')}, {_sel_sql('naive', 'y')}"


@query(_TWO + """, p AS (SELECT run_id, lab, n / sum(n) OVER (PARTITION BY run_id) AS p FROM (SELECT run_id, coalesce(label, 'None') AS lab, count(*) AS n FROM x GROUP BY ALL)), q AS (SELECT run_id, lab, n / sum(n) OVER (PARTITION BY run_id) AS q FROM (SELECT run_id, coalesce(label, 'None') AS lab, count(*) AS n FROM y GROUP BY ALL))
SELECT run_id, round(sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2, 6) AS tvd FROM p FULL JOIN q USING (run_id, lab) GROUP BY ALL""")
def label_tvd(spark, d):
    fill = lambda b: _selected(spark, d, b).withColumn("label", F.coalesce("label", F.lit("None")))
    return mt.total_variation(fill("rerank_v2"), fill("naive"), ["run_id"], "label").withColumn("tvd", F.round("tvd", 6))


@query(f"WITH {SCORED}, w AS (SELECT k.p AS parameter, v.v AS value FROM (SELECT unnest(['alpha_u', 'alpha_c', 'alpha_d', 'alpha_l', 'alpha_h']) AS p) k, (SELECT unnest([0.25::DOUBLE, 0.5, 0.75, 1.0, 1.25]) AS v) v), x AS (SELECT s.run_id, w.parameter, w.value, " + " + ".join(f"{sign} * (CASE WHEN w.parameter = 'alpha_{c}' THEN w.value ELSE {a}::DOUBLE END) * s.{c}" for c, a, sign in (("u", 1.0, "1"), ("c", 0.75, "1"), ("d", 0.5, "1"), ("l", 1.0, "-1"), ("h", 0.75, "-1"))) + " AS soft FROM scored s CROSS JOIN w) SELECT run_id, parameter, value, round(avg(soft), 6) AS mean_soft FROM x GROUP BY ALL")
def sensitivity_grid(spark, d):
    """Scores once, weighted many times: each weight at five values; means are linear, so candidates are summed first."""
    base = {"u": 1.0, "c": 0.75, "d": 0.5, "l": 1.0, "h": 0.75}
    sign = {"u": 1, "c": 1, "d": 1, "l": -1, "h": -1}
    m = scored(spark, d).groupBy("run_id").agg(*[F.avg(c).alias(c) for c in base])
    grid = F.explode(F.array(*[F.struct(F.lit(f"alpha_{p}").alias("parameter"), F.lit(v).alias("value")) for p in base for v in (0.25, 0.5, 0.75, 1.0, 1.25)]))
    x = m.withColumn("w", grid)
    soft = sum((sign[c] * F.when(F.col("w.parameter") == f"alpha_{c}", F.col("w.value")).otherwise(base[c]) * F.col(c) for c in base), F.lit(0.0))
    return x.select("run_id", "w.parameter", "w.value", F.round(soft, 6).alias("mean_soft"))


#: The reference's sensitivity.yaml: five values around each default.
SENSITIVITY = {
    "alpha_u": (0.5, 0.75, 1.0, 1.25, 1.5), "alpha_c": (0.375, 0.5625, 0.75, 0.9375, 1.125), "alpha_d": (0.25, 0.375, 0.5, 0.625, 0.75), "alpha_l": (0.5, 0.75, 1.0, 1.25, 1.5), "alpha_h": (0.375, 0.5625, 0.75, 0.9375, 1.125),
    "tau_l": (0.075, 0.1125, 0.15, 0.1875, 0.225), "tau_c": (0.3, 0.45, 0.6, 0.75, 0.9), "tau_h": (0.35, 0.525, 0.7, 0.875, 1.0),
}
_AT = lambda p, default: f"(CASE WHEN g.parameter = '{p}' THEN g.value ELSE {default}::DOUBLE END)"


@query(f"WITH {SCORED}, g AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', {v}::DOUBLE)" for p, values in SENSITIVITY.items() for v in values) + f""") t(parameter, value)),
x AS (SELECT s.run_id, g.parameter, g.value, {_AT('alpha_u', 1.0)} * s.u + {_AT('alpha_c', 0.75)} * s.c + {_AT('alpha_d', 0.5)} * s.d - {_AT('alpha_l', 1.0)} * s.l - {_AT('alpha_h', 0.75)} * s.h AS soft, s.l <= {_AT('tau_l', 0.15)} AND s.c >= {_AT('tau_c', 0.6)} AND s.h <= {_AT('tau_h', 0.7)} AS pass FROM scored s CROSS JOIN g)
SELECT run_id, parameter, value, count(*) AS candidates, count(*) FILTER (WHERE pass) AS passed, round(avg(soft), 6) AS mean_soft, round(avg(soft) FILTER (WHERE pass), 6) AS mean_passed FROM x GROUP BY ALL""")
def sensitivity_grid_gated(spark, d):
    """The reference's whole grid, 8 parameters by 5 values: every candidate is gated for each threshold; means are linear in the weights."""
    base = {p: values[2] for p, values in SENSITIVITY.items()}
    sign = {"u": 1, "c": 1, "d": 1, "l": -1, "h": -1}
    gates = {("", 0.0): base} | {(p, v): base | {p: v} for p, values in SENSITIVITY.items() if p.startswith("tau") for v in values}
    parts = [F.count(F.lit(1)).alias("candidates"), *(F.avg(c).alias(f"every_{c}") for c in sign)]
    for k, t in enumerate(gates.values()):
        ok = (F.col("l") <= t["tau_l"]) & (F.col("c") >= t["tau_c"]) & (F.col("h") <= t["tau_h"])
        parts += [F.count_if(ok).alias(f"passed_{k}"), *(F.avg(F.when(ok, F.col(c))).alias(f"pass_{k}_{c}") for c in sign)]
    rows = []
    for p, values in SENSITIVITY.items():
        for v in values:
            at, k = base | {p: v}, list(gates).index((p, v)) if (p, v) in gates else 0
            soft = lambda name, at=at: sum((sign[c] * at[f"alpha_{c}"] * F.col(f"{name}_{c}") for c in sign), F.lit(0.0))
            rows.append(F.struct(F.lit(p).alias("parameter"), F.lit(v).alias("value"), F.col(f"passed_{k}").alias("passed"), soft("every").alias("mean_soft"), soft(f"pass_{k}").alias("mean_passed")))
    x = scored(spark, d).groupBy("run_id").agg(*parts).select("run_id", "candidates", F.explode(F.array(*rows)).alias("w"))
    return x.select("run_id", "w.parameter", "w.value", "candidates", "w.passed", F.round("w.mean_soft", 6).alias("mean_soft"), F.round("w.mean_passed", 6).alias("mean_passed"))
