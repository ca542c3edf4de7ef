"""Core operators against brute force, and on nulls, ties, repeats and empty tables."""

import collections
import json
import random
from fractions import Fraction
from itertools import combinations_with_replacement

import pytest
from pyspark.sql import functions as F

from siftline.functions.embedding import embedder, hashed
from siftline.functions import prompts
from siftline.functions.replies import read_object, read_objects
from siftline.functions.text import MARKER, bounded, compact_text, csv_cell, strip_fence, token_ngrams, tokens, word_count
from siftline.operators import evaluation as ev
from siftline.operators import generation as gen
from siftline.operators import metrics as mt
from siftline.operators import planning as pl
from siftline.operators import reports as rp
from siftline.operators import scoring as sc
from siftline.operators import selection as sel
from siftline.operators import shortcut as sh
from siftline.operators import vectors as vc
from siftline.operators.config import AuditConfig, RunConfig, flag, from_mapping, load_config
from siftline.operators.grouping import exact_mean, first_k, means_in_order, quality_order, rank_in_groups, top_k, value_ranks
from siftline.operators.leakage import HeldGrams, leakage
from siftline.operators.scoring import pool_filter
from siftline.sources import readers as rd
from siftline.sources import sinks
from siftline.streaming.incremental import run_increments


def ranked_rows():
    r = random.Random(3)
    rows = [("hot", r.choice([1.0, 2.0, None, float("nan"), r.random()]), f"id{i:04d}") for i in range(900)]
    return rows + [(f"g{i % 7}", r.random(), f"x{i:04d}") for i in range(100)]


@pytest.mark.parametrize("split", [50, 10_000])
def test_rank_in_groups(spark, split):
    rows = ranked_rows()
    df = spark.createDataFrame(rows, "g string, q double, id string").withColumn("extra", F.lit(1))
    got = {(r.g, r.id): r["rank"] for r in rank_in_groups(df, ["g"], "q", "id", split_rows=split).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        part = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None or r[1] != r[1], -(r[1] or 0) if r[1] == r[1] and r[1] is not None else 0, r[2]))
        want |= {(g, r[2]): i + 1 for i, r in enumerate(part)}
    assert got == want


@pytest.mark.parametrize("split", [20, 10_000])
def test_value_ranks(spark, split):
    rows = [(g, q) for g, q, _ in ranked_rows() if q is not None and q == q]
    got = {(r.g, r.q): (r.below, r.ties, r.group_rows) for r in value_ranks(spark.createDataFrame(rows, "g string, q double"), ["g"], "q", split_rows=split).collect()}
    for (g, q), (below, ties, n) in got.items():
        mine = [x for h, x in rows if h == g]
        assert (below, ties, n) == (sum(x < q for x in mine), sum(x == q for x in mine), len(mine))
    assert len(got) == len(set(rows))


def test_top_k_and_empty(spark):
    df = spark.createDataFrame([("a", i % 5, f"{i:03d}") for i in range(200)], "g string, s int, id string").withColumn("k", F.lit(3))
    assert [r.id for r in top_k(df, ["g"], [F.desc("s")], F.col("k"), "id").orderBy("rank").collect()] == ["004", "009", "014"]
    assert rank_in_groups(df.filter("false"), ["g"], "s", "id").count() == 0
    assert value_ranks(df.filter("false"), ["g"], "s").count() == 0


def test_first_k(spark):
    rows = ranked_rows()
    df = spark.createDataFrame(rows, "g string, q double, id string").withColumn("k", F.when(F.col("g") == "hot", 40).otherwise(3))
    every = {(r.g, r.id): r["rank"] for r in rank_in_groups(df.select("g", "q", "id"), ["g"], "q", "id").collect()}
    got = {(r.g, r.id): r["rank"] for r in first_k(df, ["g"], quality_order("q"), F.col("k"), "id", parts=5).collect()}
    assert got == {x: n if n <= (40 if x[0] == "hot" else 3) else None for x, n in every.items()}


def test_tokens(spark):
    texts = ["Ó ti sú mi! a_b 12", "ከስበያዝ የመጡ።", "a b", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(tokens(F.col("t")).alias("w"))
    got = [r.w for r in df.collect()]
    assert got[0] == ["ó", "ti", "sú", "mi", "!", "a_b", "12"] and got[1] == ["ከስበያዝ", "የመጡ", "።"] and got[2] == ["a", "b"] and got[3:] == [[], []]
    assert [len(r.g) for r in df.select(token_ngrams(F.col("w"), 3).alias("g")).collect()] == [5, 1, 0, 0, 0]


def compacted(text, most):
    """What a prompt shows of a text, worked out by hand."""
    text = (text or "").strip()
    room = most - len(MARKER)
    head = int(room * 0.65)
    return text if len(text) <= most else text[:head].rstrip() + MARKER + text[-(room - head):].lstrip()


def test_scalars(spark):
    long = "\u2003 " + "x y" * 30 + "z" * 70 + "\x1f\x85"
    df = spark.createDataFrame([(long, 'a,"b', "say ```json\n{1}\n``` end", 1.5, float("nan"))], "t string, c string, f string, v double, n double")
    r = df.select(compact_text(F.col("t"), 60).alias("t"), csv_cell(F.col("c")).alias("c"), strip_fence(F.col("f")).alias("f"), bounded(F.col("v")).alias("v"), bounded(F.col("n")).alias("n"), word_count(F.col("t")).alias("w")).first()
    assert r.t == compacted(long, 60) and "excerpt truncated" in r.t and r.w == len(long.split())
    assert (r.c, r.f, r.v, r.n) == ('"a,""b"', "{1}", 1.0, 1.0)


def test_replies():
    assert read_objects('x {"a": "}\\""} y') == [{"a": '}"'}]
    assert read_objects('noise [{"a": 1}, 2] tail') == [{"a": 1}]
    assert read_objects('{"examples": [{"a": 1}]}') == [{"a": 1}]
    assert read_objects('see ```json\n{"a": 2}\n``` and {"a": 3}') == [{"a": 2}]
    assert read_objects("{broken") == [] == read_objects(None) == read_objects("7")
    assert read_objects('{"a": "line\nbreak"}') == [{"a": "line\nbreak"}] and read_object('{"q": 1}') == {"q": 1}
    with pytest.raises(ValueError):
        read_object("nothing")


def test_prompts(spark):
    df = spark.createDataFrame([("news_topic_classification", "hau", "sports", "a {text} b", ["health", "sports"]), ("sentiment_classification", "yor", None, None, []), ("summarization", "swa", None, "long", None)], "task string, language string, label string, text string, labels array<string>")
    got = [r.p for r in df.select(prompts.generation_prompt(F.col("task"), F.col("language"), F.col("label"), F.col("text"), F.coalesce("labels", F.array().cast("array<string>")), 2).alias("p")).collect()]
    assert got[0].startswith("Task: news_topic_classification\nLanguage: hau\nAllowed labels: health, sports\nSeed label: sports\nSeed text excerpt:\na {text} b\n\nGenerate 2 new examples") and "60-120 words" in got[0] and '[{"text": str,' in got[0]
    assert "Allowed labels: task-specific output\nSeed label: None" in got[1] and got[2].startswith("Task: summarization\nLanguage: swa\nSource article excerpt:\nlong\nSeed summary:\n\n")
    tagged = df.limit(1).select(prompts.generation_prompt(F.lit("named_entity_recognition"), F.lit("hau"), F.lit("ner"), F.lit("x"), F.array().cast("array<string>"), 1, None, F.array(F.lit("Abuja")), F.array(F.lit("B-LOC"))).alias("p")).first().p
    assert "Seed tokens: ['Abuja']\nSeed BIO tags: ['B-LOC']\n" in tagged
    limits = df.select(prompts.prompt_limit(F.col("task")).alias("n")).collect()
    assert [r.n for r in limits] == [2200, 1200, 3200]


def test_embedders(spark):
    df = spark.createDataFrame([("abc",), ("",), (None,)], "t string")
    v = [r.v for r in df.select(embedder("hash", dim=32)(F.col("t")).alias("v")).collect()]
    import hashlib

    want = [0.0] * 32
    for g in [("  abc  ")[i : i + n] for n in (3, 4, 5) for i in range(7 - n + 1)]:
        x = int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "little")
        want[x % 32] += 1.0 if x >> 63 else -1.0
    assert v[0] == pytest.approx([x / sum(y * y for y in want) ** 0.5 for x in want]) and v[0] == pytest.approx(hashed(["abc", None], 32)[0].tolist())
    assert sum(df.select(embedder("hash-md5")(F.col("t")).alias("v")).first().v) == 5
    with pytest.raises(ValueError):
        embedder("nothing")


def test_config():
    c = from_mapping(RunConfig, {"budgets": [8], "audit": {"tau_c": 0.5, "other": 1}, "unknown": 2})
    assert c.budgets == [8] and c.audit.tau_c == 0.5 and c.audit.relaxed_tau_c == 0.45
    text = "tasks: [ner]\naudit:\n  minhash_n: 4\njudge:\n  backend: heuristic\nseed_sampling: balanced\n"
    c = load_config(text)
    assert c.audit.shingle_n == 4 and c.judge.backend == "heuristic" and c.generation.backend == "heuristic" and c.seed_sampling == "balanced" and flag("Yes") and not flag(None)
    with pytest.raises(ValueError):
        pool_filter("none such", AuditConfig())


def test_quota_caps(spark):
    r = random.Random(5)
    for budget in (1, 3, 7, 20):
        rows = [(c, lab, f"{i:03d}") for c in "xyz" for i, lab in enumerate(r.choices("abcde", [9, 3, 2, 1, 1], k=r.randint(5, 40)))] + [("x", None, "999")]
        got = collections.defaultdict(dict)
        for q in sel.quota_caps(spark.createDataFrame(rows, "c string, lab string, id string"), ["c"], "lab", "id", budget).collect():
            got[q.c][q.lab] = q.cap
        for c, caps in got.items():
            n = collections.Counter(x[1] for x in rows if x[0] == c and x[1])
            want = {k: max(1, round(Fraction(budget * v, sum(n.values())))) for k, v in n.items()}
            order = sorted(n, key=lambda k: (-n[k], min(x[2] for x in rows if x[0] == c and x[1] == k)))
            i = 0
            while sum(want.values()) != budget and i < 100:
                k = order[i % len(order)]
                d = 1 if sum(want.values()) < budget else -1
                want[k] = max(0, want[k] + d)
                i += 1
            assert caps == want and sum(caps.values()) == budget


def greedy(rows, caps, cap, budget):
    used, took, out, late = collections.Counter(), collections.Counter(), [], []
    for label, sources, score, i in sorted(rows, key=lambda x: (-x[2], x[3])):
        if len(out) < budget and took[label] < caps.get(label, budget) and all(used[s] < cap for s in sources):
            out.append(i), took.update([label]), used.update(set(sources))
        else:
            late.append((sources, i))
    for sources, i in late:
        if len(out) < budget and all(used[s] < cap for s in sources):
            out.append(i), used.update(set(sources))
    return out


def test_takes(spark):
    r = random.Random(7)
    rows = [(r.choice("ab"), r.sample(["s1", "s2", "s3", "s4"], r.randint(0, 2)), round(r.random(), 1), f"{i:03d}") for i in range(60)]
    df = spark.createDataFrame([("c", *x) for x in rows], "c string, lab string, src array<string>, score double, id string")
    caps = spark.createDataFrame([("c", "a", 3), ("c", "b", 5)], "c string, lab string, cap int")
    for walk, cap, budget in ((50_000, 2, 8), (12, 1, 8), (12, 2, 30)):  # in rounds of twelve rows too
        got = [x.id for x in sel.greedy_take(df, caps, ["c"], "lab", "src", "score", "id", cap, budget, walk_rows=walk).orderBy("rank").collect()]
        assert got == greedy(rows, {"a": 3, "b": 5}, cap, budget)
    assert not sel.is_laminar(df, ["c"], "lab", "src") and sel.greedy_take(df.filter("false"), caps, ["c"], "lab", "src", "score", "id", 2, 8).count() == 0
    one = [(x[0], [x[0] + str(i % 5)], x[2], x[3]) for i, x in enumerate(rows)]
    lam = spark.createDataFrame([("c", a, s[0], q, i) for a, s, q, i in one], "c string, lab string, src string, score double, id string")
    assert {x.id for x in sel.laminar_take(lam, caps, ["c"], "lab", "src", "score", "id", 2, 8).collect()} == set(greedy(one, {"a": 3, "b": 5}, 2, 8))
    assert sel.source_capped(lam, ["c"], "src", "score", "id", 1, 0).count() == 0
    free = spark.createDataFrame([("c", None, 1.0 - i / 10, f"f{i}") for i in range(5)], "c string, src string, score double, id string")
    assert sel.source_capped(free, ["c"], "src", "score", "id", 1, 4).count() == 4  # rows without a source meet no cap
    listed = lam.withColumn("src", F.array("src"))
    assert sel.is_laminar(listed, ["c"], "lab", "src")
    assert [x.id for x in sel.budgeted_take(listed, caps, ["c"], "lab", "src", "score", "id", 2, 8).orderBy("rank").collect()] == greedy(one, {"a": 3, "b": 5}, 2, 8)


def test_samples(spark):
    import hashlib

    r = random.Random(11)
    order = lambda i: hashlib.md5(f"5|{i}".encode()).hexdigest()
    for sizes, budget in (({"a": 9, "b": 1, "c": 1, "d": 1, "e": 1}, 3), ({"a": 6, "b": 7}, 5), ({"a": 1, "b": 30, "c": 2}, 12), ({"a": 2, "b": 2}, 9)):
        rows = [("c", lab, f"{lab}{i}") for lab, n in sizes.items() for i in range(n)]
        r.shuffle(rows)
        got = {x.id for x in sel.sample_per_class(spark.createDataFrame(rows, "c string, lab string, id string"), ["c"], "lab", "id", budget, 5).collect()}
        by = {lab: sorted((i for _, x, i in rows if x == lab), key=order) for lab in sizes}
        if all(n >= budget for n in sizes.values()):
            want = {i for x in by.values() for i in x[:budget]}
        else:
            want, left = [], budget
            for k, lab in enumerate(sorted(by)):
                take = left if k == len(by) - 1 else max(1, min(round(budget * len(by[lab]) / len(rows)), left))
                want += by[lab][:take]
                left = max(0, budget - len(want))
            rest = sorted((i for _, _, i in rows if i not in want), key=order)
            want = set((sorted(want, key=order) + rest)[:budget])
        assert got == want
    df = spark.createDataFrame([("c", "ner", "x", f"{i}") for i in range(9)] + [("d", "sentiment_classification", "ab"[i % 2], f"{i}") for i in range(9)], "c string, task string, lab string, id string")
    n = sel.sample_gold(df, ["c"], "task", "lab", "id", 4, 1, "balanced").groupBy("c", "lab").count().collect()
    assert {(x.c, x.lab): x["count"] for x in n} == {("c", "x"): 4, ("d", "a"): 2, ("d", "b"): 2}
    with pytest.raises(ValueError):
        sel.sample_gold(df, ["c"], "task", "lab", "id", 4, 1, "other")


def test_gates_and_reranking(spark):
    nan = float("nan")
    rows = [("a", 0.9, 0.1, 0.2, 0.5, 0.7, '{"llm_judge": {"label_correctness": 0.8, "quality_score": "bad"}}'), ("b", None, nan, None, None, None, '{"llm_judge": {"quality_score": 0.6, "leakage_suspicion": 0.3, "counterfactual_validity": 0.9}}'), ("c", 0.2, 0.3, 0.9, 0.1, nan, None)]
    df = sc.with_judgement(spark.createDataFrame(rows, "id string, u double, l double, h double, d double, c double, metadata string"))
    cfg = AuditConfig()
    got = {r.id: r for r in df.select("id", sc.passes(cfg, cfg.tau_c).alias("strict"), sc.passes(cfg).alias("soft"), sc.reject_reasons(cfg).alias("why"), sc.rerank_score(cfg).alias("v2")).collect()}
    assert (got["a"].strict, got["b"].strict, got["b"].soft, got["c"].strict) == (True, False, True, False)
    assert got["b"].why == ["counterfactual"] and got["c"].why == ["leakage", "shortcut"]

    def v2(u, l, h, d, c, lc, q, f, cu, ls, strict, relaxed):
        return 1.25 * lc + 0.85 * q + 0.45 * f + 0.35 * cu + 0.35 * u + 0.65 * c + 0.45 * d + 0.25 * strict + 0.1 * relaxed - (1.4 * l + h + 1.1 * ls + 0.55 * max(0, 0.6 - c) + 0.45 * max(0, l - 0.15) + 0.35 * max(0, h - 0.7))

    # a judge's value that is no number counts as 0 and is no missing one; missing audit scores fall back on the judge; NaN is held at 1
    assert got["a"].v2 == pytest.approx(v2(0.9, 0.1, 0.2, 0.5, 0.7, 0.8, 0.0, 0.0, 0.0, 0.1, 1, 1))
    assert got["b"].v2 == pytest.approx(v2(0.6, 1.0, 0.0, 0.0, 0.9, 0.6, 0.6, 0.6, 0.6, 0.3, 0, 0))
    assert got["c"].v2 == pytest.approx(v2(0.2, 0.3, 0.9, 0.1, 1.0, 0.2, 0.2, 0.2, 0.2, 0.3, 0, 0))


def test_shortcuts(spark):
    rows = [("r", "a", "Ọjọ́ tuntun: SPORTS [Variant 2]!", "sports"), ("r", "b", None, "health"), ("r", "c", "plain words here and there, ok.", None), ("s", "d", "sports", "")]
    f = {x.id: x for x in sh.shortcut_score(sh.artifact_features(spark.createDataFrame(rows, "run string, id string, text string, label string"), "run", "text", "label"), "run").collect()}
    a = f["a"]
    assert (a.length, a.label_word, a.template) == (5, True, True) and a.names == pytest.approx(3 / 5) and a.punctuation == pytest.approx(2 / len(rows[0][2]))
    assert (f["b"].length, f["b"].label_word, f["b"].names, f["b"].punctuation) == (0, False, 0.0, 0.0) and not f["d"].label_word
    mean, sd = (5 + 0 + 6) / 3, max(1.0, (sum((x - 11 / 3) ** 2 for x in (5, 0, 6)) / 3) ** 0.5)
    assert a.h == pytest.approx(0.35 + 0.30 + 0.2 * min(1, abs(5 - mean) / sd / 3) + 0.1 * 3 / 5 + 0.05 * min(1, 10 * a.punctuation))


def test_consistency(spark):
    rows = [(0.8, None, None, 0.4), (0.8, None, '{"llm_judge": {"quality_score": "bad"}}', 0.4), (0.8, 0.5, None, 0.4), (None, None, '{"llm_judge": {}}', None)]
    df = spark.createDataFrame(rows, "s double, v double, m string, p double")
    got = [r.c for r in df.select(gen.consistency(F.col("s"), F.col("v"), gen.has_judgement(F.col("m")), F.col("p")).alias("c")).collect()]
    assert got == pytest.approx([0.8 * 0.4, 0.8 * (0.75 + 0.1), 0.5 * (0.75 + 0.1), 0.0])


def test_leakage(spark):
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([("a", " ".join(words)), ("b", " ".join(words[:12] + ["z"] * 20)), ("c", None), ("d", "short")], "id string, text string")
    held = spark.createDataFrame([(1, " ".join(words)), (2, None)], "item bigint, text string")
    got = {r.id: (r.exact, round(r.jaccard, 4)) for r in leakage(docs, "id", "text", held, "item", "text").collect()}
    assert got["a"] == (1.0, 1.0) and got["b"][0] == 1.0 and got["c"] == got["d"] == (0.0, 0.0)
    assert leakage(docs, "id", "text", held.filter("false"), "item", "text").filter("l > 0").count() == 0


def test_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "t string, g string")
    r = mt.macro_f1(df, "t", "g").first()
    assert r.accuracy == 0.5 and r.macro_f1 == pytest.approx((2 / 4 + 2 / 3 + 0) / 3)
    assert mt.macro_f1(df.filter("false"), "t", "g").first().macro_f1 == 0.0
    flat = spark.createDataFrame([("k", 1.0, float(i)) for i in range(4)], "k string, x double, y double")
    assert mt.pearson(flat, ["k"], "x", "y").first().rho == 0.0 == mt.spearman(flat, ["k"], "x", "y").first().rho


def test_bootstrap(spark):
    xs = [0.3, -0.1, 0.2, 0.05]
    import math

    means = sorted((sum(c) / 4, math.factorial(4) / math.prod(math.factorial(n) for n in collections.Counter(c).values())) for c in combinations_with_replacement(xs, 4))
    total, up, lo, hi = sum(w for _, w in means), 0.0, None, None
    for m, w in means:
        up += w
        lo = m if lo is None and up >= 0.025 * total * (1 - 1e-12) else lo
        hi = m if hi is None and up >= 0.975 * total * (1 - 1e-12) else hi
    r = mt.exact_bootstrap(spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double"), "x", "i").first()
    assert (r["mean"], r.lo, r.hi) == (pytest.approx(sum(xs) / 4), pytest.approx(lo), pytest.approx(hi))


def test_nearest(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 8)).round(3)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(99, None)], "id bigint, v array<float>")
    got = {(r["query"], r.place): r.key for r in vc.nearest(df.filter("id % 10 = 0"), df, "id", "v", 3).collect()}
    n = m.astype(np.float32).astype(float)
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    for q in range(0, 60, 10):
        c = np.round(n @ n[q], 9)
        c[q] = -9
        assert [got[q, p] for p in (1, 2, 3)] == np.lexsort((np.arange(60), -c))[:3].tolist()
    ref = df.filter("id < 20").select(F.col("id").cast("string").alias("id"), F.col("v").alias("vector"), F.lit("x").alias("label"))
    one = {r.id: [x.key for x in r.near] for r in vc.against_all(df, "id", {"v": [("near", ref, 2), ("first", ref, 1)]}).collect()}
    again = {r.id: [x.key for x in r.near] for r in vc.against_reference(df, "id", "v", ref, "id", "vector", "label", 2).collect()}
    assert one == again and one[99] == [] and len(one) == 61


def test_blocks_of_queries_and_references(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(30)], "id bigint, v array<float>")
    ref = df.select(F.col("id").cast("string").alias("id"), F.col("v").alias("vector"), F.lit("x").alias("label"))
    whole = {(r["query"], r.place): r.key for r in vc.nearest(df, df, "id", "v", 2).collect()}, {r.id: [x.key for x in r.near] for r in vc.against_all(df, "id", {"v": [("near", ref, 3)]}).collect()}
    monkeypatch.setattr(vc, "BLOCK_QUERIES", 11)
    monkeypatch.setattr(vc, "BLOCK_REFERENCE", 11)
    assert whole == ({(r["query"], r.place): r.key for r in vc.nearest(df, df, "id", "v", 2).collect()}, {r.id: [x.key for x in r.near] for r in vc.against_all(df, "id", {"v": [("near", ref, 3)]}).collect()})


def test_generation(spark):
    seeds = spark.createDataFrame([("s", "news", "one two three four", "a", None, None), ("t", None, None, None, None, None), ("u", "summarization", "text ", "summary", "short", None), ("v", "named_entity_recognition", "x", "ner", None, ["Kofi", "left"])], "id string, task string, text string, label string, summary string, tokens array<string>")
    g = gen.generate(seeds, 2)
    j = {(r.seed_id, r.variant): r for r in gen.judge(gen.counterfactual(g, ["b", "a"])).collect()}
    assert j["s", 1].text.endswith("[variant 1]") and j["s", 0].cf_label == "b" and j["s", 0].cf_score == 0.65 and j["s", 0].cf_text == "one two three four\nCounterfactual label cue: b."
    assert j["u", 1].text == "text \n\nSynthetic summary target: short" and j["u", 0].cf_text.endswith("[COUNTERFACTUAL: salient fact changed]") and j["v", 1].text == "Kofi left" and j["v", 0].cf_text == "Kofi left CF"
    # by the formulas: quality by words and the mark, suspicion by length, validity by another label
    s, t = j["s", 0], j["t", 0]
    assert (s.quality_score, s.label_correctness, s.fluency, s.leakage_suspicion, s.counterfactual_validity) == (0.75, 0.75, 0.85, 0.30, 1.0)
    assert j["s", 1].quality_score == pytest.approx(0.60) and j["s", 1].leakage_suspicion == 0.15 and (t.quality_score, t.counterfactual_validity) == (0.45, 1.0) and len(t.candidate_id) == 16
    import hashlib

    whole = {"judge_model": gen.JUDGE_MODEL, "rationale": gen.RATIONALE} | {n: getattr(s, n) for n in gen.JUDGED}
    assert s.judge_id == hashlib.sha256(json.dumps(whole, sort_keys=True).encode()).hexdigest()[:16]
    assert gen.pending(seeds, g.select(F.col("seed_id").alias("id")), "id").count() == 0
    out = gen.call_endpoint(seeds, "id string, n int", lambda b: b.assign(n=1)[["id", "n"]])
    assert out.count() == 4 and gen.generate(seeds, 0).count() == 0


def test_stages(spark):
    seeds = spark.createDataFrame([(f"s{i}", f"some text of seed {i} that is long", "ab"[i % 2]) for i in range(8)], "id string, text string, label string")
    first = gen.generated(seeds, None, 2, limit=3)
    assert first.count() == 6
    every = gen.generated(seeds, first, 2)
    assert every.count() == 16 and every.select("candidate_id").distinct().count() == 16
    c = gen.counterfactuals(every, ["a", "b"])
    assert c.filter("cf_label <> label").count() == 16
    broken = lambda d: gen.counterfactual(d, ["a", "b"]).withColumn("cf_error", F.when(F.col("seed_id") == "s1", "no reply"))
    marked = gen.counterfactuals(every, [], work=broken).filter("cf_error IS NOT NULL").collect()
    assert len(marked) == 2 and all(r.cf_score == 0.0 and r.cf_text == "" and r.cf_policy == gen.FAILED_POLICY for r in marked)
    with pytest.raises(RuntimeError):
        gen.counterfactuals(every, [], work=lambda d: broken(d).withColumn("cf_error", F.lit("down")))
    half = gen.judged(c.filter("variant = 0"))
    whole = gen.judged(c, half)
    assert whole.count() == 16 and whole.filter("judge_score IS NULL OR judge_validity IS NULL").count() == 0
    reply = json.dumps({"quality_score": "1.5", "fluency": None, "leakage_suspicion": "n/a", "rationale": "r" * 900, "judge_model": "m"})
    n = spark.createDataFrame([(reply,)], "r string").select(gen.normalised_judgement(F.col("r")).alias("n")).first().n
    import hashlib

    assert (n.quality_score, n.fluency, n.leakage_suspicion, n.judge_model, len(n.rationale)) == (1.0, 0.5, 0.5, "m", 500)
    assert n.judge_id == hashlib.sha256(json.dumps(json.loads(reply), sort_keys=True).encode()).hexdigest()[:16]


def test_retries(spark, tmp_path):
    class Refused(Exception):
        def __init__(self, code):
            self.status_code = code

    assert [gen.may_retry(Refused(c)) for c in (408, 409, 429, 500, 503, 400, 404)] == [True] * 5 + [False] * 2
    assert gen.may_retry(TimeoutError()) and gen.may_retry(ConnectionError()) and not gen.may_retry(ValueError())
    with pytest.raises(ValueError):
        gen.backend("judge", "none such")
    with pytest.raises(ValueError):
        gen.backend("generate", "vllm")
    assert gen.backend("judge", "disabled")("rows") == "rows"
    flaky = str(tmp_path / "tries")

    def call(batch):
        import os

        os.makedirs(flaky, exist_ok=True)
        if len(os.listdir(flaky)) < 2:
            open(os.path.join(flaky, str(len(os.listdir(flaky)))), "w").close()
            raise ConnectionError("busy")
        return batch.assign(n=1)

    df = spark.createDataFrame([("a",)], "id string").coalesce(1)
    assert gen.backend("judge", "vllm", call, "id string, n int", wait=0.01)(df).count() == 1 and len(list((tmp_path / "tries").iterdir())) == 2


def test_evaluation(spark):
    cell = ["dataset_id", "task", "language"]
    embed = embedder("hash", dim=64)
    row = lambda i, task, text, label, tokens=None, tags=None, summary=None: ("d", task, "hau", i, text, label, tokens, tags, summary)
    schema = "dataset_id string, task string, language string, id string, text string, label string, tokens array<string>, tags array<string>, summary string"
    gold = spark.createDataFrame([row("1", "sentiment_classification", "good good day", "p"), row("2", "sentiment_classification", "bad sad rain", "n"), row("3", "named_entity_recognition", "", "ner", ["Kofi", "left", "Kofi"], ["B-PER", "O", "O"]), row("4", "summarization", "rain fell all day", None, summary="rain fell"), row("5", "summarization", "the council met", None, summary="council")], schema)
    test = spark.createDataFrame([row("t1", "sentiment_classification", "good day", "p"), row("t2", "sentiment_classification", "sad rain", "p"), row("t3", "named_entity_recognition", "", "ner", ["kofi", "ran"], ["B-PER", "B-PER"]), row("t4", "summarization", "rain fell today", None, summary="rain fell hard")], schema)
    got = {r.task: r for r in ev.evaluate(gold, None, test, embed, "hash").collect()}
    s = got["sentiment_classification"]
    assert s.metrics["accuracy"] == 0.5 and s.metrics["macro_f1"] == pytest.approx((2 / 3 + 0) / 2) and (s.train_gold, s.train_synthetic, s.test_size) == (2, 0, 2) and 0 <= s.metrics["ece"] <= 1
    assert got["named_entity_recognition"].metrics == {"entity_micro_f1": pytest.approx(2 / 3)}  # equal counts go to the tag seen first
    assert got["summarization"].metrics == {"summary_jaccard": pytest.approx(2 / 3)} and s.evaluator == "lightweight_hash"
    with pytest.raises(ValueError):
        ev.evaluate(gold, None, test.withColumn("task", F.lit("other")), embed, "hash")
    assert ev.evaluate(gold, None, test.filter("false"), embed, "hash").count() == 0
    chosen = spark.createDataFrame([("c1", "d", "ner", "hau", None, "x", '{"tokens": ["a"], "raw_item": {"tags": ["O"], "summary": "s"}, "synthetic": "no"}'), ("c2", "d", "ner", "hau", "t", None, None)], "candidate_id string, dataset_id string, task string, language string, text string, label string, metadata string")
    t = {r.id: r for r in ev.training_records(chosen).collect()}
    assert (t["c1"].tokens, t["c1"].tags, t["c1"].summary, t["c1"].text, t["c1"].metadata["synthetic"]) == (["a"], ["O"], "s", "", "no") and t["c2"].metadata == {"synthetic": "true", "scores": "{}"}
    n = ev.tag_counts(gold.filter("task = 'named_entity_recognition'"), cell, "tags").first()
    assert (n.rows, n.tokens, n.labels) == (1, 3, {"B-PER": 1})


def test_reports(spark):
    one = spark.createDataFrame([(1, "k1"), (1, "k1"), (1, "k2"), (2, "k9")], "run int, k string")
    two = spark.createDataFrame([(1, "k1"), (1, "k3"), (2, "k9")], "run int, k string")
    o = {r.run: r for r in rp.overlap(one, two, ["run"], "k", spark.createDataFrame([(1,), (2,), (3,)], "run int")).collect()}
    assert o[1].jaccard == pytest.approx(1 / 3) and o[1].multiset_jaccard == pytest.approx(1 / 4) and not o[1].same and o[2].same and o[3].jaccard == 1.0 and o[3].same
    m = spark.createDataFrame([(2, "a", 0.5), (2, "b", 0.6), (3, "a", 0.5), (3, "b", 0.5)], "run int, baseline string, metric double")
    f = {r.run: r.flag for r in rp.inconsistent(spark.createDataFrame(list(o.values())), m, ["run"], "a", "b").collect()}
    assert f == {1: False, 2: True, 3: False}
    r = random.Random(4)
    res = [(s, c, f"b{b}", r.random()) for s in (1, 2) for c in range(3) for b in range(4)] + [(3, 0, "b0", 0.5), (1, 9, "b0", None)]
    q = {f"b{b}": r.random() for b in range(4)}
    df = spark.createDataFrame(res, "seed int, cell int, baseline string, macro_f1 double")
    got = {x.seed: x for x in rp.agreement(df, spark.createDataFrame(list(q.items()), "baseline string, quality double"), ["cell"]).collect()}

    def rho(pairs):
        rank = lambda v: {i: sorted(v).index(x) for i, x in enumerate(v)}
        a, b = rank([p[0] for p in pairs]), rank([p[1] for p in pairs])
        n = len(pairs)
        return 1 - 6 * sum((a[i] - b[i]) ** 2 for i in range(n)) / (n * (n * n - 1))

    for s in (1, 2):
        within = [rho([(q[b], v) for t, c, b, v in res if t == s and c == k]) for k in range(3)]
        means = {b: [v for t, c, x, v in res if t == s and x == b and v is not None] for b in q}
        assert got[s].selector_rho == pytest.approx(rho([(q[b], sum(v) / len(v)) for b, v in means.items()])) and got[s].within_mean == pytest.approx(sum(within) / 3) and got[s].within_median == pytest.approx(sorted(within)[1])
    assert set(got) == {1, 2} and rp.instability(rp.agreement(df, spark.createDataFrame(list(q.items()), "baseline string, quality double"), ["cell"])).first().seeds == 2
    assert "| 0.5000 |" in rp.markdown(spark.createDataFrame([(0.5,)], "x double"), "Title")


def test_planning(spark):
    plan = spark.createDataFrame([("d", "t", "l", "s", "select", 0, "a"), ("d", "t", "l", "s", "evaluate", 1, "b"), ("e", "t", "l", "s", "evaluate", 0, "c"), ("d", "t", "l", "s", "judge", 2, "x")], "dataset_id string, task string, language string, slug string, stage string, step int, command string")
    assert sorted(r.command for r in pl.phase(plan, "selection").collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        pl.phase(plan, "none such")
    assert plan.filter(pl.cell_filter([], [], [])).count() == 4 and plan.filter(pl.cell_filter(["e"], [], ["l"])).count() == 1
    hits = pl.lint(spark.createDataFrame([(1, "a human audit\nof κ"), (2, None)], "k int, t string"), "k", "t").collect()
    assert sorted((h.line, h.rule) for h in hits) == [(1, "human_audit"), (2, "kappa")]
    assert len(pl.ABLATIONS) == 8


def test_sources_and_sinks(spark, tmp_path):
    p = str(tmp_path)
    (tmp_path / "news.tsv").write_text('headline\ttext\tcategory\turl\nH1\t"B ""q""\nmore"\tsports\tu\nH2\tB2\thealth\tv\n', encoding="utf-8")
    n = rd.read_records(spark, "news_topic_classification", f"{p}/news.tsv", "d", "hau", "dev").orderBy("id").collect()
    assert [r.id for r in n] == ["d:hau:dev:0", "d:hau:dev:1"] and n[0].text == 'H1\n\nB "q"\nmore'
    many = spark.createDataFrame([(i,) for i in range(1000)], "i int").repartition(7)
    placed = rd._numbered(many).collect()
    assert sorted(r.pos for r in placed) == list(range(1000))
    (tmp_path / "x.conll").write_text("Abuja B-LOC\nis O\n\nalone\nKofi x B-PER\n", encoding="utf-8")
    c = rd.read_records(spark, "ner", f"{p}/x.conll", "d", "hau", "dev").orderBy("id").collect()
    assert [r.tokens for r in c] == [["Abuja", "is"], ["Kofi"]] and c[1].tags == ["B-PER"]
    (tmp_path / "m.jsonl").write_text("\n".join(json.dumps({"id": str(i), "partition": "dev" if i else "test", "utt": "u", "intent": "i"}) for i in range(3)) + "\n\n", encoding="utf-8")
    assert rd.read_records(spark, "intent_classification", f"{p}/m.jsonl", "d", "hau", "dev").count() == 2
    with pytest.raises(ValueError):
        rd.read_records(spark, "none", p, "d", "hau", "dev")
    tree = tmp_path / "runs/task/hau/b64_m3_s13/hf/audited"
    tree.mkdir(parents=True)
    (tree / "test_metrics.json").write_text('{"eval_macro_f1": 0.5}')
    r = rd.read_run_tree(spark, f"{p}/runs").first()
    assert (r.task, r.language, r.slug, r.baseline, r.macro_f1) == ("task", "hau", "b64_m3_s13", "audited", 0.5)
    import tarfile

    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        t.add(tree / "test_metrics.json", "x/test_metrics.json")
    assert rd.read_archives(spark, f"{p}/a.tar.gz", "test_metrics.json").first().content.startswith("{")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        for name, text in (("gold.jsonl", '{"id": 1}\n\n{"id": 2}\n'), ("selected/naive.jsonl", '{"candidate_id": "a"}\n'), ("hf/naive/test_metrics.json", '{"f1_macro": 1}')):
            (tmp_path / "m").write_text(text)
            t.add(tmp_path / "m", f"run/task/hau/b64_m3_s13/{name}")
    art = [(r.task, r.slug, r.kind, r.baseline) for r in rd.read_artifact(spark, f"{p}/b.tar.gz").collect()]
    assert sorted(art, key=str) == sorted([("task", "b64_m3_s13", "gold", None)] * 2 + [("task", "b64_m3_s13", "selected", "naive"), ("task", "b64_m3_s13", "metrics", "naive")], key=str)
    chosen = tmp_path / "runs/task/hau/b64_m3_s13/selected"
    chosen.mkdir()
    (chosen / "naive.jsonl").write_text('{"candidate_id": "a", "hard_reject": true, "scores": {"C": 0.5}, "metadata": {"llm_judge": {"quality_score": 0.4}}}\n{"candidate_id": "b"}\n')
    q = rd.selection_quality(rd.read_selections(spark, f"{p}/runs"), ["task", "slug", "baseline"]).first()
    assert (q.baseline, q.selected, q.c, q.judge_quality_score, q.hard_reject_rate) == ("naive", 2, 0.25, 0.2, 0.5)
    assert rd.read_results(spark, f"{p}/none.json", "a int").count() == 0
    claims = {r.claim_id: r.value for r in sinks.scan_ledger(spark, f"{p}/runs").collect()}
    assert claims == {"audited:eval_macro_f1": 0.5}
    assert [r.path.rsplit("/", 1)[1] for r in sinks.bundle_manifest(spark, f"{p}/runs", 20).collect()] == [] and sinks.bundle_manifest(spark, f"{p}/runs").count() == 2
    spark.range(3).write.parquet(f"{p}/run1/gold")
    assert sinks.clone_inputs(spark, f"{p}/run1", f"{p}/run2") == ["gold"] and sinks.clone_inputs(spark, f"{p}/run1", f"{p}/run2") == []
    with pytest.raises(KeyError):
        rd.catalogue_entry(spark.createDataFrame([("d", "t")], "dataset_id string, task string"), "other")
    df = spark.createDataFrame([("a", "Ọjọ́", None, True)], "id string, text string, label string, ok boolean")
    sinks.write_jsonl(df, f"{p}/out")
    assert rd.read_jsonl(spark, f"{p}/out", "id string, text string, label string").first().text == "Ọjọ́"
    assert sinks.ledger(df, ["id"], ["ok"]).first().value == 1.0
    d = sinks.digests(spark, f"{p}/runs")
    assert sinks.check_digests(d, d).count() == 0
    stale = d.select("path", F.lit("0").alias("sha")).unionByName(spark.createDataFrame([("gone", "1")], "path string, sha string"))
    assert sorted(x.state for x in sinks.check_digests(d, stale).collect()) == ["missing", "stale", "stale"]


def test_increments(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    for part in ([("a", 1), ("b", 2)], [("b", 2), ("c", 3)]):
        spark.createDataFrame(part, "k string, v int").write.mode("append").parquet(src)
        run_increments(spark.readStream.schema("k string, v int").parquet(src), "k", out, cp, lambda d: d.withColumn("w", F.col("v") * 2)).awaitTermination()
    assert sorted((r.k, r.w) for r in spark.read.parquet(out).collect()) == [("a", 2), ("b", 4), ("c", 6)]


def test_audit_and_select(spark, tmp_path):
    from siftline.__main__ import main
    from siftline.operators.scoring import POOLS
    from siftline.operators.staging import written
    from siftline.plans.audit import audit, select_candidates

    schema = "candidate_id string, run_id bigint, text string, label string, source_seed_ids array<string>, generator_confidence double, metadata string, counterfactual struct<text: string, label: string, semantic_edit_score: double>"
    long = " ".join(f"w{i}" for i in range(20))
    rows = [("a", 1, "the farmers met", "x", ["s1"], 0.5, '{"llm_judge": {"quality_score": "bad"}}', ("the farmers left", "y", 0.9)), ("b", 1, long, "y", None, None, None, None), ("c", 1, None, None, [], 0.1, "{", None), ("a", 1, "the farmers met", "x", ["s1"], 0.7, None, None)]
    c = spark.createDataFrame(rows, schema)
    g = spark.createDataFrame([("g1", "the farmers met today", "x"), ("g2", "rain fell all day", "y"), ("g3", None, None)], "id string, text string, label string")
    h = spark.createDataFrame([(1, long), (2, None)], "item_id bigint, text string")
    cfg = AuditConfig(embedding_dim=64)
    got = {r.candidate_id: r for r in audit(c, g, h, cfg).collect()}
    assert set(got) == {"a", "b", "c"} and got["b"].l == 1.0 and "leakage" in got["b"].reject_reasons and got["c"].l == 0.0
    assert all(0 <= getattr(r, x) <= 1 for r in got.values() for x in "ulhdc")
    a = got["a"].score_parts
    assert got["a"].u == pytest.approx((0.7 + a.utility.teacher + a.utility.vote) / 3)  # of the rows sent again the one with the larger confidence
    none = audit(c, g.filter("false"), h.filter("false"), cfg).filter("candidate_id = 'a'").first()
    assert none.d == 1.0 and none.l == 0.0 and none.score_parts.utility.teacher == 0.5
    a = written(audit(c, g, h, cfg))
    assert len(POOLS) == 14
    for b in ("audited_relaxed", "equal_budget", "naive"):
        assert select_candidates(a, g, b, 2, cfg).count() <= 2
    main(["run", "quota_caps", "/root/testdata/sf0.001", str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_audit_in_one_pass(spark, monkeypatch):
    """No vector is written or shuffled, and sides beyond a block, which are joined, give the same."""
    from siftline.plans import audit as plan

    d = "/root/testdata/sf0.001"
    c, g, h = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("candidates", "gold", "benchmark"))
    kinds = []
    keep = plan.written
    monkeypatch.setattr(plan, "written", lambda df, name: kinds.extend(df.dtypes) or keep(df, name))
    run = lambda gold, held, cfg: {r.candidate_id: r for r in plan.audit(c, gold, held, cfg).collect()}
    sides = [(g, h), (g.filter("false"), h), (g.withColumn("label", F.lit(None).cast("string")), h.filter("false")), (g.limit(3).unionByName(g.limit(3).withColumn("id", F.lit("again"))), h.limit(2))]
    cfg = AuditConfig(embedding_dim=64, ngram_n=6, shingle_n=3)
    one = [run(*x, cfg) for x in sides]
    assert kinds and not [k for _, k in kinds if k.startswith(("array<float>", "array<double>"))]
    monkeypatch.setattr(plan, "BLOCK_REFERENCE", -1)
    for mine, theirs in zip(one, [run(*x, cfg) for x in sides], strict=True):
        assert mine.keys() == theirs.keys()
        for i, r in mine.items():
            assert [getattr(r, x) for x in "ulhdcs"] == pytest.approx([getattr(theirs[i], x) for x in "ulhdcs"], abs=1e-8) and r.reject_reasons == theirs[i].reject_reasons, i
    assert any(r.l == 1.0 for r in one[0].values()) and any(0 < r.l < 1 for r in one[0].values())


def test_held_grams():
    import pyarrow as pa

    rng = random.Random(5)
    words = ["a", "b", "\u0253", "."]
    text = lambda: [rng.choice(words) for _ in range(rng.randrange(14))]
    texts = [text() for _ in range(300)] + [[], ["new", "a", "b", "new"]]
    grams = lambda t, n: {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}
    for held, n, m in (([text() for _ in range(20)], 5, 3), ([text() for _ in range(20)], 2, 4), ([[]], 3, 2), ([], 3, 2), ([["a"], ["a"]], 1, 1)):
        exact, jaccard = HeldGrams(held, n, m).scores(pa.array([["x"], *texts], pa.list_(pa.string())).slice(1))
        for i, t in enumerate(texts):
            mine = grams(t, m)
            assert exact[i] == any(grams(t, n) & grams(x, n) for x in held)
            assert jaccard[i] == pytest.approx(max([len(mine & grams(x, m)) / len(mine | grams(x, m)) for x in held if mine & grams(x, m)], default=0.0))


def test_gram_table(monkeypatch):
    """Any text counts as gram by gram, whatever the size of the table and of the parts."""
    import hashlib

    import numpy as np

    from siftline.functions import embedding as em

    texts = ["", None, "a", "\ud800x\udfff", "\x00\x00\x00", "\u0130stanbul \u00c0", "\U0001f600" * 9, "x" * 300, "\u4e2d\u6587" * 30, "the farmers met, the farmers left"] * 3

    def count(t):
        s, out = f"  {(t or '').lower()}  ", [0] * 16
        for g in [s[i : i + n] for n in (3, 4, 5) for i in range(len(s) - n + 1)]:
            x = int.from_bytes(hashlib.blake2b(g.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
            out[x % 16] += 1 if x >> 63 else -1
        return out

    for places, chunk in ((1 << 22, 512), (8, 4)):
        monkeypatch.setattr(em, "PLACES", places)
        monkeypatch.setattr(em, "CHUNK", chunk)
        monkeypatch.setattr(em, "_MET", {})
        for _ in range(2):
            want = np.array([count(t) for t in texts])
            assert np.allclose(em.hashed(texts, 16), want / np.linalg.norm(want, axis=1, keepdims=True))


def test_command_line(spark, tmp_path):
    """From seeds to evaluation on one cell, by the commands that the plan renders."""
    from siftline.__main__ import main

    at = lambda n: str(tmp_path / n)
    d = "/root/testdata/sf0.01"
    for name in ("manifest", "records", "benchmark"):
        spark.read.parquet(f"{d}/{name}.parquet").write.parquet(at(name))
    (tmp_path / "c.yaml").write_text(f"manifest_path: {at('manifest')}\noutput_dir: {at('runs')}\ntasks: [sentiment_classification]\nlanguages: [swa]\nbudgets: [6]\nmultipliers: [2]\nseeds: [13]\nbaselines: [gold_only, equal_budget]\nseed_sampling: balanced\ngeneration:\n  candidates_per_seed: 2\njudge:\n  backend: heuristic\naudit:\n  embedding_dim: 32\n")
    main(["plan-scenario", "--config", at("c.yaml"), "--out", at("plan")])
    plan = spark.read.parquet(at("plan")).orderBy("step").collect()
    assert [r.stage for r in plan] == ["make-seeds", "generate", "counterfactuals", "judge", "audit", "evaluate", "select", "evaluate"]
    for r in plan:
        words = r.command.split()[3:]
        main(words + (["--manifest", at("manifest")] if r.stage == "counterfactuals" else []))
    base = tmp_path / "runs/scenario/sentiment_classification/swa/b6_m2_s13"
    read = lambda n: spark.read.parquet(str(base / n))
    assert read("gold").count() == 6 and read("candidates_judged").count() == 12 and read("audit").count() == 12 and read("selected/equal_budget").count() <= 12
    r = read("results/equal_budget").first()
    assert r.train_gold == 6 and r.train_synthetic == read("selected/equal_budget").count() and "macro_f1" in r.metrics and read("results/gold_only").first().train_synthetic == 0
    main(plan[1].command.split()[3:])  # resumed: nothing is added
    assert read("candidates").count() == 12
    main(["plan-summary", "--config", at("c.yaml"), "--out", at("summary")])
    main(["plan-training", "--config", at("c.yaml"), "--out", at("training")])
    assert spark.read.parquet(at("summary")).first().cells == 1 and spark.read.parquet(at("training")).count() == 2


def test_means_in_order(spark):
    rows = [("a", 1, 1e16), ("a", 2, 1.0), ("a", 3, 1.0), ("a", 4, -1e16), ("b", 1, 1e16), ("b", 2, -1e16), ("b", 3, 1.0), ("b", 4, 1.0), ("c", 1, None)]
    for n in (1, 3, 8):
        df = spark.createDataFrame(rows[::-1], "g string, k int, x double").repartition(n)
        got = {r.g: (r.rows, r.m) for r in means_in_order(df, ["g"], "k", {"m": F.col("x")}).collect()}
        assert got == {"a": (4, 0.0), "b": (4, 0.5), "c": (1, None)}


def test_exact_mean(spark):
    r = random.Random(2)
    values = {"a": [r.random() for _ in range(3000)], "b": [1e5, 1e-9, -1e5, 0.1], "c": [None, None], "d": [0.5, float("nan")], "e": [float("inf"), 1.0, None]}
    for n in (1, 5):
        df = spark.createDataFrame([(g, x) for g, v in values.items() for x in v], "g string, x double").repartition(n)
        got = {x.g: x.m for x in df.groupBy("g").agg(exact_mean("x").alias("m")).collect()}
        assert got["a"] == float(sum(map(Fraction, values["a"]))) / 3000 and got["b"] == float(sum(map(Fraction, values["b"]))) / 4
        assert got["c"] is None and got["d"] != got["d"] and got["e"] == float("inf")


def test_across_cells_in_any_order(spark):
    # one after another, these add up to something else in either order
    rows = [("s", i, x) for i, x in enumerate([0.107, 0.703, 0.652, 0.94, 0.271, 0.256, 0.734, 0.658])]
    for order in (rows, rows[::-1]):
        got = rp.across_cells(spark.createDataFrame(order, "baseline string, run_id int, proxy_score double").coalesce(1)).first()
        assert (got.n, got.proxy_score) == (8, float(sum(Fraction(x) for _, _, x in rows)) / 8)
