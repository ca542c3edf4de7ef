"""Operators for training data against brute force, exact libraries and held-out rows, and on awkward inputs."""

import collections
import random
import re
from statistics import NormalDist

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftline.llm import calibration, capping, languages, leakage, quality, ranking, tokenizing, truncation, varied
from siftline.llm.tables import label_key, latest_audit, seed_key, table

DATA = "/root/testdata/sf0.001"


def extra(df):
    """Columns that nothing may trip over."""
    return df.withColumns({c: F.lit("x") for c in ("rank", "kept", "n", "language_", "_rows", "ids", "_part") if c not in df.columns})


def water_fill(counts, share):
    if max(counts) <= share * sum(counts) + 1e-9:
        return None
    ok = [c for c in range(1, max(counts) + 1) if c <= share * sum(min(n, c) for n in counts) + 1e-9]
    return max(ok, default=1)


def test_share_levels(spark):
    r = random.Random(2)
    groups = {f"g{i}": [max(1, int(r.paretovariate(0.7))) % 500 + 1 for _ in range(r.randint(1, 30))] for i in range(40)}
    rows = [(g, f"s{i}", n) for g, ns in groups.items() for i, n in enumerate(ns)]
    for share in (0.05, 0.2, 0.5):
        counts = spark.createDataFrame(rows, "g string, s string, n bigint")
        got = {x.g: x for x in capping.fill_levels(counts, "g", "n", share).collect()}
        assert {g: x.level for g, x in got.items()} == {g: water_fill(ns, share) for g, ns in groups.items()}
        for g, ns in groups.items():
            left = [min(n, got[g].level or n) for n in ns]
            assert got[g].filled == sum(left) and got[g].top_share == pytest.approx(max(left) / sum(left))
        limits = {g: i % 7 + 1 for i, g in enumerate(groups)}
        both = {x.g: x.level for x in capping.fill_levels(counts, "g", "n", share, spark.createDataFrame(list(limits.items()), "g string, limit int")).collect()}
        for g, ns in groups.items():
            share_level, count_level = water_fill(ns, share), limits[g] if max(ns) > limits[g] else None
            assert both[g] == min((x for x in (share_level, count_level) if x is not None), default=None)


def test_consistent_pool(spark):
    r = random.Random(3)
    rows = [("g", s, f"r{i:03d}") for i in range(300) for s in {f"s{min(39, int(r.expovariate(0.06)))}" for _ in range(r.randint(1, 3))}]
    q = spark.createDataFrame([(f"r{i:03d}", r.random()) for i in range(300)], "id string, q double")
    pool = {x.id for x in capping.consistent_pool(extra(spark.createDataFrame(rows, "g string, s string, id string")), q, "g", "s", "id", "q", 0.08).collect()}
    n = collections.Counter(s for _, s, i in rows if i in pool)
    assert 100 < len(pool) < 300 and max(n.values()) <= max(1, 0.08 * sum(n.values()) + 1e-9)
    assert capping.consistent_pool(spark.createDataFrame([], "g string, s string, id string"), q, "g", "s", "id", "q", 0.1).count() == 0


def test_caps_come_from_the_levels(spark, monkeypatch):
    whole = capping.fill_levels
    monkeypatch.setattr(capping, "fill_levels", lambda *a, **k: whole(*a, **k).withColumn("level", F.lit(None).cast("long")))
    assert capping.p1_found(spark, DATA).count() == 0


def test_cap_contributors(spark):
    rows = [("g", "hot", f"r{i:03d}") for i in range(40)] + [("g", "cold", "r000"), ("g", "hot", "r000"), (None, "hot", "r1"), ("g", None, "r1"), ("g", "hot", None)]
    q = [(f"r{i:03d}", [None, float("nan"), 1.0, 2.0][i % 4]) for i in range(30)]
    cites, best = extra(spark.createDataFrame(rows, "g string, s string, id string")), spark.createDataFrame(q, "id string, q double")
    limit = spark.createDataFrame([("g", 5)], "g string, limit bigint")
    got = capping.cap_contributors(cites, best, "g", "s", "id", "q", max_count=limit)
    assert sorted(r.id for r in got.filter("kept").collect()) == ["r003", "r007", "r011", "r015", "r019"]
    assert got.count() == 40
    assert capping.cap_contributors(cites.filter("false"), best, "g", "s", "id", "q", max_count=limit).count() == 0


def test_keys(spark):
    same = ["sahel/newsbank:swa:train:91", "SAHEL/NEWSBANK:SWA:TRAIN:00091\t", " sahel/newsbank|swa|Train|91 "]
    assert len({r.k for r in spark.createDataFrame([(x,) for x in same], "s string").select(seed_key(F.col("s")).alias("k")).collect()}) == 1
    labels = ["Health ", "health.", " HEALTH\n", "​health"]
    assert {r.k for r in spark.createDataFrame([(x,) for x in labels], "s string").select(label_key(F.col("s")).alias("k")).collect()} == {"health"}


def test_varied(spark):
    r = random.Random(4)
    vocabulary = [f"word{i}" for i in range(400)]
    base = [r.choice(vocabulary) for _ in range(40)]

    def reworked():
        w = list(base)
        for _ in range(4):
            w[r.randrange(40)] = r.choice(vocabulary)
        return " ".join(w).upper() if r.random() < 0.5 else ", ".join(w)

    rows = [("a", f"c{i:03d}", reworked()) for i in range(90)] + [("a", f"d{i:03d}", " ".join(r.choice(vocabulary) for _ in range(40))) for i in range(60)] + [("a", "e1", None), ("a", "e2", ""), ("a", "e3", "!!"), (None, "f", "x"), ("a", None, "x"), ("a", "c000", None)]
    df = extra(spark.createDataFrame(rows[:-1], "g string, id string, t string"))
    for block in (1000, 25):
        got = {x.record: (x.crowd, x.members) for x in varied.crowds(df, "g", "id", "t", block_rows=block).collect()}
        assert all(got[f"c{i:03d}"] == ("c000", 90) for i in range(90)) and got["d000"] == ("d000", 1) and got["e1"] == ("e1", 1)
    budget = spark.createDataFrame([("a", 20)], "g string, budget int")
    for block in (1000, 50):
        chosen = [x.record for x in varied.varied_subset(df, "g", "id", "t", budget, block_rows=block).collect()]
        assert len(chosen) == len(set(chosen)) == 20 and sum(c[0] == "c" for c in chosen) <= 2
    for many in (55, 400):  # beyond half a block the budget is shared out over blocks
        got = [x.record for x in varied.varied_subset(df, "g", "id", "t", spark.createDataFrame([("a", many)], "g string, budget int"), block_rows=50).collect()]
        assert len(got) == len(set(got)) == min(many, 153)
    assert varied.crowds(df.filter("false"), "g", "id", "t").count() == 0 == varied.varied_subset(df.filter("false"), "g", "id", "t", budget).count()


def test_subset_is_one_method_for_any_size(spark, monkeypatch):
    r = random.Random(6)
    vocabulary = [f"word{i}" for i in range(300)]
    rows = []
    for c in range(40):
        base = [r.choice(vocabulary) for _ in range(30)]
        for i in range(r.choice([1, 1, 2, 7])):
            w = list(base)
            w[r.randrange(30)] = r.choice(vocabulary)
            rows.append(("a", f"c{c:02d}{i}", " ".join(w)))
    df = spark.createDataFrame(rows, "g string, id string, t string")
    d = varied._distances(*varied.overlaps([t for _, _, t in rows])).astype(float)
    place = {i: n for n, (_, i, _) in enumerate(rows)}

    def subset(k, block):
        budget = spark.createDataFrame([("a", k)], "g string, budget int")
        return {x.record for x in varied.varied_subset(df, "g", "id", "t", budget, block_rows=block).collect()}

    for k in (20, 40, 50):  # less than half a block of 1000, more than half a block of 14
        whole = subset(k, 1000)
        # every crowd once before any twice, whatever the parts
        assert len(whole) == k and len({i[:3] for i in whole}) == min(k, 40) and subset(k, 14) == whole
    monkeypatch.setattr(varied, "SWAPS", 2)  # several rounds
    got = subset(20, 14)
    first = {x.record for x in varied.varied_subset(df, "g", "id", "t", spark.createDataFrame([("a", 40)], "g string, budget int")).collect()}
    a, b = [place[i] for i in sorted(got)], [place[i] for i in sorted(first - got)]
    total = d[:, a].sum(1)
    assert len(got) == 20 and got < first and (total[b][None, :] - d[np.ix_(a, b)] - total[a][:, None]).max() <= 1e-6


def test_crowds_across_blocks(spark, monkeypatch):
    # chains of texts that are like their neighbours only, and texts of one word
    rows = [("a", f"c{c}{i:03d}", " ".join(f"x{c}y{j}" for j in range(2 * i, 2 * i + 16 + i % 3))) for c in range(3) for i in range(50)]
    rows += [("a", f"s{i:03d}", "Ok!" if i % 2 else "ok") for i in range(30)] + [("a", f"u{i:03d}", f"alone{i}") for i in range(20)]
    df = spark.createDataFrame(rows, "g string, id string, t string")
    want = {i: ((i[:2] + "000", 50) if i[0] == "c" else ("s000", 30) if i[0] == "s" else (i, 1)) for _, i, _ in rows}
    for block, bucket in ((1000, 64), (20, 64), (20, 3)):
        monkeypatch.setattr(varied, "BUCKET", bucket)
        got = {x.record: (x.crowd, x.members) for x in varied.crowds(df, "g", "id", "t", block_rows=block).collect()}
        assert got == want


def test_core_set():
    rng = np.random.default_rng(7)
    x = rng.random((60, 2))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    cover = varied.core_set(d, d <= 0.2)
    core = set(cover)
    assert all(cover[c] == c for c in core) and all(d[i, c] <= 0.2 for i, c in enumerate(cover))
    assert all(d[a, b] > 0.2 for a in core for b in core if a != b) and varied.core_set(np.zeros((0, 0)), np.zeros((0, 0), bool)) == []


def test_crowds_come_from_the_core_set(spark, monkeypatch):
    before = varied._crowds(["a", "b", "c", "d"], ["x y z", "x y z", "p q r", "p q r"])
    monkeypatch.setattr(varied, "core_set", lambda distance, near: list(range(len(distance))))
    monkeypatch.setattr(varied, "similar", lambda common, sizes: np.eye(len(sizes), dtype=bool))
    assert before == ["a", "a", "c", "c"] != varied._crowds(["a", "b", "c", "d"], ["x y z", "x y z", "p q r", "p q r"])


def test_overlaps_in_feature_blocks(monkeypatch):
    r = random.Random(8)
    texts = [" ".join(r.choice("abcdefghij") for _ in range(r.randint(0, 30))) for _ in range(40)] + [None, ""]
    whole, sizes = varied.overlaps(texts)
    monkeypatch.setattr(varied, "FEATURES", 7)
    assert (varied.overlaps(texts)[0] == whole).all()


def test_swaps_end_at_a_local_optimum():
    rng = np.random.default_rng(9)
    x = rng.random((200, 3))
    d = np.linalg.norm(x[:, None] - x[None], axis=2).astype(np.float32)
    got = varied.disperse(d, 90)
    inside = np.isin(np.arange(200), got)
    total = d[:, inside].sum(1)
    gain = total[~inside][None, :] - d[np.ix_(np.nonzero(inside)[0], np.nonzero(~inside)[0])] - total[inside][:, None]
    assert gain.max() <= 1e-3


def test_disperse():
    rng = np.random.default_rng(5)
    x = rng.random((12, 2))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    from itertools import combinations

    best = max(sum(d[a, b] for a, b in combinations(c, 2)) for c in combinations(range(12), 4))
    got = varied.disperse(d, 4)
    assert sum(d[a, b] for a, b in combinations(got, 2)) > 0.95 * best
    assert varied.disperse(d, 0) == [] and len(varied.disperse(d, 50)) == 12


def test_inverse_normal(spark):
    ps = [1e-6, 0.01, 0.0242, 0.1, 0.5, 0.7, 0.99, 1 - 1e-6]
    got = [r.z for r in spark.createDataFrame([(p,) for p in ps], "p double").select(ranking.inverse_normal(F.col("p")).alias("z")).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(p) for p in ps], abs=1e-7)


def test_combined_scores(spark):
    r = random.Random(6)
    rows = [(g, f"{g}{i}", r.choice([1.0, 2.0, 3.0]), r.random() ** 4 * 1e6) for g in "ab" for i in range(40)] + [("a", "n", None, 1.0), ("a", "m", float("nan"), 1.0)]
    rows += [("b", f"b{i}", 2.0, float(i)) for i in range(100, 130)]
    z = NormalDist().inv_cdf
    for split in (1000, 50):  # by windows, and the larger group in ranges
        got = {x.id: x.score for x in ranking.combined_scores(extra(spark.createDataFrame(rows, "g string, id string, u double, l double")), "g", "id", {"u": 1.0, "l": -1.0}, split).collect()}
        for g in "ab":
            mine = [x for x in rows if x[0] == g and x[2] is not None and x[2] == x[2]]
            for _, i, u, low in mine:
                p = lambda v, k: (sum(y[k] < v for y in mine) + sum(y[k] == v for y in mine) / 2) / len(mine)  # noqa: B023, E731
                assert got[i] == pytest.approx((z(p(u, 2)) - z(p(low, 3))) / 2, abs=1e-6)
    assert "n" not in got and "m" not in got


def test_close_scores_keep_their_order(spark):
    # scores that differ in the ninth digit only
    n = 2000
    df = spark.createDataFrame([(1, f"c{i:05d}", float(i)) for i in range(n)], "g int, id string, u double")
    z = ranking.combined_scores(df, "g", "id", {"u": 1.0}).orderBy("score").collect()
    assert [x.id for x in z] == sorted(x.id for x in z)


def test_latest_audit(spark):
    rows = [("a", (1.0,), 1, 5), ("a", (2.0,), 2, 1), ("a", (2.0,), 2, 1), (None, (3.0,), 9, 9), ("b", None, 1, 1)]
    df = spark.createDataFrame(rows, "candidate_id string, scores struct<s: double>, audited_at int, ingested_at int")
    assert {r.candidate_id: r.s for r in latest_audit(df, "s").collect()} == {"a": 2.0, "b": None}


def test_tilt():
    t = lambda *x: calibration.tilt(*map(np.array, x[:3]), x[3])
    assert t([100, 100], [0.3, 0.7], [0, 0], 50)[0] == pytest.approx([15, 35])
    assert t([5, 100, 100], [0.5, 0.25, 0.25], [0, 0, 0], 40)[0] == pytest.approx([5, 17.5, 17.5])
    assert t([50, 100], [0.01, 0.99], [6, 1], 60)[0] == pytest.approx([6, 54])
    assert t([0, 0], [0.5, 0.5], [1, 1], 10)[0] == pytest.approx([0, 0])
    draw, gap, why = t([100, 100, 100], [0.4, 0.3, 0.3], [10, 10, 10], 20)  # floors beyond the size
    assert draw.sum() == pytest.approx(20) and list(gap) == [0, 0, 0] and set(why) == {"floors"}
    draw, gap, why = t([100, 100], [0.8, 0.2], [0, 15], 20)  # another category's floor
    assert draw == pytest.approx([5, 15]) and list(why) == ["floors", ""]
    draw, gap, why = t([11, 100], [0.6, 0.4], [0, 15], 20)
    assert draw == pytest.approx([5, 15]) and list(gap) == [1, 0] and list(why) == ["available", ""]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 9), st.integers(0, 8)), min_size=1, max_size=8), st.integers(1, 80))
def test_tilt_by_bisection(rows, size):
    n, s, low = (np.array(x, float) for x in zip(*rows))
    if not s.sum():
        return
    s, floor = s / s.sum(), np.minimum(low, n)
    draw = calibration.tilt(n, s, low, size)[0]
    assert (draw <= n + 1e-6).all() and draw.sum() <= size + 1e-6
    if floor.sum() <= size:
        assert (draw >= floor - 1e-6).all()
        lo, hi = 0.0, 1e9
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if np.clip(s * mid, floor, n).sum() < min(size, np.where(s > 0, n, floor).sum()) else (lo, mid)
        want = np.clip(s * hi, floor, n)
        assert draw[s > 0] == pytest.approx(want[s > 0], abs=1e-4)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=30), st.integers(0, 1000))
def test_pivotal_size(p, seed):
    got = calibration.pivotal(np.array(p), seed)
    assert abs(got.sum() - sum(p)) < 1 + 1e-6
    assert all(g for g, x in zip(got, p) if x == 1) and not any(g for g, x in zip(got, p) if x == 0)


def test_pivotal_probabilities():
    p = np.array([0.2, 0.5, 0.9, 0.4, 1.0, 0.0])
    hits = sum(calibration.pivotal(p, s).astype(int) for s in range(4000)) / 4000
    assert hits == pytest.approx(p, abs=0.04)


def test_draw_samples(spark, monkeypatch):
    monkeypatch.setattr(calibration, "PART_ROWS", 30)
    rows = [("p", lab, f"{lab}{i:03d}") for lab, n in (("a", 100), ("b", 40), ("c", 2)) for i in range(n)]
    counts = spark.createDataFrame([("p", "a", 0.2, 1, 50, 100), ("p", "b", 0.7, 1, 50, 40), ("p", "c", 0.1, 4, 50, 2), ("q", "a", 1.0, 1, 5, 0)], "pool string, lab string, target_share double, min_count bigint, sample_size bigint, available bigint")
    plan = calibration.plan_samples(counts, ["pool"], "lab")
    assert {(r.pool, r.lab): r.gap for r in plan.collect()} == {("p", "a"): 0, ("p", "b"): 0, ("p", "c"): 3, ("q", "a"): 5}
    got = calibration.draw_samples(spark.createDataFrame(rows, "pool string, lab string, id string"), plan, ["pool"], "lab", "id").collect()
    n = collections.Counter(r.lab for r in got)
    assert len(got) == len({r.id for r in got}) == 50 and n["c"] == 2 and abs(n["a"] - 48 * 2 / 9) <= 1 and abs(n["b"] - 48 * 7 / 9) <= 1


TEXTS = ["Wakulima 52 kutoka Fonga wanasubiri kocha mpya katika wilaya ya Rubo.", "ከስበያዝ የመጡ 64 ገበሬዎች", "a" * 5000, "I'll  don't\n\n\t x", "Ọjọ́ 🤷🏽‍♀️  ok", " ", "\n", "<|endoftext|>"]


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=tokenizing.PATTERN, mergeable_ranks=tokenizing.load_ranks(tokenizing.VOCABULARY), special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_tokens_equal_tiktoken(tiktoken_encoding, text):
    import regex

    pieces = tokenizing.pieces_of(tokenizing.VOCABULARY)
    assert [i for p in regex.findall(tokenizing.PATTERN, text) for i in pieces[p]] == tiktoken_encoding.encode_ordinary(text)


def test_encode_corpus(spark, tiktoken_encoding):
    df = extra(spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, "", None, TEXTS[0]])] + [(None, "x")], "k bigint, text string")).drop("ids")
    got = {r.k: list(r.ids) for r in tokenizing.encode_corpus(df, "k", "text").collect()}
    assert all(got[i] == tiktoken_encoding.encode_ordinary(t) for i, t in enumerate(TEXTS)) and got[8] == got[9] == []
    assert tiktoken_encoding.decode(got[0]) == TEXTS[0]
    assert tokenizing.encode_corpus(df.filter("false"), "k", "text").count() == 0


def test_merges_by_brute_force():
    ranks = tokenizing.load_ranks(tokenizing.VOCABULARY)
    r = random.Random(8)
    for _ in range(300):
        piece = "".join(r.choice("aabeinst é ሀ") for _ in range(r.randint(1, 25))).encode()
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            pairs = [(ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            if not pairs or min(pairs)[0] == 1 << 60:
                break
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert tokenizing.merge_ids(piece, ranks) == [ranks[p] for p in parts]


def naive_leak(doc, item):
    for s in range(-len(item), len(doc)):
        m = [0 <= s + x < len(doc) and item[x] == doc[s + x] for x in range(len(item))]
        inside = [0 <= s + x < len(doc) for x in range(len(item))]
        e = min(leakage.EXACT_WORDS, len(item))
        if any(all(m[x : x + e]) for x in range(len(m) - e + 1)):
            return True
        n = leakage.NEAR_WORDS
        if any(sum(m[x : x + n]) >= n - leakage.NEAR_REPLACED and all(inside[x : x + n]) for x in range(len(m) - n + 1)):
            return True
    return False


def test_leaks(spark):
    r = random.Random(9)
    words = [f"w{i}" for i in range(12)] + [f"rare{i}" for i in range(100)]
    items = [[r.choice(words) for _ in range(r.choice([2, 4, 8, 15, 25, 40]))] for _ in range(25)]
    docs = []
    for _ in range(120):
        it = r.choice(items)
        a = r.randrange(len(it))
        part = [r.choice(words) if r.random() < r.choice([0, 0.1, 0.2]) else w for w in it[a : a + r.choice([5, 11, 12, 19, 20, 30])]]
        docs.append([r.choice(words) for _ in range(r.randint(0, 6))] + part + [r.choice(words) for _ in range(r.randint(0, 6))])
    want = {(d, i) for d, w in enumerate(docs) for i, it in enumerate(items) if naive_leak(w, it)}
    dd = extra(spark.createDataFrame([(i, " <b>".join(x.upper() for x in w) + "!") for i, w in enumerate(docs)] + [(900, None), (901, ""), (902, "?!")], "k bigint, t string"))
    ii = extra(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(900, None), (901, "...")], "item bigint, t string"))
    for block in (1000, 7):
        assert {(x.k, x.item) for x in leakage.leaks(dd, "k", "t", ii, "item", "t", block_items=block).collect()} == want
    assert leakage.leaks(dd.filter("false"), "k", "t", ii, "item", "t").count() == 0 == leakage.leaks(dd, "k", "t", ii.filter("false"), "item", "t").count()


def test_long_near_leaks(spark):
    r = random.Random(21)
    items = [[f"i{i}x{j}" for j in range(60)] for i in range(30)]
    docs, want = [], set()
    for d in range(400):
        i, n = r.randrange(30), r.randint(20, 50)
        a = r.randrange(60 - n + 1)
        part = items[i][a : a + n]
        for x in r.sample(range(n), r.randint(2, n // 6)):
            part[x] = "other"
        same = [x != "other" for x in part]
        docs.append(["before"] * r.randint(0, 9) + part + ["after"])
        ends = [(x, y) for x in range(n) for y in range(x + 12, n + 1)]
        if any(all(same[x:y]) or (y - x >= 20 and 7 * same[x:y].count(False) <= y - x) for x, y in ends):
            want.add((d, i))
    for at, leak in (((6, 12, 18), True), ((4, 8, 12, 16, 20), False)):
        docs.append([("other" if x in at else w) for x, w in enumerate(items[0][:24])])
        want |= {(len(docs) - 1, 0)} if leak else set()
    dd = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "k bigint, t string")
    ii = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item bigint, t string")
    for block in (20_000, 10):  # by the index, and by joins
        assert {(x.k, x.item) for x in leakage.leaks(dd, "k", "t", ii, "item", "t", block_items=block).collect()} == want and 100 < len(want) < 400


def test_leak_words():
    w = leakage.Words()
    assert w("Ó ti sú <i>mi</i> ɗan sa'o'i co­op &amp; x—y") == ["o", "ti", "su", "mi", "dan", "saoi", "coop", "x", "y"]
    assert w("ከስበያዝ፡የመጡ።") == ["ከስበያዝ", "የመጡ"]


def test_endings():
    e = truncation.Endings()
    kinds = {
        "The bus left.": truncation.WHOLE, "Good work! 🔥": truncation.WHOLE, "he said so #tag": truncation.WHOLE, "see https://s.a.example/ab12": truncation.WHOLE, "so [variant 2]": truncation.WHOLE, "it was. (…": truncation.WHOLE, "": truncation.WHOLE, "ነው።": truncation.WHOLE, "“so.”": truncation.WHOLE,
        "the bus &quo": truncation.CUT, "the bus �": truncation.CUT, "the bus <br": truncation.CUT, "the \\u1": truncation.CUT, "see https://s.a.ex": truncation.CUT, "the bus,": truncation.CUT,
        "the bus le": truncation.OPEN, "the bus le[…]": truncation.DOTTED, "the bus left...": truncation.DOTTED,
    }
    assert {t: e.kind(t)[0] for t in kinds} == kinds


def test_truncated(spark):
    r = random.Random(10)
    subjects, verbs, places = ["the farmers", "the council", "many families", "young people"], ["rejected the plan", "praised the coach", "asked about the film"], ["near the old bridge", "in the district", "at the hall"]
    sentence = lambda: f"{r.choice(subjects)} {r.choice(verbs)} {r.choice(places)}".capitalize()
    rows, cut = [], set()
    for i in range(600):
        t = f"{sentence()}. {sentence()}"
        if i % 10 == 0:
            t, k = t[:50], f"r{i}"
            if not t.endswith((".", "bridge", "district", "hall")):
                cut.add(k)
        elif i % 3:
            t += "."
        rows.append((f"r{i}", "gen", t))
    rows += [("n1", "gen", None), ("n2", None, "  "), ("r1", "gen", rows[1][2]), (None, "gen", "x")]
    got = truncation.truncated(extra(spark.createDataFrame(rows, "id string, g string, t string")), "id", "t", "g").collect()
    found = {x.record for x in got if x.cut}
    assert len(got) == 602 and len(found & cut) >= 0.95 * len(cut) and len(found - cut) <= 3
    assert truncation.truncated(spark.createDataFrame([], "id string, g string, t string"), "id", "t", "g").count() == 0


def test_length_hazards(spark):
    r = random.Random(12)
    stops = [("a", 280, True)] * 500 + [("a", 285, True)] * 8 + [("a", 400, True)] * 2
    stops += [("b", r.randint(1, 60), r.random() < 0.5) for _ in range(300)] + [("b", 9, True)] * 90 + [("c", 1, True)] * 4
    every = truncation.length_hazards(spark.createDataFrame(stops, "s string, k int, open boolean"), F.col("open"), "s", "k")
    assert every.count() == len({x[:2] for x in stops})
    got = every.filter("significant").collect()
    assert {(x.s, x.k) for x in got} == {("a", 280), ("a", 285), ("b", 9)}
    tested = {}
    for s, k, o in stops:
        if o:
            reach = lambda x, s=s: sum(a == s and b >= x for a, b, _ in stops)
            around = [x for x in range(max(1, k - truncation.NEIGHBOURS), k + truncation.NEIGHBOURS + 1) if x != k]
            n, others = (sum(c and a == s and b in at for a, b, c in stops) for at in ([k], around))
            e = max(0.05, (others + 1) / max(1, sum(reach(x) for x in around)) * reach(k))
            tested[s, k] = min(1.0, np.exp(n - e - n * np.log(n / e))) if n > e else 1.0
    assert all(x.p == pytest.approx(tested[x.s, x.k], rel=1e-6) for x in got)


def test_truncated_without_source(spark):
    r = random.Random(13)
    sentence = lambda: " ".join(r.choice(["bus", "road", "farm", "council", "market"]) for _ in range(5))
    rows = []
    for i in range(400):
        t = f"The {sentence()} {'.' * r.randint(0, 1)}The {sentence()} reached Abuja"
        rows.append((f"c{i}", (t * 3)[:60] + "Abuja" if i % 5 == 0 else t + "." * (i % 3)))
    for g in ("gen", None):
        got = truncation.truncated(spark.createDataFrame([(i, g, t) for i, t in rows], "id string, g string, t string"), "id", "t", "g").collect()
        assert {x.source for x in got} == {g} and len(got) == 400
        assert {int(x.record[1:]) % 5 for x in got if x.cause == "limit"} >= {0} and all(x.cut for x in got if int(x.record[1:]) % 5 == 0)


def test_hazards_decide(spark, monkeypatch):
    texts = ["The old road and the new market reached the town of Abuja"] * 40 + ["The bus left the town of Abuja" + " today" * k + "." for k in range(40)]
    df = spark.createDataFrame([(str(i), "g", t) for i, t in enumerate(texts)], "id string, g string, t string")
    assert truncation.truncated(df, "id", "t", "g").filter("cause = 'limit'").count() == 40
    whole = truncation.length_hazards
    monkeypatch.setattr(truncation, "length_hazards", lambda *a: whole(*a).withColumn("significant", F.lit(False)))
    none = truncation.truncated(df, "id", "t", "g").filter("cut").collect()
    monkeypatch.setattr(truncation, "length_hazards", lambda *a: whole(*a).filter("false"))
    assert not [x for x in none if x.cause == "limit"] and truncation.truncated(df, "id", "t", "g").filter("cut").count() == 0


def test_length_limits_in_bytes_and_characters(spark):
    r = random.Random(15)
    sentence = lambda a: " ".join(r.choice(a) for _ in range(r.randint(4, 9))) + ". "
    plain, marked = [f"word{i}" for i in range(60)], [f"wọ́rd{i}" for i in range(60)]
    rows, cut = [], set()
    for i in range(900):
        t = "".join(sentence(marked if i % 2 else plain) for _ in range(r.randint(2, 8))).strip()
        if i % 9 == 0 and len(t) > 120:
            t, g = (t[:120], "chars") if i % 18 else (t.encode()[:160].decode("utf-8", "ignore"), "bytes")
            cut |= {str(i)} if not t.rstrip().endswith(".") else set()
        rows.append((str(i), "chars" if i % 18 else "bytes", t))
    got = {x.record for x in truncation.truncated(spark.createDataFrame(rows, "id string, g string, t string"), "id", "t", "g").filter("cut").collect()}
    assert len(got & cut) >= 0.95 * len(cut) and len(got - cut) <= 0.05 * len(cut) and len(cut) > 40


def test_languages_held_out(spark):
    samples = languages.trusted_texts(table(spark, DATA, "lang_samples").filter("sample_id % 4 <> 0"), "language", "text")
    held = table(spark, DATA, "lang_samples").filter("sample_id % 4 = 0")
    got = languages.label_languages(held.select(F.struct("sample_id", F.col("language").alias("true")).alias("k"), "text"), "k", "text", samples).collect()
    assert sum(r.language == r.k.true for r in got) >= 0.97 * len(got)
    a, b = held.filter("language = 'hau'").first().text, held.filter("language = 'amh'").first().text
    mixed = [("1", f"{a} {b}"), ("2", None), ("3", "  "), ("4", "12 34"), ("5", a * 300), ("1", f"{a} {b}")]
    rows = languages.label_languages(extra(spark.createDataFrame(mixed, "k string, text string")), "k", "text", samples).collect()
    one = {r.k: r for r in rows}
    assert one["1"].languages == ["amh", "hau"] and [s.language for s in one["1"].segments] == ["hau", "amh"] and len(rows) == 6
    assert all(one[k].language == "und" and not one[k].languages for k in "234") and one["5"].language == "hau"
    assert languages.label_languages(held.select("language", "text").filter("false"), "language", "text", samples).count() == 0


def test_scripts(spark):
    samples = languages.trusted_texts(table(spark, DATA, "lang_samples"), "language", "text")
    c = languages.Compressors(samples)
    for text in ("يجتمع المجلس في المدينة غدا صباحا للحديث عن الطريق", "Совет собрался сегодня утром в старом городе у реки", "委员会今天早上在城里开会讨论新的道路"):
        assert c.label(text)[0] == "und" and not c.label(text)[2]
    amh = next(r.text for r in table(spark, DATA, "lang_samples").filter("language = 'amh'").collect())
    assert c.label(amh)[0] == "amh" and languages.script("ሀለ a б") == "ETHIOPIC" and languages.script("12") == ""
    df = spark.createDataFrame([("xyz",), ("ha",)], "n string").select(languages.named_language(F.col("n"), ["xyz", "hau"]).alias("l"))
    assert [r.l for r in df.collect()] == ["xyz", "hau"]


def test_valley():
    r = np.random.default_rng(3)
    bins = lambda x: dict(collections.Counter(np.clip(np.floor(quality.BINS * (np.log2(np.maximum(x * x, 2.0**-8)) + 8)), 0, 255).astype(int).tolist()))
    prose, junk = np.sqrt(r.chisquare(8, 5000)), r.normal(18, 3, 400)
    assert 5 < quality.valley(bins(np.concatenate([prose, junk]))) < 12
    assert quality.valley(bins(prose)) == quality.valley({}) == quality.NO_PROSE


def test_fit_prose_by_numpy(spark):
    r = np.random.default_rng(5)
    x = r.multivariate_normal(np.arange(8.0), np.diag(np.linspace(1, 3, 8)), 3000)
    x[:200] += 40
    df = spark.createDataFrame([("a", v.tolist(), i) for i, v in enumerate(x)], "language string, x array<double>, k int")
    mean, inverse = quality.fit_prose(df)["a"]
    assert np.abs(np.array(mean) - np.arange(8)).max() < 0.15 and np.abs(np.linalg.inv(np.array(inverse)) - np.cov(x[200:].T)).max() < 0.6
    rows = df.select("k", *[F.lit(1.0).alias(c) for c in quality._COLUMNS], F.when(F.col("k") % 2 == 0, "a").otherwise("other").alias("language"), F.when(F.col("k") != 7, F.col("x")).alias("x"))
    got = {q.k: q for q in quality.with_distance(rows, "k", {"a": (mean, inverse)}).collect()}
    off = x[9] - np.array(mean)
    assert got[9].squared == pytest.approx(off @ np.array(inverse) @ off) and sum(got[9].parts) == pytest.approx(got[9].squared) and got[9].language is None and got[8].language == "a" and got[7].squared is None


def test_named_language(spark):
    names = {"hau": "hau", " Yor": "yor", "sw-KE": "swa", "swh_Latn": "swa", "Kiswahili": "swa", "amh_Ethi": "amh", "FRA": "fra", "und": None, "": None, None: None}
    df = spark.createDataFrame([(k,) for k in names], "n string").select("n", languages.named_language(F.col("n")).alias("l"))
    assert {r.n: r.l for r in df.collect()} == names


def test_prose(spark):
    words = {r.language: r.w for r in table(spark, DATA, "common_words").groupBy("language").agg(F.collect_list("word").alias("w")).collect()}
    docs = table(spark, DATA, "documents").select("doc_id", "text")
    bad = [(10**9 + i, t) for i, t in enumerate(["\n".join(f"{r},{r * 7},0.{r}" for r in range(40)), "#a #b #c " * 30, "same words again " * 60, "==== ****\n" * 30, "- milk\n- tea\n- bread\n" * 10])]
    rows = [*bad, (10**9 + 10, None), (10**9 + 11, ""), (10**9 + 12, " \n"), (10**9 + 13, "12")]
    got = {r.doc_id: r for r in quality.prose_distances(extra(docs.unionByName(spark.createDataFrame(rows, "doc_id bigint, text string"))), "doc_id", "text", words).collect()}
    assert not any(got[k].natural for k, _ in bad) and all(got[10**9 + i].natural is None for i in (10, 11, 12))
    real = [got[r.doc_id].natural for r in docs.collect() if r.text and r.text.strip()]
    assert 0.7 < sum(map(bool, real)) / len(real) < 0.99
    some = next(r for r in got.values() if r.natural)
    assert sum(some.contribution.values()) == pytest.approx(1, abs=1e-6)
    assert quality.prose_distances(docs.filter("false"), "doc_id", "text", words).count() == 0


def test_statistics():
    s = quality.Statistics({"eng": ["the", "of"], "hau": ["da"]})("The cat of the house.\n12 <b>x</b> https://a.b/c")
    n, length, symbols, lines, common, digits, pairs, per, language = s
    assert (n, lines, language) == (7, 0.5, "eng") and common == pytest.approx(3 / 7) and digits == pytest.approx(1 / 7) and length == pytest.approx(sum(map(len, "the cat of the house 12 x".split())) / 7)
    assert quality.Statistics({})("  \n") is None


def test_library_is_whole_without_this():
    import pathlib

    root = pathlib.Path(capping.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.parts[len(root.parts) :]:
            assert not re.search(r"siftline\.llm|from siftline import llm", p.read_text(encoding="utf-8")), p
