"""Problem 2: crowds by core-sets of blocks, and a varied subset by max-sum dispersion over whole groups."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftline.llm.languages import fold
from siftline.llm.tables import table
from siftline.operators.grouping import top_k
from siftline.operators.staging import written

#: Records of a group that one task compares with each other.
BLOCK_ROWS = 1000
#: Jaccard similarity of two texts' words and neighbouring word pairs from which they are reworkings of one text.
REWORKED = 0.5
#: Texts in a bucket of a rare feature that are compared pair by pair; those of larger buckets are compared block by block.
BUCKET = 64
CROWD = 6
#: Features that are compared at once.
FEATURES = 4096
#: Chosen records, and others, of a group between which one round swaps; a constant, so that rounds don't depend on the blocks.
SWAPS = 500
#: Whole units of a distance of 1: their sums are exact in double precision, in any order.
UNIT = 1 << 30


def overlaps(texts: list[str | None]):
    """Common words and neighbouring word pairs of every two texts, and how many each has, without case, marks and blanks."""
    import numpy as np

    find = re.compile(r"\w+").findall
    known: dict[str, int] = {}
    words: list[int] = []
    lengths = []
    for t in texts:
        w = find(fold(t)[1].decode("utf-8", "replace")) if t else []
        words += [known.setdefault(x, len(known)) for x in w]
        lengths.append(len(w))
    n, many = len(texts), len(known)
    flat, row = np.array(words, np.int64), np.repeat(np.arange(n), lengths)
    same = row[1:] == row[:-1]
    pairs = (flat[:-1] * many + flat[1:] + many)[same]
    codes, inverse = np.unique(np.concatenate([flat, pairs]), return_inverse=True)
    cell = np.unique(np.concatenate([row, row[1:][same]]) * max(1, len(codes)) + inverse)
    row, column = cell // max(1, len(codes)), cell % max(1, len(codes))
    sizes = np.bincount(row, minlength=n).astype(np.float32)
    shared = np.bincount(column, minlength=len(codes)) > 1  # others are in one text only
    keep = shared[column]
    row, column = row[keep], (np.cumsum(shared) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((n, n), np.float32)
    # feature by feature block, so that memory doesn't grow with the length of the texts
    for lo in range(0, int(shared.sum()), FEATURES):
        a, b = np.searchsorted(column, [lo, lo + FEATURES])
        m = np.zeros((n, min(FEATURES, int(shared.sum()) - lo)), np.float32)
        m[row[a:b], column[a:b] - lo] = 1.0
        common += m @ m.T
    np.fill_diagonal(common, sizes)
    return common, sizes


def components(n: int, pairs) -> list[int]:
    """The smallest member of the component of each of n nodes."""
    up = list(range(n))

    def root(a: int) -> int:
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [root(a) for a in range(n)]


def similar(common, sizes):
    """Which texts' features have a Jaccard similarity of at least REWORKED."""
    union = sizes[:, None] + sizes[None, :] - common
    return (common >= REWORKED * union) & (union > 0)


def linked(common, sizes):
    """Pairs of such texts."""
    import numpy as np

    a, b = np.nonzero(np.triu(similar(common, sizes), 1))
    return list(zip(a.tolist(), b.tolist()))


def core_set(distance, near) -> list[int]:
    """The core point that stands for each row: farthest-point order, until every row is near one.

    Starts at the row with the largest sum of distances; each next core point is the row farthest from those there are, ties by
    place. A row that is near several belongs to the first. A row near none but itself is its own core point.
    """
    import numpy as np

    n = len(distance)
    cover = np.full(n, -1)
    if not n:
        return []
    least = np.full(n, np.inf)
    at = int(np.argmax(distance.sum(1)))
    while True:
        cover[near[at] & (cover < 0)] = at
        cover[at] = at if cover[at] < 0 else cover[at]
        least = np.minimum(least, distance[at])
        open_ = cover < 0
        if not open_.any():
            return cover.tolist()
        at = int(np.argmax(np.where(open_, least, -1.0)))


def disperse(distance, k: int) -> list[int]:
    """k rows of a distance matrix with a large sum of pairwise distances, by swaps as long as one raises it.

    Starts from the farthest-point order; each round makes the best swap of a chosen and another
    row, and as the sum has a bound, the rounds end. Ties go to the first row. All rows if there are no more than k.
    """
    import numpy as np

    n = len(distance)
    if k >= n:
        return list(range(n))
    if k <= 0:
        return []
    chosen = [int(np.argmax(distance.sum(1)))]
    least = distance[chosen[0]].copy()
    least[chosen[0]] = -1
    while len(chosen) < k:
        i = int(np.argmax(least))
        chosen.append(i)
        least = np.minimum(least, distance[i])
        least[chosen] = -1
    return swapped(distance, chosen)


def swapped(distance, chosen: list[int], total=None) -> list[int]:
    """The chosen rows after swaps with others, the best one first, as long as one raises the sum of their pairwise distances.

    ``total`` has each row's sum of distances to all that is chosen, where that is more than the chosen rows of this matrix.
    """
    import numpy as np

    inside = np.zeros(len(distance), bool)
    inside[chosen] = True
    if inside.all() or not inside.any():
        return np.nonzero(inside)[0].tolist()
    total = distance[:, inside].sum(1, dtype=np.float64) if total is None else total.astype(np.float64)
    while True:
        a, b = np.nonzero(inside)[0], np.nonzero(~inside)[0]
        gain = total[b][None, :] - distance[np.ix_(a, b)] - total[a][:, None]
        best = int(np.argmax(gain))
        i, j = a[best // len(b)], b[best % len(b)]
        if gain.flat[best] <= 1e-4:  # beyond what single precision may feign
            return np.nonzero(inside)[0].tolist()
        inside[i], inside[j] = False, True
        total += distance[:, j].astype(np.float64) - distance[:, i]


def _distances(common, sizes):
    import numpy as np

    union = sizes[:, None] + sizes[None, :] - common
    return np.where(union > 0, 1 - common / np.maximum(union, 1), 0.0).astype(np.float32)


def _crowds(ids: list[str], texts: list[str | None]) -> list[str]:
    """The crowd of each record of a block: core points with all they cover, joined where texts that they cover are similar."""
    import numpy as np

    common, sizes = overlaps(texts)
    near = similar(common, sizes)
    cover = np.array(core_set(_distances(common, sizes), near), np.int64)
    a, b = np.nonzero(np.triu(near, 1))
    apart = cover[a] != cover[b]
    pairs = [*zip(cover.tolist(), range(len(ids))), *zip(cover[a[apart]].tolist(), cover[b[apart]].tolist())]
    return [ids[c] for c in components(len(ids), pairs)]


def _blocks(rows: DataFrame, sizes: DataFrame, block_rows: int) -> DataFrame:
    parts = sizes.select("_group", F.ceil(F.col("_n") / block_rows).alias("_parts"))
    return rows.join(parts, "_group").withColumn("_block", F.pmod(F.xxhash64("record"), F.col("_parts"))).drop("_parts")


def _crowds_per_block(rows: DataFrame) -> DataFrame:
    """Crowds of every block of every group; repeats of a record count once."""

    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("record").sort_values("record")
        ids = part["record"].tolist()
        return pd.DataFrame({"_group": key[0], "record": ids, "crowd": _crowds(ids, part["text"].tolist())})

    kind = rows.schema["_group"].dataType.simpleString()
    return rows.groupBy("_group", "_block").applyInPandas(run, f"_group {kind}, record string, crowd string")


def _input(df: DataFrame, group: str, record: str, text: str, budget: DataFrame | None = None) -> DataFrame:
    rows = df.select(F.col(group).alias("_group"), F.col(record).cast("string").alias("record"), F.col(text).alias("text")).filter(F.col("_group").isNotNull() & F.col("record").isNotNull())
    if budget is None:
        return rows.withColumn("budget", F.lit(0))
    return rows.join(budget.select(F.col(group).alias("_group"), F.col("budget").cast("int").alias("budget")), "_group")


def crowds(df: DataFrame, group: str, record: str, text: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``group, record, crowd, members``: the crowd of reworked texts that each record belongs to.

    Two texts are reworkings of one if the sets of their words and neighbouring word pairs have a
    Jaccard similarity of at least REWORKED. This is the first half of the core-set construction: a
    group is cut into blocks of ``block_rows`` records; each block takes core points in farthest-point order until every
    text is near one (``core_set``); a core point and all it covers are a crowd, and crowds whose texts are similar are one, named
    by its smallest record. Groups of more than one block then join all
    their distinct texts by their rarest features, as a set join with a prefix: in buckets of up to
    BUCKET all pairs are verified; the texts of larger ones are cut into parts of half a block, and every
    two parts are compared as a block is. Both are exact, so the crowds don't depend on the blocks.
    Null, empty and wordless texts are crowds of one; repeats of a record count once; rows with a
    null group or record are left out.
    """
    rows = _input(df, group, record, text)
    sizes = rows.groupBy("_group").agg(F.count(F.lit(1)).alias("_n"))
    local = written(_crowds_per_block(_blocks(rows, sizes, block_rows)), "crowds")
    large = sizes.filter(F.col("_n") > block_rows).select("_group")
    joined = _join_blocks(local, rows, large, block_rows) if large.limit(1).count() else None
    if joined is not None:
        local = local.join(joined, ["_group", "crowd"], "left").withColumn("crowd", F.coalesce("root", "crowd")).drop("root")
    members = local.groupBy("_group", "crowd").agg(F.count(F.lit(1)).alias("members"), F.min("record").alias("_first"))
    out = local.join(members, ["_group", "crowd"])
    return out.select(F.col("_group").alias(group), "record", F.col("_first").alias("crowd"), "members")


def _join_blocks(local: DataFrame, rows: DataFrame, large: DataFrame, block_rows: int) -> DataFrame:
    """``_group, crowd, root``: which crowds of a group's blocks are one."""
    every = local.join(large, "_group").join(rows.dropDuplicates(["_group", "record"]), ["_group", "record"])
    plain = F.pandas_udf(lambda s: s.map(lambda t: fold(t)[1].decode("utf-8", "replace") if t else ""), "string")
    words = F.filter(F.split(plain("text"), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    pairs = F.transform(F.sequence(F.lit(1), F.size("_w") - 1), lambda i: F.concat_ws(" ", F.element_at("_w", i), F.element_at("_w", i + 1)))
    every = every.withColumn("_w", words).filter(F.size("_w") > 0).withColumn("_words", F.concat_ws(" ", "_w"))
    every = written(every.select("_group", "record", "crowd", "text", "_w", "_words"), "texts")
    # records of the same words are one text
    first = every.groupBy("_group", "_words").agg(F.min_by(F.struct("record", "crowd", "text", "_w"), "record").alias("x"))
    links = every.select("_group", "_words", F.col("crowd").alias("a")).join(first.select("_group", "_words", F.col("x.crowd").alias("b")), ["_group", "_words"])
    links = written(links.filter("a != b").select("_group", "a", "b").distinct(), "links")
    bag = first.select("_group", "x.*").withColumn("bag", F.array_distinct(F.concat("_w", F.when(F.size("_w") > 1, pairs).otherwise(F.array().cast("array<string>")))))
    bag = written(bag.select("_group", "record", "crowd", "text", "bag"), "bags")
    feature = bag.select("_group", "record", F.explode("bag").alias("f"))
    often = feature.groupBy("_group", "f").agg(F.count(F.lit(1)).alias("often"))
    # sets with this similarity share one of the (1 - similarity) rarest features of either
    rare = feature.join(often, ["_group", "f"]).groupBy("_group", "record").agg(F.array_sort(F.collect_list(F.struct("often", "f"))).alias("r"))
    prefix = F.slice("r", 1, F.floor(F.size("r") * (1 - REWORKED)).cast("int") + 1)
    bucket = rare.select("_group", "record", F.explode(F.transform(prefix, lambda x: x["f"])).alias("f"))
    bucket = written(bucket, "buckets")

    count = bucket.groupBy("_group", "f").agg(F.count(F.lit(1)).alias("m"))
    bucket = bucket.join(bag.select("_group", "record", "crowd"), ["_group", "record"])
    few, many = bucket.join(count.filter((F.col("m") > 1) & (F.col("m") <= BUCKET)), ["_group", "f"]), bucket.join(count.filter(F.col("m") > BUCKET), ["_group", "f"])
    other = few.select("_group", "f", F.col("record").alias("y"), F.col("crowd").alias("b"))
    met = few.select("_group", "f", F.col("record").alias("x"), F.col("crowd").alias("a")).join(other, ["_group", "f"]).filter("x < y AND a != b").drop("f").distinct()
    both = met.join(bag.select("_group", F.col("record").alias("x"), F.col("bag").alias("ba")), ["_group", "x"]).join(bag.select("_group", F.col("record").alias("y"), F.col("bag").alias("bb")), ["_group", "y"])
    both = both.withColumn("c", F.size(F.array_intersect("ba", "bb"))).filter(F.col("c") >= REWORKED * (F.size("ba") + F.size("bb") - F.col("c")))
    links = links.unionByName(written(both.select("_group", "a", "b").distinct(), "links"))
    # the texts of large buckets: any two of them meet in the block of their two parts
    crowded = written(many.select("_group", "record").distinct().join(bag.drop("bag"), ["_group", "record"]), "crowded")
    parts = crowded.groupBy("_group").agg(F.greatest(F.lit(2), F.ceil(F.count(F.lit(1)) / max(1, block_rows // 2))).alias("_parts"))
    cut = crowded.join(parts, "_group").withColumn("_p", F.pmod(F.xxhash64("record"), F.col("_parts")))
    cut = cut.withColumn("_q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).filter("_p != _q")
    cut = cut.select("_group", F.least("_p", "_q").alias("_i"), F.greatest("_p", "_q").alias("_j"), "record", "crowd", "text")

    def compare(key, part: pd.DataFrame) -> pd.DataFrame:
        crowd = part["crowd"].tolist()
        root = components(len(crowd), linked(*overlaps(part["text"].tolist())))
        pairs = sorted({(crowd[i], crowd[r]) for i, r in enumerate(root) if crowd[i] != crowd[r]})
        return pd.DataFrame({"_group": [key[0]] * len(pairs), "a": [a for a, _ in pairs], "b": [b for _, b in pairs]}, dtype=object)

    kind = rows.schema["_group"].dataType.simpleString()
    near = cut.groupBy("_group", "_i", "_j").applyInPandas(compare, f"_group {kind}, a string, b string")
    links = links.unionByName(written(near.distinct(), "links"))
    return smallest_reachable(links)


def smallest_reachable(links: DataFrame) -> DataFrame:
    """``_group, crowd, root`` for every end of a link: the smallest name it is connected with.

    Alternates large-star and small-star steps, written after each, until a step changes nothing;
    the steps needed grow with the logarithm of the longest chain.
    """
    links = links.select("_group", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = written(links, "links")
    before = None
    while True:
        both = links.unionByName(links.select("_group", F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("_group", "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, ["_group", "a"]).filter(F.col("b") > F.col("a")).select("_group", F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("_group", "a").agg(F.min("b").alias("m"))
        small = large.join(low, ["_group", "a"]).select("_group", F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b"))
        small = small.unionByName(low.select("_group", "a", F.col("m").alias("b"))).distinct()
        links = written(small, "links")
        state = links.agg(F.count(F.lit(1)), F.sum(F.hash("_group", "a", "b").cast("long"))).first()
        if state == before:
            return links.groupBy("_group", F.col("a").alias("crowd")).agg(F.min("b").alias("root"))
        before = state


def units(a: list, b: list):
    """Distances of every bag of features in ``a`` from every one in ``b``, rounded to whole units: 1 less their Jaccard similarity."""
    import numpy as np

    sizes = np.array([len(x) for x in [*a, *b]], np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    flat = np.concatenate([np.zeros(0, np.int64), *[np.asarray(x, np.int64) for x in [*a, *b]]])
    codes, column = np.unique(flat, return_inverse=True)
    left = row < len(a)
    shared = (np.bincount(column[left], minlength=len(codes)) > 0) & (np.bincount(column[~left], minlength=len(codes)) > 0)
    keep = shared[column]
    row, column = row[keep], (np.cumsum(shared) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(a), len(b)))
    for lo in range(0, int(shared.sum()), FEATURES):
        i, j = np.searchsorted(column, [lo, lo + FEATURES])
        m = np.zeros((len(sizes), min(FEATURES, int(shared.sum()) - lo)), np.float32)
        m[row[i:j], column[i:j] - lo] = 1.0
        common += m[: len(a)] @ m[len(a) :].T
    return whole_units(common, sizes[: len(a)], sizes[len(a) :])


def whole_units(common, a, b):
    """Jaccard distances in whole units, of the sizes of two sides and what they have in common."""
    import numpy as np

    union = a[:, None].astype(np.float64) + b[None, :] - common
    return np.where(union > 0, np.rint((1 - common / np.maximum(union, 1)) * UNIT), 0.0)


def _bags(rows: DataFrame) -> DataFrame:
    """``text`` replaced by ``bag``: digests of its words and neighbouring word pairs, without case, marks and blanks, as in ``overlaps``."""
    words = F.pandas_udf(lambda s: s.map(lambda t: re.findall(r"\w+", fold(t)[1].decode("utf-8", "replace")) if t else []), "array<string>")
    pairs = F.transform(F.sequence(F.lit(1), F.size("_w") - 1), lambda i: F.concat_ws(" ", F.element_at("_w", i), F.element_at("_w", i + 1)))
    every = F.concat("_w", F.when(F.size("_w") > 1, pairs).otherwise(F.array().cast("array<string>")))
    return rows.withColumn("_w", words("text")).withColumn("bag", F.array_distinct(F.transform(every, lambda x: F.xxhash64(x)))).drop("text", "_w")


def _meet(left: DataFrame, right: DataFrame, block_rows: int, run, schema: str) -> DataFrame:
    """``run`` for every part of a group's rows ``left`` with every part of its rows ``right``, about ``block_rows`` rows in a task.

    Both sides have ``_group, record, bag, value``; ``run`` gets two frames and returns one with ``record`` and what ``schema`` adds.
    """
    half = max(1, block_rows // 2)
    parts = lambda df, c: df.groupBy("_group").agg(F.ceil(F.count(F.lit(1)) / half).alias(c))
    n = parts(left, "_ps").join(parts(right, "_qs"), "_group")
    side = lambda df, own, other, first: df.select("_group", "record", "bag", "value", F.lit(first).alias("_first")).join(n, "_group").withColumn(own, F.pmod(F.xxhash64("record"), F.col(own + "s"))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other + "s") - 1))).drop("_ps", "_qs")

    def pair(key, part: pd.DataFrame) -> pd.DataFrame:
        out = run(part[part["_first"]], part[~part["_first"]])
        out.insert(0, "_group", key[0])
        return out

    kind = left.schema["_group"].dataType.simpleString()
    both = side(left, "_p", "_q", True).unionByName(side(right, "_q", "_p", False))
    return both.groupBy("_group", "_p", "_q").applyInPandas(pair, f"_group {kind}, record string, {schema}")


def _moved(state: DataFrame, changed: DataFrame, block_rows: int) -> DataFrame:
    """``state`` with ``total``, each row's distance to all that is chosen, after the rows ``changed`` were taken (1) or given up (-1)."""

    def run(rows: pd.DataFrame, by: pd.DataFrame) -> pd.DataFrame:
        moved = units(rows["bag"].tolist(), by["bag"].tolist()) @ by["value"].to_numpy(float)
        return pd.DataFrame({"record": rows["record"].to_numpy(), "moved": moved.astype("int64")})

    moved = _meet(state.withColumn("value", F.lit(0).cast("long")), changed, block_rows, run, "moved long").groupBy("_group", "record").agg(F.sum("moved").alias("_moved"))
    return state.join(moved, ["_group", "record"], "left").withColumn("total", F.col("total") + F.coalesce("_moved", F.lit(0))).drop("_moved")


def _gains(state: DataFrame, block_rows: int) -> DataFrame:
    """``_group, record, gain``: the most that a swap of each row with one of the other side adds to the sum of distances."""

    def run(inside: pd.DataFrame, outside: pd.DataFrame) -> pd.DataFrame:
        if inside.empty or outside.empty:
            return pd.DataFrame({"record": [], "gain": []}).astype({"record": object, "gain": "int64"})
        gain = outside["value"].to_numpy(float)[None, :] - units(inside["bag"].tolist(), outside["bag"].tolist()) - inside["value"].to_numpy(float)[:, None]
        return pd.DataFrame({"record": [*inside["record"], *outside["record"]], "gain": [*gain.max(1).astype("int64"), *gain.max(0).astype("int64")]})

    rows = state.withColumn("value", F.col("total"))
    return _meet(rows.filter("inside"), rows.filter("NOT inside"), block_rows, run, "gain long").groupBy("_group", "record").agg(F.max("gain").alias("gain"))


def _swaps(rows: DataFrame) -> DataFrame:
    """``_group, record, value``: rows to take (1) and to give up (-1), by swaps among each group's ``rows`` until none helps."""

    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        part = part.sort_values("record").reset_index(drop=True)
        bags, before = part["bag"].tolist(), part["inside"].to_numpy(bool)
        after = np.zeros(len(part), bool)
        after[swapped(units(bags, bags), np.nonzero(before)[0].tolist(), part["total"].to_numpy())] = True
        moved = part[before != after]
        return pd.DataFrame({"_group": [key[0]] * len(moved), "record": moved["record"].tolist(), "value": np.where(after, 1, -1)[moved.index]})

    kind = rows.schema["_group"].dataType.simpleString()
    return rows.groupBy("_group").applyInPandas(run, f"_group {kind}, record string, value long")


def _subset_at_once(rows: DataFrame) -> DataFrame:
    """``_group, record`` of the subset of groups that one task holds: the single round that ``_subset_by_rounds`` would take."""

    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        part = part.sort_values("record").reset_index(drop=True)
        k, ranks = int(part["budget"].iloc[0]), part["rank"].to_numpy()
        pick = np.arange(len(part))
        if k < len(part):
            last = np.sort(ranks)[k]
            fixed, level = np.nonzero(ranks < last)[0], np.nonzero(ranks == last)[0]
            common, sizes = overlaps(part["text"].tolist())
            start = np.argsort(part["_start"].to_numpy()[level], kind="stable")[: k - len(fixed)]
            distance = whole_units(common[level], sizes[level], sizes)
            total = distance[:, np.concatenate([fixed, level[start]])].sum(1)
            pick = np.concatenate([fixed, level[swapped(distance[:, level], start.tolist(), total)]]).astype(int)
        return pd.DataFrame({"_group": [key[0]] * len(pick), "record": part["record"].iloc[pick].tolist()})

    kind = rows.schema["_group"].dataType.simpleString()
    return rows.withColumn("_start", F.xxhash64("record")).groupBy("_group").applyInPandas(run, f"_group {kind}, record string")


def _levels(rows: DataFrame) -> DataFrame:
    """``_group, rank, _n, _places``: of each rank that has places left in its group's budget, its records and these places."""
    before = Window.partitionBy("_group").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    level = rows.groupBy("_group", "rank").agg(F.count(F.lit(1)).alias("_n"), F.max("budget").alias("_b"))
    return level.select("_group", "rank", "_n", (F.col("_b") - F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("_places")).filter("_places > 0")


def _subset_by_rounds(rows: DataFrame, block_rows: int) -> DataFrame:
    """``_group, record`` of the subset of groups of any size: rounds over all pairs of parts, until none finds a gain."""
    rows = written(_bags(rows.join(_levels(rows), ["_group", "rank"])).select("_group", "record", "bag", "_n", "_places"), "bags")
    fixed, last = rows.filter("_n <= _places"), rows.filter("_n > _places").select("_group", "record", "bag", "_places")
    start = top_k(last.drop("bag"), ["_group"], [F.xxhash64("record")], F.col("_places"), "record").select("_group", "record", F.lit(True).alias("inside"))
    state = last.drop("_places").join(start, ["_group", "record"], "left").withColumns({"inside": F.coalesce("inside", F.lit(False)), "total": F.lit(0).cast("long")})
    state = written(state, "state")
    out = [fixed.select("_group", "record")]
    changed = fixed.join(state.select("_group").distinct(), "_group", "left_semi").select("_group", "record", "bag").unionByName(state.filter("inside").select("_group", "record", "bag")).withColumn("value", F.lit(1).cast("long"))
    while state.limit(1).count():
        state = written(_moved(state, changed, block_rows), "totals")
        gain = written(_gains(state, block_rows), "gains")
        open_ = state.join(gain.groupBy("_group").agg(F.max("gain").alias("_most")).filter("_most > 0").drop("_most"), "_group", "left_semi")
        out.append(state.filter("inside").join(open_.select("_group").distinct(), "_group", "left_anti").select("_group", "record"))
        most = top_k(open_.join(gain, ["_group", "record"]), ["_group", "inside"], [F.desc("gain")], F.lit(SWAPS), "record")
        swaps = written(_swaps(most.select("_group", "record", "bag", "inside", "total")), "swaps")
        state = written(open_.join(swaps, ["_group", "record"], "left").withColumn("inside", F.coalesce(F.col("value") > 0, "inside")).drop("value"), "state")
        # where one round had all records, no swap is left
        over = state.groupBy("_group").agg(F.count_if("inside").alias("_i"), F.count_if(~F.col("inside")).alias("_o")).filter((F.col("_i") <= SWAPS) & (F.col("_o") <= SWAPS)).select("_group")
        out.append(state.filter("inside").join(over, "_group", "left_semi").select("_group", "record"))
        state = state.join(over, "_group", "left_anti")
        changed = swaps.join(state.select("_group", "record", "bag"), ["_group", "record"])
    return reduce(lambda a, b: a.unionByName(b), out)


def varied_subset(df: DataFrame, group: str, record: str, text: str, budget: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``group, record``: at most ``budget`` records of each group with a large sum of pairwise distances.

    Records are ranked within their crowd (``crowds``), the fullest text first. All first texts are taken before any second
    one, over the whole group, and so on; of the rank at which the budget ends, those records that no swap with another one of this rank
    improves: none raises the sum of Jaccard distances of words and word pairs over all that the group's subset has. One method
    holds for groups and budgets of any size. It starts from a hash of the records; a round compares all chosen records with all others,
    part by part, and swaps among the SWAPS of each that gain most, until a round finds no gain. Distances are whole
    numbers, so neither the parts nor their order change the result: ``block_rows`` bounds what a task sees, and nothing else; a group that fits
    a task and a round takes this round in one step, with the same result. A round's work grows with records times budget. Groups without a budget give nothing; a group with
    fewer records than its budget is taken whole.
    """
    every = _input(df, group, record, text, budget).dropDuplicates(["_group", "record"])
    named = crowds(df, group, record, text, block_rows).select(F.col(group).alias("_group"), "record", "crowd")
    # of a crowd only the first ``budget`` texts can be taken; texts themselves aren't moved for the ranks
    words = every.select("_group", "record", "budget", F.length(F.coalesce("text", F.lit(""))).alias("_words"))
    best = top_k(words.join(named, ["_group", "record"]), ["_group", "crowd"], [F.desc("_words")], F.col("budget"), "record")
    rows = written(every.join(best.select("_group", "record", "rank"), ["_group", "record"]).select("_group", "record", "text", "budget", "rank"), "ranked")
    limit = min(block_rows, SWAPS)
    sizes = written(_levels(rows).groupBy("_group").agg(F.max("rank").alias("_last"), F.sum("_n").alias("_size")), "sizes")
    every = rows.join(sizes, "_group").filter(F.col("rank") <= F.col("_last")).drop("_last")
    out = _subset_at_once(every.filter(F.col("_size") <= limit).drop("_size"))
    if (sizes.agg(F.max("_size")).first()[0] or 0) > limit:
        out = out.unionByName(_subset_by_rounds(every.filter(F.col("_size") > limit).drop("_size"), block_rows))
    return out.select(F.col("_group").alias(group), "record")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All members of crowds of at least six."""
    found = crowds(table(spark, sf_dir, "candidates"), "run_id", "candidate_id", "text").filter(F.col("members") >= CROWD)
    return found.select(F.col("crowd").alias("group_id"), F.col("record").alias("candidate_id"))


def p2_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A varied subset of runs.budget candidates of each run."""
    chosen = varied_subset(table(spark, sf_dir, "candidates"), "run_id", "candidate_id", "text", table(spark, sf_dir, "runs").select("run_id", "budget"))
    return chosen.select("run_id", F.col("record").alias("candidate_id"))


def p2_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each run: its crowds, those that the subset has a text of, and the largest share of one crowd in the run and in the subset."""
    every = crowds(table(spark, sf_dir, "candidates"), "run_id", "candidate_id", "text").select("run_id", F.col("record").alias("candidate_id"), "crowd")
    n = every.join(p2_subset(spark, sf_dir).withColumn("_in", F.lit(1)), ["run_id", "candidate_id"], "left").groupBy("run_id", "crowd").agg(F.count(F.lit(1)).alias("n"), F.count("_in").alias("taken"))
    share = lambda c: F.round(F.max(c) / F.sum(c), 6)
    return n.groupBy("run_id").agg(F.count(F.lit(1)).alias("crowds"), F.count_if(F.col("taken") > 0).alias("covered"), F.sum("taken").alias("chosen"), share("n").alias("largest_share"), share("taken").alias("largest_chosen_share"))


QUERIES = {"p2_found": p2_found, "p2_subset": p2_subset, "p2_coverage": p2_coverage}
SQL: dict[str, str] = {}
