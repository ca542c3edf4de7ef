"""Problem 8: passages of evaluation items within training documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.tables import table
from siftline.operators.staging import written

#: Successive words of an item that leak it unchanged; shorter items must be whole.
EXACT_WORDS = 12
#: Successive words that leak it with replaced ones among them, how many of those, and of how many words one may be replaced in longer ones.
NEAR_WORDS, NEAR_REPLACED, NEAR_ONE_IN = 20, 2, 7
#: Words of a shingle; three replaced words of 21 leave at least 2 of the 17 shingles.
SHINGLE = 5
#: Lengths and replaced words of the shortest near leaks; any longer one holds one of them, as one half of a window twice as long has no larger share of replaced words.
NEAR = [(NEAR_WORDS, NEAR_REPLACED)] + [(k * NEAR_ONE_IN, k) for k in range(NEAR_REPLACED + 1, (2 * NEAR_WORDS - 1) // NEAR_ONE_IN + 1)]
#: Words of alignments that are compared at once.
VERIFIED_WORDS = 1 << 20
#: Items whose index goes to the workers; more of them are met as tables.
BLOCK_ITEMS = 20_000
#: Bits of the filter through which a document's shingles pass before they are joined with those of many items.
FILTER_BITS = 1 << 27

# Letters whose plain form is no part of their decomposition.
PLAIN = {"ɗ": "d", "ɓ": "b", "ƙ": "k", "ƴ": "y", "ı": "i", "ø": "o", "đ": "d", "ł": "l", "œ": "oe", "æ": "ae"}
#: Signs beyond ASCII that part words.
BLANKS = "\u1680\u2013\u2014\u2015\u2022\u2026\u2028\u2029\u201c\u201d\u201e\u00ab\u00bb\u00b7\u00a6\u2190\u2192\u2212"


class Words:
    """Words of a text without case, marks, markup, invisible characters and the like."""

    def __init__(self) -> None:
        import re

        self.markup = re.compile(r"</?[A-Za-z!][^<>]*>")
        self.not_latin = re.compile("[\u0370-\u1dbf\u2c00-\ua71f\ua7ff-\ufaff\U00010000-\U0001efff\U00020000-\U000fffff]")
        self.drop = re.compile("[\u0300-\u036f\u0483-\u0487\u0591-\u05bd\u064b-\u065f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe00-\ufe0f\ufe20-\ufe2f\u00ad\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufeff'’‘ʼʻ`´ʹ-]+")
        self.word = re.compile(r"[^\W_]+")

    def __call__(self, text: str) -> list[str]:
        import html
        from unicodedata import normalize

        if "<" in text:
            text = self.markup.sub(" ", text)
        if "&" in text:
            text = html.unescape(text)
        text = text.lower()
        if not text.isascii():
            text = normalize("NFKD", text)
            for a, b in PLAIN.items():
                if a in text:
                    text = text.replace(a, b)
            if self.not_latin.search(text):
                return self.word.findall(self.drop.sub("", text))
            # a line or other separator beyond ASCII must part words; marks and apostrophes must not
            for a in BLANKS:
                if a in text:
                    text = text.replace(a, " ")
            text = text.encode("ascii", "ignore").decode()
        return self.word.findall(text.replace("'", "").replace("-", "").replace("`", ""))


class Index:
    """Shingles of a block of items, with those a document must share to hold enough of an item."""

    def __init__(self, items: list[tuple[list[int], str]]) -> None:
        import numpy as np

        words = Words()
        by_text: dict[tuple[str, ...], list[int]] = {}
        for ids, text in items:
            if w := tuple(words(text)):
                by_text.setdefault(w, []).extend(ids)
        self.leak = list(by_text.values())  # items with the same words leak together
        self.vocabulary: dict[str, int] = {}
        self.items = [np.array([self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w]) for w in by_text]
        self.size = np.array([len(w) for w in self.items], np.int64)
        self.begin, self.flat = self.size.cumsum() - self.size, np.concatenate([*self.items, np.empty(0, np.int64)])
        self.base = len(self.vocabulary) + 1
        #: Of each item the shingles any leak shares: one window's of an exact leak, or those that replaced words leave.
        self.least = np.array([min([max(1, must) for _, must in self.windows(len(w))]) for w in self.items] or [0])
        self.short = {}  # items of fewer words than a shingle, by length and words
        code, item, place = [], [], []
        for k, w in enumerate(self.items):
            if len(w) < SHINGLE:
                self.short.setdefault(len(w), {})[int(self.shingles(w, len(w))[0])] = k
            c = self.shingles(w, SHINGLE)
            code.append(c)
            item.append(np.full(len(c), k))
            place.append(np.arange(len(c)))
        code, item, place = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (code, item, place))
        order = np.argsort(code, kind="stable")
        self.item, self.place = item[order], place[order]
        self.codes, self.start, self.often = np.unique(code[order], return_index=True, return_counts=True)
        # prefix: of the shingles in each window, rarest first, so many that a document with enough of the window has one of them
        rarity = np.empty(len(order), np.int64)
        rarity[order] = np.repeat(self.often, self.often)
        needed = np.zeros(len(order), bool)
        begin = 0
        for w in self.items:
            n = max(0, len(w) - SHINGLE + 1)
            r = rarity[begin : begin + n]
            for wide, must in self.windows(len(w)) if n else ():
                rows = np.lib.stride_tricks.sliding_window_view(r, wide)
                first = np.argsort(rows, axis=1, kind="stable")[:, : wide - must + 1]
                needed[begin + np.arange(len(rows))[:, None] + first] = True
            begin += n
        self.prefix = needed[order]

    @staticmethod
    def windows(n: int) -> list[tuple[int, int]]:
        """Shingles in each kind of window of an item of n words, and how many of them a leak keeps."""
        exact = min(EXACT_WORDS, n) - SHINGLE + 1
        return [(exact, exact)] + [(of - SHINGLE + 1, of - SHINGLE + 1 - SHINGLE * k) for of, k in NEAR if of <= n]

    def shingles(self, w, of: int):
        """A number for every ``of`` successive words, -1 where one of them is in no item."""
        import numpy as np

        n = len(w) - of + 1
        if n <= 0:
            return np.empty(0, np.int64)
        out = np.zeros(n, np.int64)
        bad = np.zeros(n, bool)
        for i in range(of):
            part = w[i : i + n]
            out *= self.base
            out += part
            bad |= part < 0
        out[bad] = -1
        return out

    def leaked(self, documents: list[list[str]]) -> list[tuple[int, int]]:
        """(document, item id) for every leak in a list of documents, each given as its words."""
        import numpy as np

        get = self.vocabulary.get
        gap = [-2] * NEAR_WORDS  # no window reaches into it
        flat: list[int] = []
        starts = []
        for words in documents:
            starts.append(len(flat))
            flat += [get(x, -1) for x in words]
            flat += gap
        w, starts = np.array(flat, np.int64), np.array(starts)
        of_doc = lambda at: int(np.searchsorted(starts, at, side="right")) - 1
        found: set[tuple[int, int]] = set()
        for of, known in self.short.items():
            for at, c in enumerate(self.shingles(w, of).tolist()):
                if c in known:
                    found.add((of_doc(at), known[c]))
        if len(self.codes):
            c = self.shingles(w, SHINGLE)
            at = np.minimum(np.searchsorted(self.codes, c), len(self.codes) - 1)
            hit = np.nonzero(self.codes[at] == c)[0]
            s, n = self.start[at[hit]], self.often[at[hit]]
            post = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n) + np.repeat(s, n)
            shift = np.repeat(hit, n) - self.place[post]  # place in all documents minus place in the item: one value for one alignment
            keys, inverse, count = np.unique(self.item[post] * (1 << 40) + shift + (1 << 30), return_inverse=True, return_counts=True)
            has = np.zeros(len(keys), bool)
            has[inverse[self.prefix[post]]] = True
            keys = keys[has & (count >= self.least[keys >> 40])]
            i, begin = keys >> 40, (keys & ((1 << 40) - 1)) - (1 << 30)
            # length and place bounds: what of the item can lie in the documents
            lo, hi = np.maximum(0, -begin), np.minimum(self.size[i], len(w) - begin)
            exact = np.minimum(EXACT_WORDS, self.size[i])
            parts = np.cumsum(hi - lo) // VERIFIED_WORDS
            for rows in np.split(np.arange(len(keys)), np.nonzero(np.diff(parts))[0] + 1) if len(keys) else ():
                n = (hi - lo)[rows]
                row = np.repeat(rows, n)
                place = np.arange(len(row)) - np.repeat(n.cumsum() - n, n) + lo[row]
                part = w[begin[row] + place]
                run = np.concatenate([[0], np.cumsum((self.flat[self.begin[i[row]] + place] == part) - 1000 * (part == -2))])
                left = hi[row] - place
                for of, k in [(exact[row], 0)] + [(np.full(len(row), of), k) for of, k in NEAR]:
                    x = np.nonzero(left >= of)[0]
                    x = x[run[x + of[x]] - run[x] >= of[x] - k]
                    docs = np.searchsorted(starts, (begin[row] + place)[x], side="right") - 1
                    found.update(zip(docs.tolist(), i[row[x]].tolist()))
        return [(d, x) for d, i in sorted(found) for x in self.leak[i]]


def leaks(documents: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``key, item``: which documents hold which items, whole or in part.

    A set join with a prefix filter: items are cut into shingles, ordered by how rare they are among items; of
    each window of an item only the rarest that any leak must keep are looked up in a document.
    An alignment found so is compared word by word over windows of the item: EXACT_WORDS in a row,
    or at least NEAR_WORDS with up to one in NEAR_ONE_IN replaced. Up to ``block_items`` items are an index that goes to the workers, and documents are
    read once and not shuffled; more items are tables that are joined (``_joined``), with the same result.
    Null, empty and wordless texts on either side leak nothing; null keys are kept as they are.
    """
    kind, item_kind = documents.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()
    rows = items.select(F.col(item).alias("i"), F.col(item_text).alias("t")).na.drop()
    texts = rows.groupBy("t").agg(F.sort_array(F.collect_set("i")).alias("i")).select("i", "t")
    if rows.count() > block_items:
        return _joined(documents.select(F.col(key).alias("_key"), F.col(text).alias("_text")), texts).select(F.col("_key").alias(key), F.col("_item").cast(item_kind).alias(item))
    listed = sorted((list(r.i), r.t) for r in texts.collect())
    out_kind = "bigint" if item_kind in ("bigint", "int") else "string"
    batch_type = pa.int64() if out_kind == "bigint" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, words = Index(listed), Words()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a in range(0, len(texts), 500):
                leaked = index.leaked([words(t) if t else [] for t in texts[a : a + 500]])
                keys = batch.column(0).take(pa.array([a + d for d, _ in leaked], pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array([x for _, x in leaked], batch_type)], ["_key", "_item"])

    found = documents.select(key, text).mapInArrow(run, f"_key {kind}, _item {out_kind}")
    return found.select(F.col("_key").alias(key), F.col("_item").alias(item)).distinct()


def shingle_codes(words: list[str], of: int) -> list[int]:
    """A 64-bit number for every ``of`` successive words."""
    import xxhash

    return [xxhash.xxh64_intdigest("\x1f".join(words[a : a + of])) - (1 << 63) for a in range(len(words) - of + 1)]


def _joined(documents: DataFrame, texts: DataFrame) -> DataFrame:
    """``_key, _item`` for more items than an index may hold: items, their shingles and what documents share with them are tables.

    Shingles of all items are counted, and of each item those that any leak must keep one of are its prefix. Documents pass their
    shingles through a filter of FILTER_BITS bits, whatever the number of items, and only what passes is joined with the prefixes by its number. Documents
    that met an item are read again and aligned with the items that they met, as in the index. Items of fewer words than a shingle
    are looked up whole, as shingles of their own length.
    """
    kind = documents.schema["_key"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            ids, place, codes = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words(t)
                of = min(SHINGLE, len(w))
                for p, c in enumerate(shingle_codes(w, of) if w else ()):
                    ids.append(i), place.append(p), codes.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(place, pa.int32()), pa.array(codes, pa.int64())], ["n", "place", "code"])

    numbered = written(texts.withColumn("n", F.xxhash64("t")), "items")
    shingles = written(numbered.select("n", "t").mapInArrow(cut, "n bigint, place int, code bigint"), "shingles")
    often = shingles.groupBy("code").agg(F.count(F.lit(1)).alias("often"))
    of_item = shingles.join(often, "code").groupBy("n").agg(F.array_sort(F.collect_list(F.struct("place", "code", "often"))).alias("s")).join(numbered.select("n", "t"), "n")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        words = Words()
        for batch in batches:
            ids, codes, lengths = [], [], []
            for n, s, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                many = len(words(t))
                code, r = [x["code"] for x in s], np.array([x["often"] for x in s])
                needed = np.zeros(len(code), bool)
                if many < SHINGLE:
                    needed[:] = True
                else:
                    for wide, must in Index.windows(many):
                        rows = np.lib.stride_tricks.sliding_window_view(r, wide)
                        first = np.argsort(rows, axis=1, kind="stable")[:, : wide - must + 1]
                        needed[np.arange(len(rows))[:, None] + first] = True
                for i in np.nonzero(needed)[0]:
                    ids.append(n), codes.append(code[i]), lengths.append(min(SHINGLE, many))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(codes, pa.int64()), pa.array(lengths, pa.int32())], ["n", "code", "of"])

    prefix = written(of_item.select("n", "s", "t").mapInArrow(choose, "n bigint, code bigint, of int").distinct(), "prefix")
    lengths = sorted(r.of for r in prefix.select("of").distinct().collect())  # at most SHINGLE of them
    slot = F.pmod("code", F.lit(FILTER_BITS))
    slots = prefix.select((slot / 32).cast("int").alias("at"), F.pmod(slot, F.lit(32)).cast("int").alias("_s"))
    bits = slots.groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, _s)")).alias("bits")).collect()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        words, known = Words(), np.zeros(FILTER_BITS // 32, np.int64)
        known[[r[0] for r in filled]] = [r[1] for r in filled]
        for batch in batches:
            rows, codes = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                w = words(t) if t else []
                c = np.unique(np.array([x for of in lengths for x in shingle_codes(w, of)], np.int64))
                at = c % FILTER_BITS
                c = c[(known[at // 32] >> (at % 32)) & 1 == 1]
                rows += [i] * len(c)
                codes += c.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(codes, pa.int64())], ["_key", "code"])

    filled = [(r.at, r.bits) for r in bits]
    numbered_docs = documents.withColumn("_key", F.struct("_key", F.xxhash64("_text").alias("h")))
    key_kind = numbered_docs.schema["_key"].dataType.simpleString()
    met = numbered_docs.select("_key", "_text").mapInArrow(meet, f"_key {key_kind}, code bigint").join(prefix.select("code", "n"), "code").select("_key", "n").distinct()
    pairs = met.join(numbered.select("n", "i", "t"), "n").groupBy("_key").agg(F.collect_list(F.struct("i", "t")).alias("items"))
    whole = numbered_docs.dropDuplicates(["_key"]).select(F.col("_key").alias("_k"), "_text").join(pairs, F.col("_k").eqNullSafe(F.col("_key")))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            rows, found = [], []
            for i, (t, items) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                for _, x in Index(sorted(([str(v) for v in y["i"]], y["t"]) for y in items)).leaked([words(t)]):
                    rows.append(i)
                    found.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], ["_key", "_item"])

    return whole.select("_key._key", "_text", "items").mapInArrow(verify, f"_key {kind}, _item string").distinct()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items that they leak."""
    return leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaked item with the number of documents that hold it."""
    return p8_found(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))


QUERIES = {"p8_found": p8_found, "p8_items": p8_items}
SQL: dict[str, str] = {}
