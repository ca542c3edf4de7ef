"""Problem 9: text quality statistics and distance from natural prose."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.tables import table
from siftline.operators.staging import written

#: The statistics whose joint distribution makes prose, as columns of ``text_statistics`` or of these.
SHAPE = ["mean_word_length", "symbols", "common_share", "digits", "distinct_pairs", "sentence_words", "punctuated_lines", "words"]
#: Least spread of each, so that a corpus of equal texts has a distance at all.
LEAST_SPREAD = [0.1, 0.02, 0.02, 0.03, 0.05, 0.1, 0.2, 0.3]
#: Rounds in which mean and covariance are taken again from the texts that lie near the last ones.
ROUNDS = 5
#: Squared distance within which a text counts as near; the 99.9 % point of 8 normal statistics.
NEAR = 26.1
#: Share of words among a language's common ones from which a text is measured against that language only.
LEAST_KNOWN = 0.06
#: Distance from prose beyond which a text is none, where the distances of a corpus show no valley of their own; about twice that of the last of 1000 normal texts.
NO_PROSE = 12.0
#: Bins of a sixteenth of an octave of distance on either side over which the histogram is smoothed before its valley is sought.
SMOOTH = 2


class Statistics:
    def __init__(self, common: dict[str, list[str]]) -> None:
        import re

        self.common = {k: {_marks_off(w).lower() for w in v} for k, v in common.items()}
        self.any = set().union(*self.common.values()) if self.common else set()
        self.languages = {w: [k for k, s in self.common.items() if w in s] for w in self.any}
        self.aside = re.compile(r"</?[A-Za-z!][^<>]*>|https?://\S+|&#?\w+;")
        self.word = re.compile(r"[^\W_](?:[^\W_]|['’])*")
        self.end = re.compile(r"[.!?።፧…]+(?!\w)|\n")
        self.final = ".!?።፧…"
        # neither letter, digit, mark, invisible character nor part of an emoji
        self.symbol = re.compile("[^\\w\\s\u0300-\u036f\u00ad\u200b-\u200f\u2060\u2600-\u27bf\ufe0f\ufeff\U0001f000-\U0010ffff]|_")

    def __call__(self, text: str) -> tuple | None:
        """The statistics of a text; None if it has nothing but blanks."""
        body = self.aside.sub(" ", text) if "<" in text or "http" in text or "&" in text else text
        if not body.strip() and not text.strip():
            return None
        body = "\n".join(body.splitlines())
        words = self.word.findall(_marks_off(body).lower())
        n = len(words)
        seen = "".join(body.split())
        symbols = len(self.symbol.findall(body))
        lines = [x for x in map(str.strip, body.split("\n")) if x]
        ended = sum(1 for x in lines if x.rstrip("\"'”’»)]*_ ")[-1:] in self.final and x.rstrip("\"'”’»)]*_ "))
        known = [w for w in words if w in self.any]
        votes: dict[str, int] = {}
        for w in known:
            for k in self.languages[w]:
                votes[k] = votes.get(k, 0) + 1
        language = max(votes, key=lambda k: (votes[k], k)) if votes else None
        if language and votes[language] < LEAST_KNOWN * n:
            language = None
        sentences = sum(1 for x in self.end.split(body) if x and not x.isspace())
        pairs = len(set(zip(words, words[1:])))
        return (
            n,
            sum(map(len, words)) / n if n else 0.0,
            symbols / max(1, len(seen)),
            ended / max(1, len(lines)),
            len(known) / n if n else 0.0,
            sum(1 for w in words if w[0].isdigit()) / n if n else 0.0,
            pairs / (n - 1) if n > 1 else 1.0,
            n / max(1, sentences),
            language,
        )


def _marks_off(text: str) -> str:
    if text.isascii():
        return text
    import unicodedata

    text = unicodedata.normalize("NFKD", text)
    if not _marks_off.other.search(text):  # type: ignore[attr-defined]
        for a, b in ((" ", " "), ("’", "'"), ("–", " "), ("—", " "), ("…", " "), ("“", " "), ("”", " "), ("»", " "), ("«", " "), ("•", " "), ("·", " ")):
            text = text.replace(a, b)
        return text.encode("ascii", "ignore").decode()
    return _marks_off.marks.sub("", text)  # type: ignore[attr-defined]


def _compile() -> None:
    import re

    _marks_off.marks = re.compile("[̀-ͯ­​-‏⁠-⁤﻿]+")  # type: ignore[attr-defined]
    _marks_off.other = re.compile("[Ͱ-ᶿⰀ-퟿豈-﫿]")  # type: ignore[attr-defined]


_compile()
_COLUMNS = ["word_count", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_share", "digit_share", "distinct_pairs", "sentence_words"]


def text_statistics(df: DataFrame, key: str, text: str, common: dict[str, list[str]]) -> DataFrame:
    """One row of statistics per text, in one pass without a shuffle.

    ``word_count``; ``mean_word_length``; ``symbol_ratio`` of the characters that are no blanks;
    ``punctuated_lines``, the share of lines that end in a final mark; ``common_share`` of the words
    in any language's common words; ``digit_share`` of words that are numbers; ``distinct_pairs``
    of neighbouring words by all pairs; ``sentence_words``, words per sentence or line; and
    ``language``, the one with most common words. Links and markup are left out before counting.
    Null, empty and blank texts get nulls; texts without words get zeros and no language.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Statistics(common)
        for batch in batches:
            rows = [(measure(t) if t else None) or (None,) * 9 for t in batch.column(1).to_pylist()]
            types = [pa.int64(), *[pa.float64()] * 7, pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]], ["_key", *_COLUMNS, "language"])

    schema = "_key " + kind + ", word_count bigint, " + ", ".join(f"{c} double" for c in _COLUMNS[1:]) + ", language string"
    return df.select(key, text).mapInArrow(run, schema).withColumnRenamed("_key", key)


def _shape(stats: DataFrame) -> DataFrame:
    """Statistics on scales on which those of prose are about normal, as the array ``x``."""
    parts = [F.col("mean_word_length"), F.sqrt("symbol_ratio"), F.col("common_share"), F.sqrt("digit_share"), F.col("distinct_pairs"), F.log1p("sentence_words"), F.col("punctuated_lines"), F.log1p(F.col("word_count").cast("double"))]
    return stats.withColumn("x", F.when(F.col("word_count").isNotNull(), F.array(*parts)))


Model = dict[str, tuple[list[float], list[list[float]]]]
#: Bins of squared distances to an octave, and how many there are from 2 ** -8 on; all beyond fall in the last.
BINS, MOST_BINS = 8, 256
#: Median of the squared distance of as many normal statistics.
MEDIAN = 7.344


def _matrix(batch: pa.RecordBatch, column: int):
    import numpy as np

    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(SHAPE)).astype(np.float64)


def _moments(rows: DataFrame, model: Model) -> DataFrame:
    """``language, bin, n, s``: of every language and bin of squared distance the rows, their sums and their products, added up batch by batch.

    One pass without joins; each task gives one row per language and bin, and these are added up.
    """
    import numpy as np

    d = len(SHAPE)
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], list] = {}
        known = {k: (np.array(m), np.array(p)) for k, (m, p) in model.items()}
        for batch in batches:
            language, x = np.array(batch.column(0).to_pylist(), object), _matrix(batch, 1)
            for k, (mean, inverse) in known.items():
                mine = x[language == k]
                if not len(mine):
                    continue
                off = mine - mean
                squared = np.einsum("ij,jk,ik->i", off, inverse, off)
                at = np.clip(np.floor(BINS * (np.log2(np.maximum(squared, 2.0**-8)) + 8)), 0, MOST_BINS - 1).astype(int)
                for b in np.unique(at):
                    part = mine[at == b]
                    s = np.concatenate([part.sum(0), (part.T @ part)[upper]])
                    t = total.setdefault((k, int(b)), [0, 0.0])
                    t[0] += len(part)
                    t[1] = t[1] + s
        if total:
            keys, values = list(total), list(total.values())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys]), pa.array([b for _, b in keys], pa.int32()), pa.array([n for n, _ in values], pa.int64()), pa.array([s.tolist() for _, s in values], pa.list_(pa.float64()))], ["language", "bin", "n", "s"])

    parts = rows.select("language", "x").mapInArrow(run, "language string, bin int, n bigint, s array<double>")
    sums = [F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(d + d * (d + 1) // 2)]
    return parts.groupBy("language", "bin").agg(F.sum("n").alias("n"), *sums)


def fit_prose(stats: DataFrame) -> Model:
    """Mean and inverse covariance of the prose of each language, robustly and over all texts.

    Starts from medians and median deviations, then ROUNDS times takes mean and covariance of
    the texts within the squared distance NEAR, scaled so that the median text is at the median of
    the normal case. Every round is one pass whose sums are kept by bins of the distance, so that the median and the
    sums of what lies within it come from the same pass; only those, a few hundred rows for each language, come to the driver.
    """
    import numpy as np

    d = len(SHAPE)
    x = [F.col("x")[i] for i in range(d)]
    rows = stats.filter(F.col("language").isNotNull() & F.col("x").isNotNull())
    medians = {r.language: [float(r[f"m{i}"]) for i in range(d)] for r in rows.groupBy("language").agg(*[F.percentile_approx(x[i], 0.5, 1000).alias(f"m{i}") for i in range(d)]).collect()}
    if not medians:
        return {}
    mid = F.create_map(*[F.lit(v) for k, m in medians.items() for v in (k, m)])[F.col("language")]  # as many as languages
    dev = rows.withColumn("_mid", mid).groupBy("language").agg(*[F.percentile_approx(F.abs(x[i] - F.col("_mid")[i]), 0.5, 1000).alias(f"s{i}") for i in range(d)])
    model = {r.language: (np.array(medians[r.language]), np.diag([max(1.4826 * r[f"s{i}"], LEAST_SPREAD[i]) ** 2 for i in range(d)])) for r in dev.collect()}
    floor = np.diag(np.array(LEAST_SPREAD) ** 2 / 4)
    upper = np.triu_indices(d)
    for _ in range(ROUNDS):
        bins: dict[str, list] = {}
        for r in _moments(rows, inverted(model)).collect():
            bins.setdefault(r.language, []).append((r.bin, r.n, np.array(r[3:])))
        for k, found in bins.items():
            found.sort(key=lambda b: b[0])
            up = np.cumsum([n for _, n, _ in found])
            middle = found[int(np.searchsorted(up, up[-1] / 2))][0]
            scale = max(1.0, 2.0 ** ((middle + 0.5) / BINS - 8) / MEDIAN)
            near = [(n, s) for b, n, s in found if 2.0 ** ((b + 0.5) / BINS - 8) <= NEAR * scale]
            n = sum(n for n, _ in near)
            if n < 3 * d:
                continue
            s = sum(s for _, s in near)
            mean, second = s[:d] / n, np.zeros((d, d))
            second[upper] = s[d:] / n
            second = second + second.T - np.diag(np.diag(second))
            model[k] = (mean, second - np.outer(mean, mean) + floor)
    return inverted(model)


def inverted(model: dict) -> Model:
    import numpy as np

    return {k: (m.tolist(), np.linalg.inv(c).tolist()) for k, (m, c) in model.items()}


def with_distance(rows: DataFrame, key: str, model: Model) -> DataFrame:
    """``key, *statistics, language, squared, parts``: the squared Mahalanobis distance and what each statistic adds to it, in one pass.

    A text of a language without a model, or of none, is measured against all, the nearest counts, and its language is null. Texts without statistics get nulls.
    """
    import numpy as np

    kind = rows.schema[key].dataType.simpleString()
    names = list(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        means, inverses = np.array([model[k][0] for k in names]), np.array([model[k][1] for k in names])
        for batch in batches:
            language = batch.column(1).to_pylist()
            there = np.nonzero(np.array(batch.column(2).is_valid()))[0]
            squared = np.full(batch.num_rows, np.nan)
            parts = np.zeros((batch.num_rows, len(SHAPE)))
            if len(there):
                x = _matrix(batch, 2)
                own = np.array([names.index(language[i]) if language[i] in model else -1 for i in there])
                off = x[:, None, :] - means[None]
                every = np.einsum("ijk,jkl->ijl", off, inverses) * off
                best = np.where(own >= 0, own, every.sum(2).argmin(1))
                parts[there] = every[np.arange(len(there)), best]
                squared[there] = parts[there].sum(1)
            none = np.isnan(squared)
            lists = pa.array([None if none[i] else parts[i].tolist() for i in range(batch.num_rows)], pa.list_(pa.float64()))
            known = pa.array([k if k in model else None for k in language], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), known, pa.array(squared, pa.float64(), mask=none), lists], ["_key", "language", "squared", "parts"])

    # the other columns ride along in the key
    rider = rows.select(F.struct(key, *_COLUMNS).alias("_r"), "language", "x")
    kind = rider.schema["_r"].dataType.simpleString()
    out = rider.mapInArrow(run, f"_key {kind}, language string, squared double, parts array<double>")
    return out.select("_key.*", "language", "squared", "parts")


def valley(histogram: dict[int, int]) -> float:
    """The distance at the lowest place between the prose's mode and the highest mode behind it; NO_PROSE where there is no second one.

    ``histogram`` counts texts by bin of squared distance. A second mode is at least twice as high as the lowest place
    before it. Of equally low places the middle one counts.
    """
    import numpy as np

    if not histogram:
        return NO_PROSE
    h = np.zeros(MOST_BINS)
    h[list(histogram)] = list(histogram.values())
    h = np.convolve(h, np.ones(2 * SMOOTH + 1), "same")
    mode = int(h.argmax())
    low = np.minimum.accumulate(h[mode:])
    behind = np.where((h[mode:] >= 2 * low) & (h[mode:] > 2 * SMOOTH), h[mode:], 0.0)
    behind[0] = 0.0
    if not behind.any():
        return NO_PROSE
    part = h[mode : mode + int(behind.argmax()) + 1]
    lowest = np.nonzero(part == part.min())[0]
    return float(2.0 ** (((mode + lowest[len(lowest) // 2] + 0.5) / BINS - 8) / 2))


def prose_distances(df: DataFrame, key: str, text: str, common: dict[str, list[str]]) -> DataFrame:
    """The statistics of every text with its distance from its language's prose.

    Adds ``distance``, a robust Mahalanobis distance over all statistics, ``contribution``, the
    share of its square that each statistic makes, and ``natural``, whether it is at most
    the corpus's own cut: the valley of its distances between prose and the rest (``valley``). Texts with hardly a common word are measured against all languages, the nearest counts.
    Null, empty and blank texts get nulls.
    """
    stats = written(_shape(text_statistics(df, key, text, common)), "statistics")
    model = fit_prose(stats)
    if not model:
        blank = F.col("x").isNull()
        return stats.select(key, *_COLUMNS, "language", F.lit(None).cast("double").alias("distance"), F.lit(None).cast("map<string,double>").alias("contribution"), F.when(~blank, F.lit(False)).alias("natural"))
    out = written(with_distance(stats, key, model), "distances")
    octave = F.least(F.lit(MOST_BINS - 1), F.floor(BINS * (F.log2(F.greatest("squared", F.lit(2.0**-8))) + 8)))
    cut = valley({int(r.b): r["count"] for r in out.filter(F.col("squared").isNotNull()).groupBy(octave.alias("b")).count().collect()})
    share = F.map_from_arrays(F.array(*[F.lit(s) for s in SHAPE]), F.transform("parts", lambda p: p / F.greatest("squared", F.lit(1e-9))))
    distance = F.sqrt(F.greatest("squared", F.when(F.col("squared").isNotNull(), 0.0)))
    return out.select(key, *_COLUMNS, "language", distance.alias("distance"), share.alias("contribution"), (distance <= cut).alias("natural"))


def _prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a fixed table of function words: its size is that of the languages' grammars, not of the data
    words = table(spark, sf_dir, "common_words").na.drop().groupBy("language").agg(F.sort_array(F.collect_set("word")).alias("w")).collect()
    return prose_distances(table(spark, sf_dir, "documents").filter(F.col("doc_id").isNotNull()), "doc_id", "text", {r.language: list(r.w) for r in words})


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are no natural prose."""
    return _prose(spark, sf_dir).filter(~F.col("natural")).select("doc_id")


def p9_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of every document, its distance from prose and the statistic that adds most to it."""
    rows = _prose(spark, sf_dir)
    most = F.array_max(F.transform(F.map_entries("contribution"), lambda e: F.struct(e["value"], e["key"])))["key"]
    return rows.select("doc_id", *_COLUMNS, "language", F.round("distance", 4).alias("distance"), most.alias("mainly"), "natural")


QUERIES = {"p9_found": p9_found, "p9_stats": p9_stats}
SQL: dict[str, str] = {}
