"""Problem 5: texts cut off by field limits or in transfer."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftline.llm.tables import table
from siftline.operators.staging import written

#: Kinds of ending: a sure remnant of a cut, a sure end, or words whose end the corpus must judge.
CUT, WHOLE, OPEN, DOTTED = 2, 0, 1, 3
#: An open ending is cut if fewer than this share of the places like it end a sentence.
END_SHARE = 0.3
#: The same at lengths at which significantly many open texts stop; there a last name or number may be a part of one, so it is taken as cut.
END_SHARE_AT_LIMIT = 0.9
FALSE_DISCOVERIES = 0.05
NEIGHBOURS = 12
FLUSH = 200_000
_SCHEMA = "record string, source string, chars int, bytes int, kind int, keys array<string>, key string, ends bigint, goes_on bigint"


class Endings:
    """How a text ends, and what each place within a text says about ends of sentences."""

    def __init__(self) -> None:
        import regex

        c = regex.compile
        self.trail = c(r"[\s\p{Z}\p{Cf}\p{Cc}]+$")
        self.dots = c(r"[\s\p{Z}]*[\[(]?(?:…|\.\.\.+)[\])]?$")
        self.remnant = c(r"(?:�+|&#?\w{0,7}|<[!/]?\w*(?:\s[^<>]*)?|\\(?:u[0-9a-fA-F]{0,3})?|[\[({]\s?\w*|\bhttps?:?/{0,2}[^\s/]*|\bht{1,2}p?)$", regex.I)
        self.extra = c(r"(?:https?://[^\s/]+/\S+|(?<![^\s\p{Z}\p{P}])[#@]\w[\w\p{M}]*|[\[({][^\[\](){}]*[\])}]|[\p{Extended_Pictographic}\p{Emoji_Modifier}\p{Regional_Indicator}‍️⃣]+)$", regex.I)
        self.mark = c(r"[.!?።፧؟。！？‽‼⁉‥]+[\s\p{Z}]*[\"'”’»›)\]}*_~`]*$")
        self.part = c(r"[\p{L}\p{N}][\p{L}\p{M}\p{N}'’ʼ-]*|[^\p{L}\p{M}\p{N}\s\p{Z}\p{Cf}'’ʼ-]+|\n")
        self.letters = c(r"\p{L}")
        self.aside = c(r"https?:\S*|(?<!\w)[#@]\w[\w\p{M}]*|&#?\w+;|<[^<>]*>|\[[^\[\]]*\]", regex.I)

    def kind(self, text: str) -> tuple[int, str]:
        """CUT, WHOLE or OPEN, and the text without what follows its last word."""
        s = self.trail.sub("", text)
        if not s:
            return WHOLE, ""
        kind, m = OPEN, self.dots.search(s)
        if m:
            kind = DOTTED
            s = self.trail.sub("", s[: m.start()])
            if not s or self.mark.search(s):
                return WHOLE, ""
        elif self.mark.search(s):
            return WHOLE, ""
        if self.extra.search(s):
            return WHOLE, ""
        if self.remnant.search(s):
            return CUT, ""
        tail = s.rstrip("\"”»›*_~`")
        if not tail or not (tail[-1].isalnum() or tail[-1] in "'’" or not self.letters.search(tail) or _combining(tail[-1])):
            return (CUT if tail and tail[-1] in ",;:–—-፣፤፥፦፡/&+=(" else WHOLE), ""
        return kind, tail

    def words(self, text: str) -> list[tuple[str, int]]:
        """Words with what follows each: 0 another word, 1 a comma or the like, 2 an end of a sentence.

        Within sentences of cased scripts all names become one word, as do all numbers. Links,
        tags and markup are no words.
        """
        loud = text.isupper()
        out: list[tuple[str, int]] = []
        first = True
        for p in self.part.findall(self.aside.sub("\n", text)):
            a = p[0]
            if a.isalpha() or a.isdigit():
                if a.isdigit():
                    w = "0"
                elif loud or first or not a.isupper():
                    w = p.lower()
                else:
                    w = "N"
                out.append((w, 0))
                first = False
            else:
                first = p[-1] in ".!?።\n"
                if out:
                    out[-1] = (out[-1][0], 2 if first or p[0] in ".!?።;" else max(1, out[-1][1]))
        return out

    @staticmethod
    def last_keys(text: str, words: list[tuple[str, int]]) -> list[str]:
        """Contexts of the last word, from the most special to the most general one."""
        w = words[-1][0]
        b = words[-2][0] if len(words) > 1 and not words[-2][1] else "^"
        a = words[-3][0] if len(words) > 2 and b != "^" and not words[-3][1] else "^"
        keys = [f"3\t{a}\t{b}\t{w}", f"2\t{b}\t{w}", f"1\t{w}"]
        if w != "N" and (text.isupper() or text.islower()) and w[0].lower() != w[0].upper():
            keys.append(f"2\t{b}\tN")  # it may be a name in disguise
        elif w[0].lower() == w[0].upper() and b != "^":
            keys.append(f"0\t{b}")  # without case, a name can't be told from a part of a word
        return keys


def _combining(c: str) -> bool:
    import unicodedata

    return unicodedata.category(c)[0] == "M"


def _endings(df: DataFrame, record: str, text: str, source: str) -> DataFrame:
    """One row per text with how it ends, and partial counts of the contexts of all places, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Endings()
        counts: Counter[tuple[str, str, str, int]] = Counter()
        places: list[tuple[str, str, str, int]] = []
        schema = pa.schema([("record", pa.string()), ("source", pa.string()), ("chars", pa.int32()), ("bytes", pa.int32()), ("kind", pa.int32()), ("keys", pa.list_(pa.string())), ("key", pa.string()), ("ends", pa.int64()), ("goes_on", pa.int64())])

        def flush() -> pa.RecordBatch:
            by_key: dict[str, list[int]] = {}
            for (a, b, w, follows), n in counts.items():
                for k in (f"3\t{a}\t{b}\t{w}", f"2\t{b}\t{w}", f"1\t{w}", f"0\t{b}"):
                    c = by_key.get(k)
                    if c is None:
                        c = by_key[k] = [0, 0]
                    c[0 if follows else 1] += n
            counts.clear()
            none = lambda k: pa.nulls(len(by_key), schema.field(k).type)
            v = list(by_key.values())
            return pa.RecordBatch.from_arrays([none(i) for i in range(6)] + [pa.array(list(by_key), pa.string()), pa.array([x[0] for x in v], pa.int64()), pa.array([x[1] for x in v], pa.int64())], schema=schema)

        for batch in batches:
            ids, texts, sources = (batch.column(i).to_pylist() for i in range(3))
            chars, sizes, kinds, keys = [], [], [], []
            for t in texts:
                t = t or ""
                kind, tail = look.kind(t)
                words = look.words(t)
                key = None
                if kind in (OPEN, DOTTED):
                    if words:
                        key = look.last_keys(t, words)
                    else:
                        kind = WHOLE
                chars.append(len(t))
                sizes.append(len(t.encode("utf-8", "surrogatepass")))
                kinds.append(kind)
                keys.append(key)
                a = b = "^"
                for w, follows in words[:-1]:  # what follows the last word is what is asked
                    if follows != 1:
                        places.append((a, b, w, follows))
                    a, b = ("^", "^") if follows else (b, w)
            counts.update(places)
            places.clear()
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(sources, pa.string()), pa.array(chars, pa.int32()), pa.array(sizes, pa.int32()), pa.array(kinds, pa.int32()), pa.array(keys, pa.list_(pa.string())), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], schema=schema
            )
            if len(counts) > FLUSH:
                yield flush()
        if counts:
            yield flush()

    return df.select(F.col(record).cast("string"), text, F.col(source).cast("string")).mapInArrow(run, _SCHEMA)


def length_hazards(texts: DataFrame, stops: Column, source: str, length: str) -> DataFrame:
    """``source, length, n, reach, p, significant`` for every length at which a text of a source ends.

    The hazard of a length is the texts that stop there (those with ``stops``) by all texts of the
    source that reach it. It is tested against the pooled hazard of the NEIGHBOURS lengths on
    either side, their stops by the sum of the texts that reach each of them, by a normal bound of the
    Poisson tail; the lengths of a source are significant up to the largest rank whose p-value is
    below its share of FALSE_DISCOVERIES, if at least 3 texts stop there. Texts of a null source are one
    source. Windows run over the distinct lengths of a source, never over its texts.
    """
    hist = texts.groupBy(source, length).agg(F.count(F.lit(1)).alias("every"), F.count_if(stops).alias("n"))
    every = Window.partitionBy(source)
    by, at = every.orderBy(F.col(length)), F.col(length)
    near = by.rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    reach = hist.withColumn("reach", F.sum("every").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    # the texts that reach each length of the window, summed: one that stops within it reaches the lengths up to its own, one behind it all
    inside, behind = F.sum("every").over(near), F.coalesce(F.sum("every").over(by.rangeBetween(NEIGHBOURS + 1, Window.unboundedFollowing)), F.lit(0))
    reached = F.sum(F.col("every") * at).over(near) - (at - NEIGHBOURS - 1) * inside + (2 * NEIGHBOURS + 1) * behind
    below = F.greatest(F.lit(0), NEIGHBOURS + 1 - at) * F.sum("every").over(every)  # no text stops at a length under 1
    pooled = reach.withColumn("others", F.sum("n").over(near) - F.col("n")).withColumn("at_risk", F.greatest(reached - below - F.col("reach"), F.lit(1)))
    expected = F.greatest((F.col("others") + 1) / F.col("at_risk") * F.col("reach"), F.lit(0.05))
    # Chernoff's bound of the Poisson tail: P(N >= n) <= exp(n - e - n ln(n / e)) for n > e
    logp = F.when(F.col("n") > expected, F.col("n") - expected - F.col("n") * F.log(F.col("n") / expected)).otherwise(F.lit(0.0))
    # lengths at which no text stops aren't tested; they are no hypotheses
    tested = pooled.withColumn("p", F.when(F.col("n") > 0, F.exp(logp)))
    ranked = tested.withColumn("_i", F.row_number().over(Window.partitionBy(source).orderBy(F.asc_nulls_last("p")))).withColumn("_m", F.count("p").over(every))
    # a window and no join, so that a null source is one like any other
    limit = F.max(F.when(F.col("p") <= FALSE_DISCOVERIES * F.col("_i") / F.col("_m"), F.col("p"))).over(every)
    significant = F.coalesce((F.col("p") <= limit) & (F.col("n") >= 3), F.lit(False))
    return ranked.select(source, length, "n", "reach", "p", significant.alias("significant"))


def truncated(df: DataFrame, record: str, text: str, source: str) -> DataFrame:
    """``record, source, cut, cause``: for every text whether it stops within a word or sentence, and by what.

    Each length of a source is tested for its hazard first, in characters and in bytes (``length_hazards``),
    and the test decides by which rule the texts of that length are read; no text is judged without it.

    ``limit``: at a significant length incomplete endings are cut: what a cut leaves (half an entity, tag,
    escape or link, a replacement character, a comma) and every word, name or number without a final mark, unless the
    corpus nearly always (END_SHARE_AT_LIMIT) ends a sentence at that word after the two words before.
    ``transfer``: at other lengths, where no limit explains an end, only remnants are cut, and words at which
    the corpus seldom (END_SHARE) ends a sentence, backing off to shorter contexts; a word that it never has elsewhere is cut.

    Whole: ends in a final mark, or in a tag, link, emoji or bracketed note; null and blank texts.
    Texts of a null source are one source. Rows repeated under one record count once; a null record gives no row.
    """
    rows = written(_endings(df.filter(F.col(record).isNotNull()), record, text, source), "endings")
    texts = rows.filter(F.col("key").isNull()).drop("key", "ends", "goes_on").dropDuplicates(["record"])
    ended = texts.filter(F.col("kind") == WHOLE).select("record", "source", F.lit(None).cast("string").alias("cause"), F.lit(None).cast("double").alias("share"), F.lit(None).cast("int").alias("level"))
    judged = texts.filter(F.col("kind") != WHOLE)
    for unit in ("chars", "bytes"):
        tested = length_hazards(texts, F.col("kind").isin(OPEN, CUT), "source", unit).select(F.col("source").alias("_source"), F.col(unit).alias("_length"), F.col("significant").alias(f"at_{unit}"))
        judged = judged.join(tested, judged["source"].eqNullSafe(F.col("_source")) & (F.col(unit) == F.col("_length"))).drop("_source", "_length")
    contexts = rows.filter(F.col("key").isNotNull()).groupBy("key").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on"))
    asked = texts.filter(F.col("kind").isin(OPEN, DOTTED)).select("record", F.posexplode("keys").alias("level", "key"))
    # a place decides if it was seen often enough; the most special one that does counts
    seen = asked.join(contexts, "key").filter(F.col("ends") + F.col("goes_on") >= 3)
    share = seen.groupBy("record").agg(F.min_by((F.col("ends") + 0.0) / (F.col("ends") + F.col("goes_on")), "level").alias("share"), F.min("level").alias("level"))
    judged = judged.join(share, "record", "left")
    limit = (F.col("kind") != DOTTED) & (F.col("at_chars") | F.col("at_bytes"))  # dots were put behind the cut
    ends = F.coalesce("share", F.lit(0.0))
    name = F.coalesce(F.element_at("keys", 3).isin("1\tN", "1\t0"), F.lit(False))
    cause = F.when(limit & ((F.col("kind") == CUT) | name | (ends < END_SHARE_AT_LIMIT)), "limit").when(~limit & ((F.col("kind") == CUT) | (ends < END_SHARE)), "transfer")
    every = judged.select("record", "source", cause.alias("cause"), "share", "level").unionByName(ended)
    return every.select("record", "source", F.col("cause").isNotNull().alias("cut"), "cause", "share", "level")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates whose text was cut."""
    found = truncated(table(spark, sf_dir, "candidates"), "candidate_id", "text", "generator").filter("cut")
    return found.select(F.col("record").alias("candidate_id"))


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each generator, its candidates, those cut at a length limit and in transfer, and the share of both."""
    every = truncated(table(spark, sf_dir, "candidates"), "candidate_id", "text", "generator")
    n = every.groupBy(F.col("source").alias("generator")).agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("cause") == "limit").alias("at_limit"), F.count_if(F.col("cause") == "transfer").alias("in_transfer"), F.count_if("cut").alias("cut"))
    return n.withColumn("share", F.round(F.col("cut") / F.col("candidates"), 6))


def p5_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The significant lengths of each generator, in characters and in bytes, with the texts that stop there and those that reach it."""
    rows = _endings(table(spark, sf_dir, "candidates").filter(F.col("candidate_id").isNotNull()), "candidate_id", "text", "generator")
    texts = written(rows.filter(F.col("key").isNull()).select("record", "source", "chars", "bytes", "kind").dropDuplicates(["record"]), "lengths")
    one = lambda u: length_hazards(texts, F.col("kind").isin(OPEN, CUT), "source", u).filter("significant").select(F.col("source").alias("generator"), F.lit(u).alias("unit"), F.col(u).alias("length"), "n", "reach")
    return one("chars").unionByName(one("bytes"))


QUERIES = {"p5_found": p5_found, "p5_rates": p5_rates, "p5_limits": p5_limits}
SQL: dict[str, str] = {}
