"""Problem 6: languages of texts and of their segments by compression."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftline.llm.tables import table

#: Bytes of trusted text per language that make its dictionary.
DICTIONARY_BYTES = 64_000
#: A segment keeps its language if the next one needs at least this share of bytes more; else it is "und".
MARGIN = 0.06
#: Words up to which a sentence is one piece; longer ones are cut, so that a change of language without marks is seen.
PIECE_WORDS = 24
#: Least words of a piece that is no whole sentence, to speak for its language alone.
LEAST_WORDS = 8
UNKNOWN = "und"
LATIN = "LATIN"

# The codes and names of the languages, as they may stand in a language column.
NAMES = {
    "amh": ["amh", "am", "amharic", "አማርኛ"],
    "eng": ["eng", "en", "english"],
    "fra": ["fra", "fre", "fr", "french", "francais", "français"],
    "hau": ["hau", "ha", "hausa"],
    "swa": ["swa", "swh", "sw", "swahili", "kiswahili"],
    "yor": ["yor", "yo", "yoruba", "yorùbá"],
}


def fold(text: str) -> tuple[bool, bytes]:
    """Whether a text is in Latin letters, and its bytes without case and marks; letters with no plain form fall away there."""
    if text.isascii():
        return True, text.lower().encode()
    import unicodedata

    plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore")
    if len(plain) * 5 > len(text) * 3:
        return True, plain.lower()
    return False, unicodedata.normalize("NFKC", text).lower().encode("utf-8", "surrogatepass")


@lru_cache(maxsize=1 << 16)
def _script_of(letter: str) -> str:
    import unicodedata

    return unicodedata.name(letter, "").partition(" ")[0]


def script(text: str) -> str:
    """The script of most letters of a text, as the first word of their names; ties go to the first in order."""
    n: Counter[str] = Counter()
    for c, k in Counter(text).items():
        if c.isalpha():
            n[_script_of(c)] += k
    return min(n, key=lambda s: (-n[s], s)) if n else ""


class Compressors:
    """The bytes a piece takes after each language's trusted text; the least is its language."""

    def __init__(self, samples: dict[str, bytes]) -> None:
        import re

        import zstandard as z

        p = z.ZstdCompressionParameters(window_log=16, chain_log=6, hash_log=11, search_log=1, min_match=5, target_length=1, strategy=1, write_content_size=0, write_checksum=0, write_dict_id=0, format=z.FORMAT_ZSTD1_MAGICLESS)
        #: Compressors of the languages by the script of their trusted text; Latin letters are one with all that folds to them.
        self.of: dict[str, list[tuple[str, object]]] = {}
        for name, raw in sorted(samples.items()):
            latin, folded = fold(raw.decode())
            d = z.ZstdCompressionDict(folded, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            self.of.setdefault(LATIN if latin else script(raw.decode()), []).append((name, z.ZstdCompressor(dict_data=d, compression_params=p).compress))
        self.aside = re.compile(r"https?:\S*|(?<!\w)[#@]\w[\w\u0300-\u036f]*|&#?\w+;|<[^<>]*>|\[[^\[\]]*\]", re.I)
        self.between = re.compile(r"[.!?።፧]+(?!\w)|[\n“”«»;]")
        self.word = re.compile(r"\S+")
        self.final = re.compile(r"[.!?።፧]\s*[\"'”’»)]*\s*$")

    def best(self, piece: str) -> tuple[str, float]:
        """The language, or UNKNOWN at a narrow margin, and the share of bytes that the second best needs more.

        Only languages of the piece's script compete; in a script of none it is UNKNOWN. A language that is alone in its script competes with
        the bytes as they are.
        """
        latin, raw = fold(piece)
        sizes = sorted([(len(f(raw)), name) for name, f in self.of.get(LATIN if latin else script(piece), ())])
        if not sizes:
            return UNKNOWN, 0.0
        second = sizes[1][0] if len(sizes) > 1 else max(len(raw), sizes[0][0])
        margin = (second - sizes[0][0]) / max(1, second)
        return (sizes[0][1] if margin >= MARGIN else UNKNOWN), round(max(0.0, margin), 4)

    def pieces(self, text: str) -> tuple[str, list[list]]:
        """The text with blanks for tags, links and notes, and [start, end, words, whole sentence] of its parts."""
        blank = self.aside.sub(lambda m: " " * len(m.group()), text) if any(x in text for x in "#@&<[:") else text
        out = []
        spans, a = [], 0
        for m in self.between.finditer(blank):
            spans.append((a, m.end()))
            a = m.end()
        spans.append((a, len(text)))
        for a, b in spans:
            part = blank[a:b]
            n = len(part.split())
            if not n or not any(map(str.isalpha, part)):
                continue
            if n <= PIECE_WORDS:
                out.append([a, b, n, True])
                continue
            words = list(self.word.finditer(part))
            k = -(-n // PIECE_WORDS)
            cuts = [0, *[words[i * n // k].start() for i in range(1, k)], len(part)]
            for i in range(k):
                out.append([a + cuts[i], a + cuts[i + 1], (i + 1) * n // k - i * n // k, False])
        if out and out[-1][1] >= len(text.rstrip()) and not self.final.search(text, max(0, len(text) - 20)):
            out[-1][3] = False  # it may be cut
        return blank, out

    def label(self, text: str) -> tuple[str, float, list[str], list[tuple[int, int, str, float]]]:
        """Language and confidence of a text, the languages with a whole sentence or most words, and the segments."""
        blank, pieces = self.pieces(text)
        labels = [self.best(blank[a:b]) for a, b, _, _ in pieces]
        # a narrow piece goes with the neighbour, if its neighbours agree or there is one
        for i, (name, margin) in enumerate(labels):
            if name == UNKNOWN:
                near = {labels[j][0] for j in (i - 1, i + 1) if 0 <= j < len(labels)} - {UNKNOWN}
                if len(near) == 1:
                    labels[i] = (near.pop(), margin)
                    pieces[i][3] = False
        words: dict[str, int] = {}
        sure: dict[str, float] = {}
        has: set[str] = set()
        segments: list[tuple[int, int, str, float]] = []
        run = 0
        for (a, b, n, whole), (name, margin) in zip(pieces, labels):
            words[name] = words.get(name, 0) + n
            sure[name] = sure.get(name, 0.0) + n * margin
            if segments and segments[-1][2] == name:
                s = segments[-1]
                segments[-1] = (s[0], b, name, round((s[3] * (s[1] - s[0]) + margin * (b - a)) / max(1, s[1] - s[0] + b - a), 4))
                run += n
            else:
                segments.append((a, b, name, margin))
                run = n
            if name != UNKNOWN and ((whole and n >= 3) or run >= LEAST_WORDS):
                has.add(name)
        if not words:
            return UNKNOWN, 0.0, [], []
        total = sum(words.values())
        top = max(words, key=lambda k: (words[k], k))
        if top != UNKNOWN and words[top] * 2 > total:
            has.add(top)
        return top, round(sure[top] / max(1, total), 4), sorted(has), segments


def trusted_texts(samples: DataFrame, language: str, text: str, most: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """At most ``most`` bytes of sample text per language: what a dictionary of that size can hold."""
    size = F.sum(F.octet_length(text)).over(Window.partitionBy(language).orderBy(F.xxhash64(text), text))
    rows = samples.select(language, text).na.drop().distinct().withColumn("_n", size).filter(F.col("_n") <= most).collect()
    out: dict[str, list[str]] = {}
    for name, t, _ in sorted(rows):
        out.setdefault(name, []).append(t)
    return {k: "\n".join(v).encode() for k, v in out.items()}


def label_languages(df: DataFrame, record: str, text: str, samples: dict[str, bytes]) -> DataFrame:
    """Language and confidence of each text and of each segment, in one pass without a shuffle.

    A text is cut into sentences, long ones further; every piece is compressed after the raw
    trusted text of each language that is written in its script, and gets the language with the
    fewest bytes unless the margin to the second is below MARGIN; such pieces follow their
    neighbours. Neighbouring pieces of a language are one segment. Returns ``record, language,
    confidence, languages`` (with a whole sentence or most of the words) and
    ``segments`` (start, end, language, confidence). Null and blank texts and texts without
    letters get "und", 0.0 and no segments. Repeated rows give repeated results; other columns are ignored.
    """
    schema = f"_record {df.schema[record].dataType.simpleString()}, language string, confidence double, languages array<string>, segments array<struct<start: int, end: int, language: string, confidence: double>>"
    seg = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("language", pa.string()), ("confidence", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Compressors(samples)
        for batch in batches:
            rows = [c.label(t) if t else (UNKNOWN, 0.0, [], []) for t in batch.column(1).to_pylist()]
            flat = [s for r in rows for s in r[3]]
            ends = [0]
            for r in rows:
                ends.append(ends[-1] + len(r[3]))
            parts = [pa.array([s[i] for s in flat], seg.field(i).type) for i in range(4)]
            segments = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(seg)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.list_(pa.string())), segments],
                ["_record", "language", "confidence", "languages", "segments"],
            )

    return df.select(record, text).mapInArrow(run, schema).withColumnRenamed("_record", record)


def named_language(name: Column, languages: list[str] | None = None) -> Column:
    """The code of the language that a free-form code or name names; null for none. Of ``languages`` those without known names are named by their code."""
    first = F.regexp_extract(F.lower(F.trim(F.regexp_replace(name, r"[\p{Z}\p{C}]+", " "))), r"^([\p{L}\p{M}]+)", 1)
    out = F.lit(None).cast("string")
    for code, names in ({code: [code.lower()] for code in languages or []} | NAMES).items():
        out = F.when(first.isin(names), code).otherwise(out)
    return out


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    samples = trusted_texts(table(spark, sf_dir, "lang_samples"), "language", "text")
    # the language column rides along in the record, so that no join is needed
    rows = table(spark, sf_dir, "candidates").filter(F.col("candidate_id").isNotNull())
    rows = rows.select(F.struct("candidate_id", F.col("language").alias("named")).alias("record"), "text")
    return label_languages(rows, "record", "text", samples), sorted(samples)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of a candidate's text that its language column does not name."""
    labelled, languages = _labelled(spark, sf_dir)
    found = labelled.select("record", F.explode("languages").alias("_language"))
    wrong = found.filter(~F.col("_language").eqNullSafe(named_language(F.col("record.named"), languages)))
    return wrong.select("record.candidate_id", F.col("_language").alias("language")).distinct()


def p6_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of every candidate's text with language and confidence."""
    rows = _labelled(spark, sf_dir)[0].select("record.candidate_id", F.posexplode("segments").alias("segment", "_s"))
    return rows.select("candidate_id", "segment", "_s.start", "_s.end", "_s.language", "_s.confidence").dropDuplicates(["candidate_id", "segment"])


QUERIES = {"p6_found": p6_found, "p6_segments": p6_segments}
SQL: dict[str, str] = {}
