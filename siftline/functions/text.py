"""Text functions as column expressions; none of them leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: runs of letters, digits and underscores are tokens, every other visible sign is one, combining marks too.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]"
WORD = r"[\p{L}\p{N}_]+"
GLUE = "\u0001"


def tokens(text: Column) -> Column:
    """Lower-case tokens; null text gives an empty list."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def token_ngrams(t: Column, n: int) -> Column:
    """Distinct n-grams of a column of tokens as glued strings; none if it has fewer tokens.

    Takes a column, not an expression of the text: within the lambda that would be evaluated for every gram.
    """
    grams = F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), GLUE))
    return F.when(F.size(t) >= n, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


#: Blanks of every kind; the last ones are separators that count as blanks too.
EDGE = r"[\s\p{Z}\x1c-\x1f\x85]+"


def stripped(text: Column) -> Column:
    """Without outer blanks and line ends of any kind."""
    return F.regexp_replace(text, f"^{EDGE}|{EDGE}$", "")


def stable_hash(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


# Fixed value: what stands for the middle of a compacted text.
MARKER = "\n[... excerpt truncated ...]\n"


def compact_text(text: Column, most: int | Column = 2200, marker: str = MARKER, head_share: float = 0.65) -> Column:
    """A stripped text; of a longer one the head, a marker and the tail, 65 % of the room for the head. Null counts as empty."""
    s = stripped(F.coalesce(text, F.lit("")))
    most = F.lit(most) if isinstance(most, int) else most
    room = F.greatest(F.lit(0), most - len(marker))
    head = F.greatest(F.lit(1), F.floor(room * head_share).cast("int"))
    tail = F.greatest(F.lit(1), room - head)
    cut = F.concat(F.regexp_replace(F.substring(s, F.lit(1), head), f"{EDGE}$", ""), F.lit(marker), F.regexp_replace(F.substring(s, -tail, tail), f"^{EDGE}", ""))
    return F.when(F.length(s) <= most, s).otherwise(cut)


def was_compacted(text: Column, most: int | Column = 2200) -> Column:
    return F.length(stripped(F.coalesce(text, F.lit("")))) > most


def words_of(text: Column) -> Column:
    """Parts between blanks of any kind."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), EDGE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words_of(text))


def strip_fence(text: Column) -> Column:
    """The first fenced block of a reply, without its fence; the reply itself if there is none."""
    inner = F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)```", 1)
    return F.when(inner != "", stripped(inner)).otherwise(stripped(text))


def csv_cell(text: Column) -> Column:
    """Quoted only where a comma, quote or line end asks for it."""
    return F.when(text.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def bounded(x: Column, default: float = 0.0) -> Column:
    """A number held in [0, 1]; what is no number becomes the default; NaN becomes 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x.cast("double") if not isinstance(x, str) else F.col(x), F.lit(default))))


def slug_part(slug: Column, letter: str) -> Column:
    """The number after ``letter`` in a slug such as b64_m3_s13; null without one."""
    return F.nullif(F.regexp_extract(slug, rf"(?:^|_){letter}(\d+)", 1), F.lit("")).cast("bigint")
