"""How far a text gives its label away by its form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import WORD

# Marks of templates, punctuation, and the weights of the score.
MARKS = ["[variant", "counterfactual label cue"]
PUNCTUATION = "[!?.,;:]"
WEIGHTS = {"label_word": 0.35, "template": 0.30, "length": 0.20, "names": 0.10, "punctuation": 0.05}


def form_features(df: DataFrame, text: str) -> DataFrame:
    """Adds the features of ``artifact_features`` that each text has by itself, all but label_word."""
    body = F.coalesce(text, F.lit(""))
    length = F.regexp_count(body, F.lit(WORD))
    capital = F.regexp_count(body, F.lit(r"(?=\p{Lu})(?<![\p{L}\p{N}_])\p{Lu}"))  # looks back from capitals only
    return df.withColumns({
        "length": length.cast("bigint"),
        "template": reduce(lambda x, y: x | y, [F.contains(F.lower(body), F.lit(m)) for m in MARKS]),
        "names": F.least(F.lit(1.0), capital / F.greatest(length, F.lit(1))),
        "punctuation": F.regexp_count(body, F.lit(PUNCTUATION)) / F.greatest(F.length(body), F.lit(1)),
    })


def label_word(df: DataFrame, pool: str, text: str, label: str) -> DataFrame:
    """Adds whether a text holds any label of its pool's rows, in any case, anywhere; empty labels are none."""
    labels = df.filter(F.col(label).isNotNull() & (F.col(label) != "")).groupBy(pool).agg(F.collect_set(F.lower(label)).alias("_labels"))  # as many as classes
    rows = df.join(labels, pool, "left").withColumn("_low", F.lower(text))
    # the lower-case text is used twice, else the optimizer moves it into the lambda, where it is made for every label
    held = F.when(F.col("_low").isNotNull(), F.exists("_labels", lambda x: F.contains(F.col("_low"), x)))
    return rows.withColumn("label_word", F.coalesce(held, F.lit(False))).drop("_labels", "_low")


def artifact_features(df: DataFrame, pool: str, text: str, label: str) -> DataFrame:
    """Adds length (words), label_word, template, names (share of words that begin with a capital) and punctuation (share of characters).

    A label word is any label of the pool's rows, in any case, anywhere in the text; empty labels are none. Null texts count as empty.
    """
    return form_features(label_word(df, pool, text, label), text)


def shortcut_score(features: DataFrame, pool: str) -> DataFrame:
    """Adds ``h``: the weighted features, the length by its distance from the pool's mean in its spread (at least 1), up to three of them."""
    spread = features.groupBy(pool).agg(F.avg("length").alias("_m"), F.greatest(F.stddev_pop("length"), F.lit(1.0)).alias("_sd"))
    z = F.least(F.lit(1.0), F.abs(F.col("length") - F.col("_m")) / F.col("_sd") / 3)
    parts = {"label_word": F.col("label_word").cast("int"), "template": F.col("template").cast("int"), "length": z, "names": F.col("names"), "punctuation": F.least(F.lit(1.0), 10 * F.col("punctuation"))}
    h = sum((w * parts[k] for k, w in WEIGHTS.items()), F.lit(0.0))
    return features.join(spread, pool).withColumn("h", F.greatest(F.lit(0.0), F.least(F.lit(1.0), h))).drop("_m", "_sd")
