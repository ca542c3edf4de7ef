"""Leakage of held-out texts into candidates: shared n-grams, set overlap, and the score of both."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import token_ngrams, tokens


def _grams(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """``key, _grams``: the distinct n-grams of every text."""
    return df.select(key, tokens(F.col(text)).alias("_t")).select(key, token_ngrams(F.col("_t"), n).alias("_grams"))


def exact_ngram(df: DataFrame, record: str, text: str, heldout: DataFrame, heldout_text: str, n: int = 10) -> DataFrame:
    """``record`` of the rows that share an n-gram with a held-out text.

    A semi join on grams; grams are exploded on their way into the join, and adaptive execution
    splits frequent ones. Null texts share nothing.
    """
    theirs = _grams(heldout.withColumn("_i", F.lit(0)), "_i", heldout_text, n).select(F.explode("_grams").alias("gram")).distinct()
    return _grams(df, record, text, n).select(record, F.explode("_grams").alias("gram")).join(theirs, "gram", "left_semi").select(record).distinct()


def max_jaccard(df: DataFrame, record: str, text: str, heldout: DataFrame, item: str, heldout_text: str, n: int = 5) -> DataFrame:
    """``record, jaccard``: the largest overlap of n-gram sets by their union with any held-out text, where any gram is shared.

    Grams are reduced to those of held-out texts before they are counted, so the pairs shuffled
    are at most one per gram that a record really shares with an item.
    """
    sets = _grams(df, record, text, n).select(record, F.size("_grams").alias("a"), F.explode("_grams").alias("gram"))
    theirs = _grams(heldout.withColumnRenamed(item, "_item"), "_item", heldout_text, n)
    probe = theirs.select("_item", F.size("_grams").alias("b"), F.explode("_grams").alias("gram"))
    shared = sets.join(probe, "gram").groupBy(record, "_item").agg(F.count(F.lit(1)).alias("n"), F.first("a").alias("a"), F.first("b").alias("b"))
    pairs = shared.withColumn("jaccard", F.col("n") / (F.col("a") + F.col("b") - F.col("n")))
    return pairs.groupBy(record).agg(F.max("jaccard").alias("jaccard"))


def leakage(df: DataFrame, record: str, text: str, heldout: DataFrame, item: str, heldout_text: str, ngram_n: int = 10, shingle_n: int = 5) -> DataFrame:
    """``record, exact, jaccard, l``: the leakage score of every row, 1 where an n-gram is shared."""
    e = exact_ngram(df, record, text, heldout, heldout_text, ngram_n).withColumn("exact", F.lit(1.0))
    j = max_jaccard(df, record, text, heldout, item, heldout_text, shingle_n)
    out = df.select(record).distinct().join(e, record, "left").join(j, record, "left")
    both = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("exact", "jaccard")]
    return out.select(record, *both).withColumn("l", F.greatest("exact", "jaccard"))


class HeldGrams:
    """What ``leakage`` finds, over batches of token lists at the workers: for a curated held-out side that goes there whole.

    Held-out n-grams are a tree: a node is a gram, an edge the next token, and each level has its edges as sorted numbers. All
    windows of a batch go down together; those that leave the tree are dropped, most of them at its second level.
    """

    def __init__(self, items: list[list[str]], ngram_n: int, shingle_n: int):
        import numpy as np

        self.ngram_n, self.shingle_n = ngram_n, shingle_n
        flat = [t for x in items for t in x]
        words = sorted(set(flat))
        number = {w: i for i, w in enumerate(words)}
        self.words = pa.array(words, pa.string())
        many = np.array([len(x) for x in items], np.int64)
        word = np.array([number[t] for t in flat], np.int64)
        item, left = np.repeat(np.arange(len(items)), many), np.repeat(many.cumsum(), many) - np.arange(len(flat))
        at, node = np.arange(len(flat)), word
        self.edges = []
        for n in range(1, max(ngram_n, shingle_n) + 1):
            if n > 1:
                longer = left[at] >= n
                at, edge = at[longer], node[longer] * len(words) + word[at[longer] + n - 1]
                known, node = np.unique(edge, return_inverse=True)
                self.edges.append(known)
            if n == shingle_n:
                pair = np.unique(node * max(len(items), 1) + item[at])
                gram, self.holder = pair // max(len(items), 1), pair % max(len(items), 1)
                self.starts = np.searchsorted(gram, np.arange((gram[-1] + 1 if len(gram) else 0) + 1))
                self.sizes = np.bincount(self.holder, minlength=len(items))

    def scores(self, batch: pa.ListArray):
        """``exact`` and ``jaccard`` of every token list, as in ``leakage``."""
        import numpy as np

        exact, jaccard = np.zeros(len(batch)), np.zeros(len(batch))
        many = np.diff(batch.offsets.to_numpy())
        word = pc.fill_null(pc.index_in(batch.flatten(), self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        row, left = np.repeat(np.arange(len(batch)), many), np.repeat(many.cumsum(), many) - np.arange(len(word))
        at = np.flatnonzero(word >= 0)
        node = word[at]
        for n in range(1, max(self.ngram_n, self.shingle_n) + 1):
            if n > 1:
                known, longer = self.edges[n - 2], left[at] >= n
                at, node = at[longer], node[longer]
                follows = word[at + n - 1] >= 0
                at, node = at[follows], node[follows]
                edge = node * len(self.words) + word[at + n - 1]
                node = np.searchsorted(known, edge)
                there = node < len(known)
                there[there] = known[node[there]] == edge[there]
                at, node = at[there], node[there]
            if n == self.ngram_n:
                exact[row[at]] = 1.0
            if n == self.shingle_n and len(at):
                here, gram = np.divmod(np.unique(row[at] * len(self.starts) + node), len(self.starts))  # each gram of a text once
                held = self.starts[gram + 1] - self.starts[gram]
                place = np.repeat(self.starts[gram] - (held.cumsum() - held), held) + np.arange(held.sum())
                pair, shared = np.unique(np.repeat(here, held) * len(self.sizes) + self.holder[place], return_counts=True)
                of, item = pair // len(self.sizes), pair % len(self.sizes)
                own = self._own_grams(batch.flatten(), row, left, np.unique(of), len(batch))
                np.maximum.at(jaccard, of, shared / (own[of] + self.sizes[item] - shared))
        return exact, jaccard

    def _own_grams(self, flat: pa.Array, row, left, of, rows: int):
        """How many different grams each row among ``of`` has, by numbers of the batch's own tokens; numbers are packed as long as they fit."""
        import numpy as np

        wanted = np.zeros(rows, bool)
        wanted[of] = True
        at = np.flatnonzero(wanted[row] & (left >= self.shingle_n))
        number = pc.dictionary_encode(flat).indices.to_numpy().astype(np.int64)
        bits, width = int(number.max()).bit_length(), int(number.max()).bit_length()
        gram = number[at]
        for j in range(1, self.shingle_n):
            if width + bits > 63:
                gram = np.unique(gram, return_inverse=True)[1]
                width = len(at).bit_length()
            gram, width = gram << bits | number[at + j], width + bits
        gram = np.unique(gram, return_inverse=True)[1]
        return np.bincount(np.unique(row[at] * (len(at) + 1) + gram) // (len(at) + 1), minlength=rows)
