"""Problem 7: encoding a corpus with a public byte-level tokenizer."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from siftline.llm.tables import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pattern by which this vocabulary's texts are cut before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = (1 << 62) - 1


def merge_ids(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece by byte-pair merging.

    A segment tree over the byte positions holds, in each leaf, the rank of the pair that starts
    there and its position as one number, so that the root is the leftmost pair of least rank.
    A merge changes two leaves and empties one, at logarithmic cost each, so a piece of n bytes takes O(n log n).
    """
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    width = 1 << (n - 2).bit_length()  # leaves for the n - 1 pairs
    tree = [NONE] * (2 * width)
    get = ranks.get
    at = width
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[at] = r << 32 | i
        at += 1
    for i in range(width - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    end = list(range(1, n + 1))  # of the part that starts here
    before = list(range(-1, n))  # start of the part before the one that starts here
    top = tree[1]
    while top != NONE:
        i = top & 0xFFFFFFFF
        j = end[i]
        end[i] = k = end[j]  # the parts i..j and j..k become one
        value = NONE
        if k < n:
            before[k] = i
            r = get(piece[i : end[k]])
            if r is not None:
                value = r << 32 | i
        at = width + i
        tree[at] = value
        while at > 1:
            other = tree[at ^ 1]
            if other < value:
                value = other
            at >>= 1
            tree[at] = value
        at = width + j
        if k < n and tree[at] != NONE:
            value = tree[at] = NONE
            while at > 1:
                other = tree[at ^ 1]
                if other < value:
                    value = other
                at >>= 1
                tree[at] = value
        h = before[i]
        if h >= 0:
            r = get(piece[h:k])
            value = NONE if r is None else r << 32 | h
            at = width + h
            if tree[at] != value:
                tree[at] = value
                while at > 1:
                    other = tree[at ^ 1]
                    if other < value:
                        value = other
                    at >>= 1
                    tree[at] = value
        top = tree[1]
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Pieces(dict):
    """Ids of the pieces seen so far; forgets them all at ``limit`` entries, which only costs time."""

    def __init__(self, ranks: dict[bytes, int], limit: int = 200_000) -> None:
        super().__init__()
        self.ranks, self.limit = ranks, limit

    def __missing__(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        ids = [whole] if whole is not None else merge_ids(raw, self.ranks)
        if len(raw) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = ids
        return ids


#: Ids of pieces by vocabulary, kept as long as the Python worker lives.
_KEPT: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _KEPT:
        _KEPT[path] = Pieces(load_ranks(path))
    return _KEPT[path]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def encode_corpus(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key, ids``: the token ids of each text, without special tokens.

    Null and empty texts give an empty list; blank texts are encoded as they are. Texts are encoded whole, in one
    pass without a shuffle; a worker keeps the ids of pieces it has met. ``vocabulary`` is a
    path that every executor can read. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        look, cut = pieces_of(vocabulary).__getitem__, regex.compile(PATTERN).findall
        for batch in batches:
            ids, ends = array("i"), array("i", [0])
            for x in batch.column(1).to_pylist():
                if x:
                    ids.extend(chain.from_iterable(map(look, cut(x))))
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(memoryview(ends), pa.int32()), pa.array(memoryview(ids), pa.int32()) if len(ids) else pa.array([], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["_key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"_key {kind}, ids array<int>").withColumnRenamed("_key", key)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document by byte_bpe_50k."""
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"p7_ids": p7_ids}
SQL: dict[str, str] = {}
