"""Text embedders: hashed character n-grams, and a registry for others."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EMBEDDERS: dict[str, Callable[..., Callable[[Column], Column]]] = {}


def register(name: str):
    """Adds an embedder: a function of its parameters that gives a function of a text column."""

    def keep(f):
        EMBEDDERS[name] = f
        return f

    return keep


def embedder(name: str, **parameters) -> Callable[[Column], Column]:
    if name not in EMBEDDERS:
        raise ValueError(f"unknown embedder {name}; known are {sorted(EMBEDDERS)}")
    return EMBEDDERS[name](**parameters)


# Lengths of the grams, the blanks around a text, and bytes of a gram's hash, read as a little-endian number.
GRAMS, PAD, DIGEST = (3, 4, 5), "  ", 8


def gram_counts(texts: list[str | None], dim: int, lengths: tuple[int, ...], slot_and_sign):
    """A row per text with the signed counts of its lower-case character grams by slot.

    ``slot_and_sign`` gets the distinct grams of all texts once; the counts are added up by numpy.
    """
    import numpy as np

    known: dict[str, int] = {}
    grams: list[int] = []
    many = []
    for t in texts:
        s = f"{PAD}{(t or '').lower()}{PAD}"
        mine = [known.setdefault(s[i : i + n], len(known)) for n in lengths for i in range(len(s) - n + 1)]
        grams += mine
        many.append(len(mine))
    slot, sign = slot_and_sign(list(known))
    gram = np.array(grams, np.int64)
    cell = np.repeat(np.arange(len(texts)), many) * dim + slot[gram]
    return np.bincount(cell, weights=sign[gram], minlength=len(texts) * dim).reshape(len(texts), dim)


#: Places in a worker's table of grams it has met, a power of two, and texts that are counted at a time.
PLACES, CHUNK = 1 << 22, 512
_MET: dict[int, tuple] = {}


def _slots(grams: list[str], dim: int):
    """The BLAKE2b number of each gram: its remainder by ``dim``, and beyond ``dim`` where its highest bit is set."""
    import numpy as np

    number = np.frombuffer(b"".join(hashlib.blake2b(g.encode("utf-8", "surrogatepass"), digest_size=DIGEST).digest() for g in grams), "<u8")
    return ((number % np.uint64(dim)) + np.uint64(dim) * (number >> np.uint64(63))).astype(np.int32)


def _hashed_counts(texts: list[str | None], dim: int):
    """Signed counts of some texts' grams.

    A gram is two numbers, its first three characters and the rest with its length, and has one place in the table, where both must
    agree; what isn't there is hashed once for these texts and takes its place. So the table's size bounds memory, not what is counted.
    """
    import numpy as np

    if dim not in _MET:
        _MET.clear()
        _MET[dim] = np.zeros(PLACES, np.uint64), np.zeros(PLACES, np.uint64), np.zeros(PLACES, np.int32)
    head_at, rest_at, slot_at = _MET[dim]
    padded = [f"{PAD}{(t or '').lower()}{PAD}" for t in texts]
    joined = "".join(padded)
    many = np.fromiter(map(len, padded), np.int64, len(padded))
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    left = np.repeat(many.cumsum(), many) - np.arange(len(c))
    first = np.repeat(np.arange(len(texts)) * (2 * dim), many)
    u, bits = np.uint64, np.uint64(21)
    head = c[:-2] | c[1:-1] << bits | c[2:] << (bits + bits)
    cells = []
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        a, b = head[at], np.full(len(at), n << 42, u)
        for j in range(3, n):
            b |= c[at + j] << u(21 * (j - 3))
        place = ((a * u(0x9E3779B97F4A7C15)) ^ (b * u(0xC2B2AE3D27D4EB4F))) >> u(65 - PLACES.bit_length())
        slot = slot_at[place]
        new = np.flatnonzero((head_at[place] != a) | (rest_at[place] != b))
        if len(new):
            order = new[np.lexsort((a[new], b[new]))]
            x, y = a[order], b[order]
            start = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
            one = order[start]
            found = _slots([joined[i : i + n] for i in at[one].tolist()], dim)
            slot[order] = found[start.cumsum() - 1]
            head_at[place[one]], rest_at[place[one]], slot_at[place[one]] = a[one], b[one], found
        cells.append(first[at] + slot)
    counts = np.bincount(np.concatenate(cells), minlength=len(texts) * 2 * dim).reshape(len(texts), 2, dim)
    return (counts[:, 1] - counts[:, 0]).astype(np.float64)


def hashed(texts: list[str | None], dim: int):
    """Counts of 3- to 5-grams by their BLAKE2b number, at length one: at its remainder by ``dim``, upwards where its highest bit is set."""
    import numpy as np

    out = np.zeros((len(texts), dim))
    for i in range(0, len(texts), CHUNK):
        out[i : i + CHUNK] = _hashed_counts(texts[i : i + CHUNK], dim)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(size > 0, size, 1.0)


@register("hash")
def hash_embedder(dim: int = 768) -> Callable[[Column], Column]:
    @F.pandas_udf("array<float>")
    def embed(text: pd.Series) -> pd.Series:
        return pd.Series(list(hashed(text.tolist(), dim).astype("float32")), index=text.index)

    embed.rows = lambda texts: hashed(texts, dim).astype("float32")  # the same, where texts are met in a pass of their own
    return embed


@register("hash-md5")
def md5_embedder(dim: int = 64) -> Callable[[Column], Column]:
    """Counts of character trigrams by the first 8 hex digits of their md5, which SQL can state too."""

    def place(grams: list[str]):
        import numpy as np

        return np.array([int(hashlib.md5(g.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) % dim for g in grams], np.int64), np.ones(len(grams))

    @F.pandas_udf("array<double>")
    def embed(text: pd.Series) -> pd.Series:
        return pd.Series(list(gram_counts(text.tolist(), dim, (3,), place)), index=text.index)

    return embed


@register("sentence-transformer")
def sentence_embedder(model: str = "sentence-transformers/LaBSE", batch: int = 32) -> Callable[[Column], Column]:
    """A sentence-transformers model, loaded once for each Python worker; needs that package and its weights."""

    @F.pandas_udf("array<float>")
    def embed(text: pd.Series) -> pd.Series:
        from sentence_transformers import SentenceTransformer

        kept = globals().setdefault("_MODELS", {})
        if model not in kept:
            kept[model] = SentenceTransformer(model)
        return pd.Series(kept[model].encode(text.fillna("").tolist(), batch_size=batch, normalize_embeddings=True).tolist())

    return embed
