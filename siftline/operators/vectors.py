"""Centroid classifiers and nearest neighbours over embedding columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from siftline.operators.staging import written

#: Queries that are sent to the workers at a time.
BLOCK_QUERIES = 4096
#: Labels up to which centroids are put into the plan.
MOST_LABELS = 10_000


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """``label, position, value`` of the mean vector of each label, at length one; null labels and vectors are left out."""
    mean = df.filter(F.col(label).isNotNull()).select(label, F.posexplode(vector).alias("position", "_v")).groupBy(label, "position").agg(F.avg(F.col("_v").cast("double")).alias("_m"))
    size = F.sqrt(F.sum(F.col("_m") * F.col("_m")).over(Window.partitionBy(label)))
    return mean.select(label, "position", (F.col("_m") / F.greatest(size, F.lit(1e-12))).alias("value"))


def class_probabilities(df: DataFrame, record: str, vector: str, centres: DataFrame, label: str, temperature: float = 0.25) -> DataFrame:
    """``record, class, p``: softmax of the cosines to the centroids over the temperature, at least 1e-12.

    Centroids, one vector a label, are small; beyond MOST_LABELS labels this refuses. A row's cosines to all of them are one array of
    its own Arrow batch, so nothing is shuffled and no centroid is part of the plan.
    """
    import numpy as np

    rows = centres.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("position", "value"))).alias("c")).orderBy(label).limit(MOST_LABELS + 1).collect()
    if len(rows) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    kind, record_kind = centres.schema[label].dataType.simpleString(), df.schema[record].dataType.simpleString()
    labels, label_type = [r[0] for r in rows], to_arrow_type(centres.schema[label].dataType)
    m = np.array([[x.value for x in r.c] for r in rows], dtype=np.float64)
    m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) if len(rows) else m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if labels else ():
            x = np.array(batch.column(1).to_pylist(), dtype=np.float64)
            if not len(x):
                continue
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            c = x @ m.T
            e = np.exp((c - c.max(1, keepdims=True)) / temperature)
            p = np.maximum(e / e.sum(1, keepdims=True), 1e-12)
            at = np.repeat(np.arange(len(x)), len(labels))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(labels * len(x), label_type), pa.array(p.ravel())], ["_record", "class", "p"])

    out = df.filter(F.col(vector).isNotNull()).select(record, vector).mapInArrow(run, f"_record {record_kind}, class {kind}, p double")
    return out.withColumnRenamed("_record", record)


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """``query, key, cosine, place``: the k most similar rows of every query, without the query itself.

    Queries go to the workers in blocks of BLOCK_QUERIES, each of which is written before the next one is fetched; every task of a
    block keeps k rows for each query from the batches it sees, and only those are shuffled. Equal cosines, to 9 digits, go by key.
    """
    import numpy as np

    q = queries.select(key, vector).na.drop()
    blocks = max(1, -(-q.count() // BLOCK_QUERIES))
    out = None
    for b in range(blocks):
        block = q.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).collect()
        ids = np.array([r[0] for r in block])
        m = np.array([r[1] for r in block], dtype=np.float64)
        m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) if len(block) else m

        def run(batches: Iterator[pa.RecordBatch], ids=ids, m=m) -> Iterator[pa.RecordBatch]:
            best_c = np.empty((len(ids), 0))
            best_k = np.empty((len(ids), 0), dtype=np.int64)
            for batch in batches:
                keep = [i for i, v in enumerate(batch.column(1).to_pylist()) if v is not None]
                if not keep or not len(ids):
                    continue
                keys = np.array(batch.column(0).to_pylist())[keep]
                x = np.array(batch.column(1).to_pylist(), dtype=object)[keep]
                x = np.array(x.tolist(), dtype=np.float64)
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                c = np.round(m @ x.T, 9)
                c[ids[:, None] == keys[None, :]] = -np.inf
                c, kk = np.hstack([best_c, c]), np.hstack([best_k, np.broadcast_to(keys, c.shape)])
                order = np.lexsort((kk, -c), axis=1)[:, :k]
                best_c, best_k = np.take_along_axis(c, order, 1), np.take_along_axis(kk, order, 1)
            n = best_c.shape[1]
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(best_k.ravel()), pa.array(best_c.ravel())], ["query", "key", "cosine"])

        one = rows.select(F.col(key).cast("bigint"), vector).mapInArrow(run, "query bigint, key bigint, cosine double").filter(F.col("cosine") > float("-inf"))
        if blocks > 1:  # k rows a query and task; the driver keeps one block at a time
            one = written(one, "near")
        out = one if out is None else out.unionByName(one)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "key"))
    return out.withColumn("place", place).filter(F.col("place") <= k)


def slack(dim: int) -> float:
    """By how much two cosines of unit vectors can change places at most, in single precision against doubles of 9 digits."""
    return 2 * ((dim + 8) * 2.0**-24 + 1e-9)


def nearest_of(x, reference, rough, k: int):
    """Cosines, to 9 digits, and places of the ``k`` most similar unit vectors of ``reference`` for every row of ``x``; ties by place.

    ``rough`` are all cosines in single precision: those that may be among the first are found by them and ordered by doubles. Where more than
    three others may be, all of the row's are doubles.
    """
    import numpy as np

    n, more = len(reference), min(k + 3, len(reference))
    best = np.argpartition(rough, n - more, axis=1)[:, n - more :]
    top = np.sort(np.take_along_axis(rough, best, 1), axis=1)
    c = np.round(np.matmul(reference[best], x[:, :, None])[:, :, 0], 9)
    order = np.lexsort((best, -c), axis=1)[:, :k]
    c, best = np.take_along_axis(c, order, 1), np.take_along_axis(best, order, 1)
    wide = np.flatnonzero(top[:, 0] >= top[:, more - k] - slack(x.shape[1])) if more < n else []
    if len(wide):
        every = np.round(x[wide] @ reference.T, 9)
        best[wide] = np.argsort(-every, axis=1, kind="stable")[:, :k]
        c[wide] = np.take_along_axis(every, best[wide], 1)
    return c, best


#: Reference vectors that are sent to the workers at a time.
BLOCK_REFERENCE = 20_000


def against_all(df: DataFrame, record: str, vectors: dict[str, list[tuple[str, DataFrame, int]]], key: str = "id", vector: str = "vector", label: str = "label") -> DataFrame:
    """``record`` and, for every named reference, the k most similar of its rows as (cosine, key, label), best first, all in one pass.

    ``vectors`` names for each vector column of ``df`` its references as (name, table, k). For curated references: all together may
    have BLOCK_REFERENCE rows, which go to the workers once; beyond that each is met by ``against_reference``, and the results are joined.
    Null vectors and empty references get an empty list.
    """
    import numpy as np

    tables = [(column, name, t.select(F.col(key).cast("string").alias("k"), F.col(vector).alias("v"), F.col(label).cast("string").alias("l")).filter(F.col("k").isNotNull() & F.col("v").isNotNull()), k) for column, refs in vectors.items() for name, t, k in refs]
    counts = {id(t): t.count() for t in {id(x): x for _, _, x, _ in tables}.values()}
    if sum(counts.values()) > BLOCK_REFERENCE:
        out = df.select(record)
        for column, name, t, k in tables:
            out = out.join(against_reference(df, record, column, t, "k", "v", "l", k).withColumnRenamed("near", name), record)
        return out
    near = pa.struct([("cosine", pa.float64()), ("key", pa.string()), ("label", pa.string())])
    columns = list(vectors)
    made = []
    for column, name, t, k in tables:
        rows = sorted(t.collect(), key=lambda r: r.k)
        m = np.array([r.v for r in rows], dtype=np.float64)
        made.append((columns.index(column) + 1, m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) if len(rows) else None, np.array([r.k for r in rows], object), np.array([r.l for r in rows], object), k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = {}
            for i in range(1, len(columns) + 1):
                values = batch.column(i).to_pylist()
                there = np.array([j for j, v in enumerate(values) if v is not None], np.int64)
                x = np.array([values[j] for j in there], dtype=np.float64)
                unit[i] = there, x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if len(there) else x
            out = [batch.column(0)]
            for i, m, keys, labels, k in made:
                there, x = unit[i]
                sizes = np.zeros(batch.num_rows, np.int64)
                flat = pa.array([], near)
                if m is not None and len(there):
                    c = np.round(x @ m.T, 9)
                    best = np.argsort(-c, axis=1, kind="stable")[:, :k]  # keys are in order, so ties go by key
                    sizes[there] = best.shape[1]
                    flat = pa.StructArray.from_arrays([pa.array(np.take_along_axis(c, best, 1).ravel()), pa.array(keys[best.ravel()], pa.string()), pa.array(labels[best.ravel()], pa.string())], fields=list(near))
                out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], sizes.cumsum()]), pa.int32()), flat))
            yield pa.RecordBatch.from_arrays(out, ["_r", *names])

    names = [name for _, name, _, _ in tables]
    kind = df.schema[record].dataType.simpleString()
    fields = ", ".join(f"{n} array<struct<cosine: double, key: string, label: string>>" for n in names)
    return df.select(record, *columns).mapInArrow(run, f"_r {kind}, {fields}").withColumnRenamed("_r", record)


def against_reference(df: DataFrame, record: str, vector: str, reference: DataFrame, reference_key: str, reference_vector: str, reference_label: str, k: int) -> DataFrame:
    """``record, near``: of every row the k most similar reference rows as (cosine, key, label), best first.

    For many rows against a curated reference. The reference goes to the workers in blocks of
    BLOCK_REFERENCE vectors; rows are read once for each block and never shuffled unless there are several
    blocks, whose k best are then merged. Null vectors get an empty list.
    """
    import numpy as np

    ref = reference.select(F.col(reference_key).cast("string").alias("k"), F.col(reference_vector).alias("v"), F.col(reference_label).cast("string").alias("l")).filter(F.col("k").isNotNull() & F.col("v").isNotNull())
    blocks = max(1, -(-ref.count() // BLOCK_REFERENCE))
    kind = df.schema[record].dataType.simpleString()
    near = pa.struct([("cosine", pa.float64()), ("key", pa.string()), ("label", pa.string())])
    out = None
    for b in range(blocks):
        block = sorted(ref.filter(F.pmod(F.xxhash64("k"), F.lit(blocks)) == b).collect(), key=lambda r: r.k)
        m = np.array([r.v for r in block], dtype=np.float64)
        m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) if len(block) else m
        keys, labels = [r.k for r in block], [r.l for r in block]

        def run(batches: Iterator[pa.RecordBatch], m=m, keys=keys, labels=labels) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors = batch.column(1).to_pylist()
                lists: list[list[dict]] = [[] for _ in vectors]
                there = [i for i, v in enumerate(vectors) if v is not None]
                if there and len(keys):
                    x = np.array([vectors[i] for i in there], dtype=np.float64)
                    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                    c = np.round(x @ m.T, 9)
                    best = np.argsort(-c, axis=1, kind="stable")[:, :k]  # keys are in order, so ties go by key
                    for i, row, cs in zip(there, best.tolist(), c):
                        lists[i] = [{"cosine": float(cs[j]), "key": keys[j], "label": labels[j]} for j in row]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(near))], ["_r", "near"])

        one = df.select(record, vector).mapInArrow(run, f"_r {kind}, near array<struct<cosine: double, key: string, label: string>>")
        if blocks > 1:
            one = written(one, "near")
        out = one if out is None else out.unionByName(one)
    if blocks > 1:
        order = lambda a, b: F.when(a["cosine"] != b["cosine"], F.signum(b["cosine"] - a["cosine"])).when(a["key"] < b["key"], -1).otherwise(1).cast("int")
        merged = F.array_sort(F.flatten(F.collect_list("near")), order)
        out = out.groupBy("_r").agg(F.slice(merged, 1, k).alias("near"))
    return out.withColumnRenamed("_r", record)
