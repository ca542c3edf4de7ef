"""Audits of arriving candidates; beyond the reference, which only resumes batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from siftline.operators.generation import pending


def run_increments(stream: DataFrame, key: str, target: str, checkpoint: str, work: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Every arriving key once through ``work`` and on to the table ``target``; a replayed batch adds nothing twice.

    ``work`` maps a batch to rows that keep ``key``. Ends when all that is there is done.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        rows = df.dropDuplicates([key])
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            rows = pending(rows, spark.read.parquet(target), key)  # of the target only the key column is read
        work(rows).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
