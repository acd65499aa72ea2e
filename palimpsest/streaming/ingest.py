"""Structured Streaming around the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from palimpsest.plans.backup import backup
from palimpsest.store import Store


def ingest(store: Store, files: DataFrame, checkpoint: str, **options) -> StreamingQuery:
    """Each micro-batch is one revision: the complete tree of its files.

    The batch id is kept with the revision, so that a batch that is run again after a failure is not saved twice.
    """
    path = f"{store.path}/batches"

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            done = not spark.read.schema("batch bigint").parquet(path).where(F.col("batch") == number).isEmpty()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            done = False
        if done:
            return
        backup(store, batch, **options)
        spark.range(1).select(F.lit(number).cast("bigint").alias("batch")).write.mode("append").parquet(path)

    return files.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_contents(files: DataFrame, key: str = "sha1", time: str | None = None, within: str = "1 day") -> DataFrame:
    """The first row of each content of a stream.

    Without `time` a content once seen is never forgotten, and the state grows with the number of contents. With a time
    column, contents are the same if they come `within` of each other; the state holds no more than that, and what a store
    already has is told by `palimpsest.operators.dedup.unknown` when the batch is saved.
    """
    if time is None:
        return files.dropDuplicates([key])
    return files.withWatermark(time, within).dropDuplicatesWithinWatermark([key])
