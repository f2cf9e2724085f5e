"""Structured Streaming into a store, and live views of a stream of operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.store import Store


def ingest(ops: DataFrame, store: Store, checkpoint: str, order_by: str, name: str, available_now: bool = False) -> StreamingQuery:
    """Each micro-batch becomes a run. A batch that comes again after a crash is known by its number and skipped, so each takes effect once.

    The batch size is the source's (maxFilesPerTrigger and the like); name must be the same whenever the query starts again.
    """

    def commit(batch: DataFrame, batch_id: int) -> None:
        store.write(batch, order_by=order_by, stream=(name, batch_id))

    writer = ops.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(commit)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def live_view(ops: DataFrame) -> DataFrame:
    """A streaming latest-wins table: state is one row per key, in the state store. Deleted keys stay as tombstones in it."""
    newest = ops.groupBy("key").agg(F.max_by(F.struct("value", "is_delete"), "seq").alias("winner"))
    return newest.select("key", F.col("winner.value").alias("value"), F.col("winner.is_delete").alias("is_delete"))
