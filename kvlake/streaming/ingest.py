"""Streams of mutations into a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kvlake.sources.store import Store


def ingest(stream: DataFrame, store: Store, checkpoint: str, order: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Append each micro-batch of mutations (key; optional value, op, expiry_ms) to ``store`` as one version.

    ``order`` orders mutations of the same key within a micro-batch; later micro-batches are newer. The store's manifest
    holds the last micro-batch of each stream (by the query's id, which its checkpoint keeps), so one that is run again
    after a failure is passed over, whatever has been written since.
    """

    def append(batch: DataFrame, number: int) -> None:
        name = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        if not batch.isEmpty():
            store.append(batch, order, stream=(name, number))

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
