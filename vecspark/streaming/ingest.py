"""Micro-batches into a persistent index. The index tables are the state, so no state store is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vecspark.operators.index import VectorIndex


def insert_stream(stream: DataFrame, path: str, checkpoint: str, vector: str = "embedding", key: str = "vec_id", labels: str | None = None, **trigger) -> StreamingQuery:
    """Starts a query that inserts each micro-batch. Keys that are there already are replaced, so a batch that comes again does no harm."""

    def put(batch: DataFrame, _: int) -> None:
        VectorIndex(batch.sparkSession, path).insert(batch, vector, key, labels)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
