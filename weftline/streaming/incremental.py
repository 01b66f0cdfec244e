"""Arriving source documents: each micro-batch runs the batch functions against one list of targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from ..plans import linking
from ..sources.store import Store


def link_stream(sources: DataFrame, store: Store, targets: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Compares a stream of (url, title, body) with targets and keeps edges and status in store.

    Merges are by key, so a batch that is run again after a failure leaves the same rows: exactly once in effect.
    """

    def one(batch: DataFrame, _: int) -> None:
        linking.run(store, batch.dropDuplicates(["url"]), targets)

    writer = sources.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
