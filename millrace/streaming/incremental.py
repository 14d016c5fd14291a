"""Incremental loads from a stream: each micro-batch is one keyed upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from millrace.model import ImportOptions
from millrace.plans.loads import Loader
from millrace.plans.store import TableStore
from millrace.sources.tables import FrameSource

LAST_BATCH = "millrace.stream."


def load_stream(stream: DataFrame, loader: Loader, table: str, options: ImportOptions, checkpoint: str, name: str = "load", available_now: bool = True) -> StreamingQuery:
    """Load every micro-batch. A batch that was committed before a restart is skipped by its number."""
    store, key = loader.store, LAST_BATCH + name

    def one(batch: DataFrame, number: int) -> None:
        if number <= int(store.properties(table).get(key, "-1")):
            return
        # A batch lives in the stream's own session; all of its load runs there, so that its row counts are seen.
        own = TableStore(batch.sparkSession, store.root, store.schema)
        Loader(own).load(FrameSource(batch), table, options)
        store.spark.sql(f"ALTER TABLE {store.name(table)} SET TBLPROPERTIES ('{key}' = '{number}')")

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
