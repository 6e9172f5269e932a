"""Streams into sealed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sealtable.database import Database
from sealtable.functions.canonical import row_hash
from sealtable.types import HASH


def seal_stream(stream: DataFrame) -> DataFrame:
    """A stream's rows with their hashes; no state."""
    return stream.withColumn(HASH, row_hash(stream.schema))


def duplicate_stream(stream: DataFrame, time_col: str, delay: str) -> DataFrame:
    """The first row of each hash; later equal rows within ``delay`` are dropped, and the state for them with it."""
    return seal_stream(stream).withWatermark(time_col, delay).dropDuplicatesWithinWatermark([HASH])


def append_stream(db: Database, table: str, stream: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append every micro-batch in one commit, exactly once.

    The number of the last batch is committed with its rows, so a batch that is
    run again after a failure is known and passed over.
    """
    source = f"{table}@{checkpoint}"

    def write(batch: DataFrame, number: int) -> None:
        done = db.catalog.state.get("streams", {}).get(source, -1)
        if number <= done or batch.isEmpty():
            return
        state = db.catalog.draft()
        entry = db.catalog.table(table, state)
        schema = db.catalog.schema(entry)
        db.stage_frame(state, table, batch.select(*[F.col(f"`{c}`").cast(schema[c].dataType) for c in entry["columns"]]))
        state.setdefault("streams", {})[source] = number
        db.catalog.commit(state)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
