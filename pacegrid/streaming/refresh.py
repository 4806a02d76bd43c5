"""Streams of events into a table that keeps the newest version of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pacegrid.operators.relational import first_per_key


def newest(versions: DataFrame) -> DataFrame:
    """The row of the latest ``scraped_at`` for each id."""
    return first_per_key(versions, ["id"], [F.desc("scraped_at"), F.asc("source_url")])


def refresh(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch, deduplicated, to the Parquet table at ``path``, which newest() reads.
    A batch that is run again after a failure replaces its own folder, so nothing counts twice."""

    def store(batch: DataFrame, number: int) -> None:
        newest(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
