"""Structured Streaming variants: windows of late data, and the upsert as a batch-by-batch sink."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemark.operators.upsert import incremental_merge
from tidemark.sources.store import TableStore


def upsert_sink(stream: DataFrame, store: TableStore, table: str, keys: Sequence[str], watermark: str, days: int, checkpoint: str, partition_by: str | None = None) -> DataStreamWriter:
    """Each micro-batch is merged like a batch load; running one twice changes nothing."""

    def merge(batch: DataFrame, _: int) -> None:
        incremental_merge(store, batch, table, keys, watermark, days, partition_by)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def daily_counts(stream: DataFrame, ts: str, by: str, value: str, lateness: str = "7 days") -> DataFrame:
    """Counts and sums by day; state older than the lateness is dropped."""
    windowed = stream.withWatermark(ts, lateness).groupBy(F.window(ts, "1 day"), by)
    return windowed.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("day_start"), by, "n", "total")


def run_available(writer: DataStreamWriter, prepare: Callable[[DataStreamWriter], DataStreamWriter] = lambda w: w) -> None:
    """Takes what is there and ends."""
    query = prepare(writer).trigger(availableNow=True).start()
    query.awaitTermination()
