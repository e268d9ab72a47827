"""Streaming ingest into the batch sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from priorline.sources.sinks import append_log, insert_if_absent


def dedupe_stream(stream: DataFrame, keys: Sequence[str], event_time: str, delay: str) -> DataFrame:
    """Drop repeats that arrive within ``delay`` with bounded state.

    Repeats that arrive later are left to the sink.  Rows behind the watermark are dropped by the
    engine, so callers that must keep every late row skip this step and rely on the sink alone.
    """
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def start(
    stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True, every: str = "1 minute"
) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start()


def insert_stream(
    stream: DataFrame, path: str, keys: Sequence[str], ordering: Sequence[Column], checkpoint: str, partition: str | None = None, **trigger
) -> StreamingQuery:
    """Every micro-batch inserts its absent rows; a replayed batch changes nothing."""
    return start(stream, lambda batch, _: insert_if_absent(batch, path, keys, ordering, partition), checkpoint, **trigger)


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Every micro-batch is appended under its number; the latest view of the log is the table.

    A replayed batch carries the same number and the same rows, so the view does not change.
    """
    return start(stream, lambda batch, number: append_log(batch, path, number), checkpoint, **trigger)
