"""Streaming ingest: each micro-batch becomes one batch of partials in the store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions import intervals
from ..operators import rollup, store, validate
from ..plans.model import Registry


def ingest_batch(events: DataFrame, registry: Registry, root: str, bad_root: str, batch_id: int, now_ms: int, retention: dict[str, int] = intervals.RETENTION) -> None:
    """Validates events, writes their partials and sets the bad ones aside; a batch that runs again replaces itself.

    No watermark: partials merge whenever they come, and lateness only chooses a coarser grain."""
    checked = validate.validate(events, registry)
    store.write_batch(rollup.partials_of(validate.good(checked), registry, now_ms, retention), root, batch_id, rollup.widest(registry))
    validate.bad(checked).write.mode("overwrite").parquet(f"{bad_root.rstrip('/')}/batch_id={batch_id}")


def start(messages: DataFrame, decode: Callable[[DataFrame], DataFrame], registry: Registry, root: str, bad_root: str, checkpoint: str, now_ms: Callable[[], int], available_now: bool = False) -> StreamingQuery:
    """Starts a stream of messages; decode makes events of them. Offsets are in the checkpoint, data in the store alone, so
    a restarted query goes on where it stopped and writes a batch that was cut short once more under its number."""
    writer = messages.writeStream.option("checkpointLocation", checkpoint).queryName("ingest")
    writer = writer.foreachBatch(lambda df, n: ingest_batch(decode(df), registry, root, bad_root, n, now_ms()))
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="20 seconds")).start()


def health(query: StreamingQuery) -> dict[str, object]:
    progress = query.lastProgress or {}
    return {"active": query.isActive, "message": query.status["message"], "batch": progress.get("batchId"), "rows": progress.get("numInputRows"), "rows_per_second": progress.get("processedRowsPerSecond")}
