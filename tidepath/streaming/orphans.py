"""Orphan references over streams: each micro-batch advances the stored state by what arrived."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidepath.operators import orphans


def watch(events: DataFrame, folder: str, checkpoint: str, on_snapshot: Callable[[int, DataFrame], None] | None = None, every: int = 1, **trigger) -> StreamingQuery:
    """Starts a query over a stream of changes: kind (`reference`, `parent` or `deletion`), table_name, field, key,
    date (of a reference), row_id (optional), since, until. State versions are written below `folder`, one per batch; a batch
    reads and rewrites the key buckets it touches and leaves the others where they are, and versions no longer pointed to
    are removed. A batch that is run again after a failure starts from the version before it, so it counts once. `on_snapshot`
    gets the counts of every n-th batch."""
    spark = events.sparkSession

    def advance(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            touched = [r[0] for r in batch.where("key is not null").select(orphans.bucket()).distinct().collect()]  # BUCKETS at most
            state = orphans.load(spark, folder, number - 1, touched) if number > 0 else orphans.empty_state(spark)
            of = lambda kind: batch.where(F.col("kind") == kind)
            state = orphans.advance(state, of("reference"), of("parent").select("field", "key", "since", "until"), of("deletion").select("field", "key", "until"))
            orphans.save(state, folder, number, touched)
        finally:
            batch.unpersist()
        if on_snapshot is not None and number % every == 0:
            on_snapshot(number, orphans.snapshot(orphans.load(spark, folder, number)))

    return events.writeStream.foreachBatch(advance).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
