"""Merging streamed changes into a table in buckets: a micro-batch reads and writes the buckets of its keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from allelegate.sources.buckets import BucketTable

Merge = Callable[[DataFrame, DataFrame], DataFrame]

#: Versions that stay, so that a reader of the last ones is not disturbed.
KEEP = 3


def apply_batch(batch: DataFrame, merge: Merge, table: BucketTable, version: str, keep: int = KEEP) -> list[int]:
    """`merge(stored, batch)` on the buckets of the batch's keys, as one version; the buckets it touched.

    `stored` holds these buckets only, and `merge` must leave each row in the bucket of its key.  The version is
    built on the one before it, so a batch that runs again writes the same version from the same state.
    """
    batch = batch.persist()
    try:
        touched = table.touched(batch)
        table.write(merge(table.read(touched, before=version), batch), version, touched)
    finally:
        batch.unpersist()
    table.expire(keep)
    return touched


def apply_stream(changes: DataFrame, merge: Merge, table: BucketTable, checkpoint: str, keep: int = KEEP, **trigger) -> StreamingQuery:
    """`apply_batch` for each micro-batch; its number names the version.

    What is read and written follows the keys of the batch, not the table.
    """
    return (
        changes.writeStream.foreachBatch(lambda batch, number: apply_batch(batch, merge, table, f"{number:010d}", keep) and None)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
