"""Incremental writing of documents as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillon.functions.schemas import Field
from quillon.operators.tables import shred
from quillon.sources.documents import ROWS_PER_GROUP


def stream_to_parquet(stream: DataFrame, doc: str, fields: list[Field], path: str, checkpoint: str, nested: bool = False, rows_per_group: int = ROWS_PER_GROUP, available_now: bool = False, keep: list[str] | None = None) -> StreamingQuery:
    """Typed rows of a stream, appended as Parquet; the schema is fixed and each micro-batch commits whole.

    A lost executor repeats its tasks, a lost driver goes on from ``checkpoint``; no row is written twice.
    """
    writer = shred(stream, doc, fields, nested, keep).writeStream.format("parquet").outputMode("append").option("parquet.block.row.count.limit", max(1, rows_per_group))
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
