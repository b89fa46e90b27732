"""Streaming ingest: an extension, as the engine's index is filled batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.index import LateIndex


def index_stream(documents: DataFrame, index: LateIndex, checkpoint: str, mode: str = "replace") -> StreamingQuery:
    """Index a stream of document rows, all that is there, then stop. A batch that is run again replaces what it wrote before."""
    return documents.writeStream.foreachBatch(lambda batch, _: index.index(batch, mode)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
