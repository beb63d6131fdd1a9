"""Starting streams: over everything there is, or again and again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def start(df: DataFrame, checkpoint: str, mode: str, handle: Callable[[DataFrame, int], None],
          every: str | None = None) -> StreamingQuery:
    """Hand each batch with its number to ``handle``.

    Without ``every`` the stream ends once all input that is there has been read; with it (like ``"5 seconds"``)
    it looks for new input at that interval until it is stopped. A batch that failed comes again under its number.
    """
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return df.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**trigger).start()
