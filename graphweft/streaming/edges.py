"""Relationships that arrive as events: windowed counts, and growing graphs.

These are extensions over batch graphs; state is bounded by the watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def windowed_edges(events: DataFrame, src: str, dst: str, time: str, size: str = "5 minutes", slide: str | None = None, late: str = "10 minutes", value: str | None = None) -> DataFrame:
    """start, end, src, dst, n, total: relationships between two keys in tumbling or sliding windows.

    Works on streams and tables. On a stream a window is final `late` after its end; later events are dropped, and with
    them the window's state.
    """
    window = F.window(time, size, slide) if slide else F.window(time, size)
    total: Column = F.sum(value) if value else F.count(F.lit(1)).cast("double")
    marked = events.withWatermark(time, late) if events.isStreaming else events
    counted = marked.groupBy(window.alias("w"), F.col(src).alias("src"), F.col(dst).alias("dst")).agg(F.count(F.lit(1)).alias("n"), total.alias("total"))
    return counted.select("w.start", "w.end", "src", "dst", "n", "total")


def sessions(events: DataFrame, key: str, time: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """start, end, key, n: runs of events of a key without a gap."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    counted = marked.groupBy(F.session_window(time, gap).alias("w"), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("w.start", "w.end", "key", "n")


def append_to(edges: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """A writer that hands each finished batch to `write(frame, batch number)`; start() it. The batch number lets a sink
    that has seen it skip a repeat, so that each window is written once."""
    return edges.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
