"""Structured Streaming forms: frames over growing tables, tumbling windows with watermarks, per-key state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.core import CompileError
from ..operators.frame import Frame


def start(frame: Frame, name: str, path: str | None = None, checkpoint: str | None = None, once: bool = True) -> StreamingQuery:
    """Starts a frame's query: into a memory table, or appended as Parquet. ``once`` ends it when all present files are read."""
    if not frame._streaming:
        raise CompileError("the frame isn't a stream; call stream() or read one")
    writer = frame.spark().writeStream.queryName(name).outputMode("append")
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.format("parquet").option("path", path).start() if path else writer.format("memory").start()


def windowed(rows: DataFrame, time_col: str, size: str, by: list[str], aggs: list, watermark: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Extension: aggregates of event-time windows (tumbling, or sliding by ``slide``) with a watermark for late rows."""
    late = rows.withWatermark(time_col, watermark) if rows.isStreaming else rows
    span = F.window(time_col, size, slide) if slide else F.window(time_col, size)
    return late.groupBy(span.alias("window"), *by).agg(*aggs).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, *[a._jc.toString().rsplit(" AS ", 1)[-1].strip("`") for a in aggs])


def sessions(rows: DataFrame, time_col: str, gap: str, by: list[str], watermark: str = "10 minutes") -> DataFrame:
    """Extension: sessions of rows that are at most a gap apart: start, end and number of rows."""
    late = rows.withWatermark(time_col, watermark) if rows.isStreaming else rows
    found = late.groupBy(*by, F.session_window(time_col, gap).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return found.select(*by, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def with_state(rows: DataFrame, by: list[str], update: Callable[[tuple, Iterator[pd.DataFrame], object], Iterator[pd.DataFrame]], output: str, state: str) -> DataFrame:
    """Extension: any per-key state, kept by Spark and updated from each batch's rows of the key."""
    return rows.groupBy(*by).applyInPandasWithState(update, output, state, "append", "NoTimeout")
