"""Running sums of cells that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_sums(cells: DataFrame, ts: str, keys: list[str], window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window_start, keys, val, n): the sum and number of values of each key in each window of time.

    cells is a stream or a table with a `val` column. On a stream, state older than the watermark is dropped,
    and what comes later than that is left out; a table has no late rows.
    """
    own = cells.withWatermark(ts, late) if cells.isStreaming else cells
    sums = own.groupBy(F.window(ts, window).alias("_w"), *keys).agg(F.sum("val").alias("val"), F.count("*").alias("n"))
    return sums.select(F.col("_w.start").alias("window_start"), *keys, "val", "n")
