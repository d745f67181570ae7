"""Counts over streams of reads, with late rows bounded by a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, time: str, keys: Sequence[str], window: str = "1 day", late: str = "3 days") -> DataFrame:
    """Rows of each window and key: ``window_start``, keys, ``n``.

    Works on streams and on tables.  In append mode a window is given out once no row
    later than ``late`` can come; rows with a null time are left out.
    """
    kept = stream.filter(F.col(time).isNotNull()).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return kept.groupBy(F.window(time, window).alias("_w"), *keys).agg(F.count("*").alias("n")).select(F.col("_w.start").alias("window_start"), *keys, "n")
