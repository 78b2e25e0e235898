"""Sessions of photos that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_sessions(photos: DataFrame, gap: str = "4 hours", lateness: str = "1 day") -> DataFrame:
    """(library_id, start, end, n) of each session: photos of a library with no gap over `gap`.

    Works on a stream (append mode: a session comes out once the watermark is past its end) and on a table alike. State
    holds one row for each open session. Photos later than `lateness` are left out of a stream, as its watermark says.
    """
    timed = photos.where(F.col("taken_at").isNotNull()).withColumn("at", F.timestamp_millis("taken_at")).withWatermark("at", lateness)
    grouped = timed.groupBy("library_id", F.session_window("at", gap).alias("session"))
    return grouped.agg(F.min("taken_at").alias("start"), F.max("taken_at").alias("end"), F.count("*").alias("n")).drop("session")
