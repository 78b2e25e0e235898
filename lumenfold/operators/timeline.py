"""Sessions, days, runs of days, and trips.

Windows over single photos are cut by library and calendar day, so that a library of any size is spread over many
tasks; only one row for each day crosses from day to day in windows over a whole library.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.checkpoint import shared_checkpoint
from lumenfold.functions.scalar import day_index, haversine
from lumenfold.options import TimelineOptions


def sessions(photos: DataFrame, gap_ms: int = TimelineOptions().session_gap_ms) -> DataFrame:
    """`photos` with a time, and `session_start`: a session ends where more than `gap_ms` pass to the next photo."""
    timed = photos.where(F.col("taken_at").isNotNull()).withColumn("day", day_index(F.col("taken_at")))
    in_day = Window.partitionBy("library_id", "day").orderBy("taken_at", "id")
    by_day = Window.partitionBy("library_id").orderBy("day")
    days = timed.groupBy("library_id", "day").agg(F.max("taken_at").alias("last")).withColumn("before", F.lag("last").over(by_day)).drop("last")
    rows = timed.join(days, ["library_id", "day"]).withColumn("before", F.coalesce(F.lag("taken_at").over(in_day), "before"))
    rows = rows.withColumn("fresh", F.when(F.col("before").isNull() | (F.col("taken_at") - F.col("before") > gap_ms), F.col("taken_at")))
    rows = rows.withColumn("own", F.max("fresh").over(in_day))
    begun = rows.groupBy("library_id", "day").agg(F.max("fresh").alias("latest"))
    begun = begun.withColumn("carried", F.max("latest").over(by_day.rowsBetween(Window.unboundedPreceding, -1))).drop("latest")
    return rows.join(begun, ["library_id", "day"]).withColumn("session_start", F.coalesce("own", "carried")).drop("day", "before", "fresh", "own", "carried")


def days(in_sessions: DataFrame) -> DataFrame:
    """One row for each day cluster: the sessions that start on one calendar day, also where they pass midnight.

    Needs `counted` (whether a photo counts) and `meters` (from home, or null); keeps the furthest.
    """
    grouped = in_sessions.groupBy("library_id", day_index(F.col("session_start")).alias("day"))
    return grouped.agg(F.min("taken_at").alias("start"), F.max("taken_at").alias("end"), F.count("*").alias("n"), F.count_if("counted").alias("n_counted"), F.max("meters").alias("furthest"))


def runs(day_rows: DataFrame, bridge_ms: int = TimelineOptions().day_bridge_ms) -> DataFrame:
    """Days with the start of their `run`: a run ends where more than `bridge_ms` pass between one day's end and the next one's start."""
    by_day = Window.partitionBy("library_id").orderBy("day")
    before = F.lag("end").over(by_day)
    fresh = F.when(before.isNull() | (F.col("start") - before > bridge_ms), F.col("start"))
    return day_rows.withColumn("fresh", fresh).withColumn("run", F.max("fresh").over(by_day)).drop("fresh")


def trips(run_rows: DataFrame, options: TimelineOptions = TimelineOptions()) -> DataFrame:
    """One row for each run, and whether it is a trip: days and counted photos enough, and far from home if that can be told."""
    grouped = run_rows.groupBy("library_id", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_days"), F.sum("n").alias("n"), F.sum("n_counted").alias("n_counted"), F.max("furthest").alias("furthest")
    )
    far = F.coalesce(F.col("furthest") > options.far_meters, F.lit(True))
    return grouped.withColumn("is_trip", (F.col("n_days") >= options.trip_min_days) & (F.col("n_counted") >= options.trip_min_photos) & far)


def with_home(photos: DataFrame, homes: DataFrame) -> DataFrame:
    """`photos` with `meters` from their library's home; null without a home or a place."""
    joined = photos.join(homes, "library_id", "left")
    return joined.withColumn("meters", haversine(F.col("home_lat"), F.col("home_lon"), F.col("lat"), F.col("lon")))


def timeline(photos: DataFrame, homes: DataFrame, counted: DataFrame | None = None, options: TimelineOptions = TimelineOptions()) -> tuple[DataFrame, DataFrame]:
    """The events, and the event of each photo with a time.

    Events have library_id, event_kind (trip or day), event (its start), start, end, n_days, nights, n_counted. `counted` has
    library_id, id and counted; without it photos may have a column `counted`, else all count. Members have library_id, id, event_kind and event.
    """
    rows = with_home(photos.drop("home_lat", "home_lon", "meters"), homes)
    if counted is not None:
        rows = rows.drop("counted").join(counted.select("library_id", "id", "counted"), ["library_id", "id"], "left").withColumn("counted", F.coalesce("counted", F.lit(True)))
    elif "counted" not in rows.columns:
        rows = rows.withColumn("counted", F.lit(True))
    # each step reads the one before more than once
    rows = shared_checkpoint(rows.where(F.col("taken_at").isNotNull()).select("library_id", "id", "taken_at", "counted", "meters"))
    placed = shared_checkpoint(sessions(rows, options.session_gap_ms))
    in_runs = shared_checkpoint(runs(days(placed), options.day_bridge_ms))
    judged = in_runs.join(trips(in_runs, options).select("library_id", "run", "is_trip"), ["library_id", "run"])
    kind = F.when(F.col("is_trip"), "trip").otherwise("day")
    own = shared_checkpoint(judged.select("library_id", "day", kind.alias("event_kind"), F.when(F.col("is_trip"), F.col("run")).otherwise(F.col("start")).alias("event"), "start", "end", "n_counted"))
    events = own.groupBy("library_id", "event_kind", "event").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").cast("int").alias("n_days"), F.sum("n_counted").alias("n_counted"))
    events = events.withColumn("nights", F.col("n_days") - 1)
    members = placed.withColumn("day", day_index(F.col("session_start"))).join(own.select("library_id", "day", "event_kind", "event"), ["library_id", "day"])
    return events, members.select("library_id", "id", "event_kind", "event")
