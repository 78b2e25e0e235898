"""Runs of days and trips of photos that arrive as a stream, in any order within the watermark.

What a library has open is a list of sessions, each a few numbers: sessions are intervals, and a photo that comes late extends one or
joins two, so the order of arrival doesn't matter. Days and runs follow from the sessions. A run is told once no photo can reach it
any more: when the watermark has passed both the longest bridge after its end and the end of the calendar day on which its last
session began. Then its sessions are forgotten, so state grows with open runs, not with photos.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenfold.functions.scalar import DAY_MS
from lumenfold.operators import timeline as tl
from lumenfold.options import TimelineOptions

#: A session: start, end, n, n_counted, furthest (or None).
Session = list


def joined(sessions: list[Session], gap_ms: int) -> list[Session]:
    """Sessions in order, where those no more than `gap_ms` apart are one."""
    out: list[Session] = []
    for start, end, n, counted, far in sorted(sessions, key=lambda s: s[:2]):
        if out and start - out[-1][1] <= gap_ms:
            last = out[-1]
            known = [x for x in (last[4], far) if x is not None]
            out[-1] = [last[0], max(last[1], end), last[2] + n, last[3] + counted, max(known, default=None)]
        else:
            out.append([start, end, n, counted, far])
    return out


def in_runs(sessions: list[Session], bridge_ms: int) -> list[list[Session]]:
    """Sessions in order by run: a day has the sessions that begin on it, and a run goes on while bridges between days are short enough."""
    runs: list[list[Session]] = []
    for s in sessions:
        if runs and (s[0] // DAY_MS == runs[-1][-1][0] // DAY_MS or s[0] - max(x[1] for x in runs[-1]) <= bridge_ms):
            runs[-1].append(s)
        else:
            runs.append([s])
    return runs


def closed_at(run: list[Session], bridge_ms: int) -> int:
    """From this watermark on nothing can be added to a run."""
    return max(max(s[1] for s in run) + bridge_ms + 1, (run[-1][0] // DAY_MS + 1) * DAY_MS)


def told(run: list[Session], options: TimelineOptions) -> list:
    far = max((s[4] for s in run if s[4] is not None), default=None)
    days, counted = len({s[0] // DAY_MS for s in run}), sum(s[3] for s in run)
    trip = days >= options.trip_min_days and counted >= options.trip_min_photos and (far is None or far > options.far_meters)
    return [run[0][0], run[0][0], max(s[1] for s in run), days, sum(s[2] for s in run), counted, far, trip]


COLUMNS = "run long, start long, end long, n_days long, n long, n_counted long, furthest double, is_trip boolean"


def stream_trips(photos: DataFrame, options: TimelineOptions = TimelineOptions(), lateness: str = "1 day") -> DataFrame:
    """(library_id, run, start, end, n_days, n, n_counted, furthest, is_trip) of each run of days.

    `photos` have library_id, taken_at (ms), counted and meters (from home, or null). On a stream (append mode) a run comes out once it is
    closed, and photos later than `lateness` are left out, as its watermark says; a table gives all its runs.
    """
    rows = photos.where(F.col("taken_at").isNotNull()).select("library_id", F.col("taken_at").cast("long").alias("taken_at"), F.coalesce(F.col("counted"), F.lit(False)).alias("counted"), F.col("meters").cast("double").alias("meters"))
    if not photos.isStreaming:
        days = tl.days(tl.sessions(rows.withColumn("id", F.lit("")), options.session_gap_ms))
        return tl.trips(tl.runs(days, options.day_bridge_ms), options).select("library_id", "run", "start", "end", "n_days", "n", "n_counted", "furthest", "is_trip")
    kind = rows.schema["library_id"].dataType.simpleString()

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []
        now = state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            for frame in frames:
                own = frame[frame["taken_at"] >= now]
                far = own["meters"].astype(float)
                held += [[int(t), int(t), 1, int(c), None if pd.isna(m) else float(m)] for t, c, m in zip(own["taken_at"], own["counted"], far)]
                held = joined(held, options.session_gap_ms)
        runs = in_runs(held, options.day_bridge_ms)
        over = [r for r in runs if closed_at(r, options.day_bridge_ms) <= now]
        left = [r for r in runs if closed_at(r, options.day_bridge_ms) > now]
        if left:
            state.update((json.dumps([s for r in left for s in r]),))
            state.setTimeoutTimestamp(min(closed_at(r, options.day_bridge_ms) for r in left))
        elif state.exists:
            state.remove()
        if over:
            out = pd.DataFrame([[key[0], *told(r, options)] for r in over], columns=["library_id", *(x.split()[0] for x in COLUMNS.split(", "))])
            yield out.astype({"furthest": float})

    timed = rows.withColumn("at", F.timestamp_millis("taken_at")).withWatermark("at", lateness)
    return timed.groupBy("library_id").applyInPandasWithState(run, f"library_id {kind}, {COLUMNS}", "sessions string", "append", GroupStateTimeout.EventTimeTimeout)
