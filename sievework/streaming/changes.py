"""Folder changes as streams: debounce with a longest wait, running tallies, event-time windows, incremental sync."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

QUIET_S, LONGEST_S = 2.0, 600.0


def sessions(events: DataFrame, key: str, ts: str, quiet: str = "2 seconds", late: str | None = None) -> DataFrame:
    """Bursts of changes: a quiet period ends one. Works on batches and, with `late`, on streams."""
    rows = events.withWatermark(ts, late) if late else events
    found = rows.groupBy(key, F.session_window(ts, quiet).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def bursts(times: list[float], quiet: float, longest: float) -> list[tuple[float, float, int]]:
    """(first, fires at, changes) of sorted times: after `quiet` of silence, or `longest` since the burst began."""
    out: list[tuple[float, float, int]] = []
    first = last = None
    n = 0
    for t in times:
        if n and t > min(last + quiet, first + longest):
            out.append((first, min(last + quiet, first + longest), n))
            n = 0
        if not n:
            first = t
        last, n = t, n + 1
    if n:
        out.append((first, min(last + quiet, first + longest), n))
    return out


def debounced(events: DataFrame, key: str, ts: str, quiet: float = QUIET_S, longest: float = LONGEST_S) -> DataFrame:
    """A stream's bursts with a longest wait, which session windows don't have: state per key, and a timer for the moment
    at which the burst fires. key: string, ts: timestamp with a watermark."""

    def run(name, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, n = state.get if state.exists else (0.0, 0.0, 0)
        fired = []
        if state.hasTimedOut:
            fired.append((first, min(last + quiet, first + longest), n))
            state.remove()
        else:
            times = sorted(t.timestamp() for frame in frames for t in frame["ts"])
            for t in times:
                if n and t > min(last + quiet, first + longest):
                    fired.append((first, min(last + quiet, first + longest), n))
                    n = 0
                first = first if n else t
                last, n = max(t, last) if n else t, n + 1
            state.update((first, last, n))
            due = int(1000 * min(last + quiet, first + longest))
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(name[0], a, b, c) for a, b, c in fired], columns=["key", "first", "fires", "n"])

    rows = events.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"))
    return rows.groupBy("key").applyInPandasWithState(run, "key string, first double, fires double, n long", "first double, last double, n long", "append", GroupStateTimeout.EventTimeTimeout)


def tumbling(events: DataFrame, ts: str, width: str, *by: str, late: str | None = None) -> DataFrame:
    rows = events.withWatermark(ts, late) if late else events
    found = rows.groupBy(F.window(ts, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.col("w.start").alias("start"), *by, "n")


def latest_queries(events: DataFrame, key: str, ts: str, query: str, pause: str = "120 milliseconds", late: str | None = None) -> DataFrame:
    """The newest query of each pause in typing. On streams, with `late`, a pause is given once it is over."""
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(key, F.session_window(ts, pause)).agg(F.max_by(query, ts).alias(query)).select(key, query)


def running_tallies(jobs: DataFrame) -> DataFrame:
    """A stream of jobs (name, units, seconds) to decayed tallies, as state for each name."""
    from sievework.operators.estimate import ENOUGH

    def run(name, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seconds, units = state.get if state.exists else (0.0, 0.0)
        for frame in frames:
            for u, s in zip(frame["units"], frame["seconds"], strict=True):
                if u > 0 and s > 0:
                    half = 0.5 if units > 10 * ENOUGH.get(name[0], 20) else 1.0
                    seconds, units = seconds * half + s, units * half + u
        state.update((seconds, units))
        yield pd.DataFrame([(name[0], seconds, units)], columns=["name", "seconds", "units"])

    return jobs.groupBy("name").applyInPandasWithState(run, "name string, seconds double, units double", "seconds double, units double", "update", GroupStateTimeout.NoTimeout)


def incremental(changes: DataFrame, apply: Callable[[DataFrame], None], checkpoint: str, full: Callable[[], None] | None = None):
    """Runs `apply` on each micro-batch's changed paths. An event without a path says that events were lost: then `full`
    syncs everything instead."""

    def each(batch: DataFrame, _: int) -> None:
        paths = batch.select(F.coalesce("path", F.lit("")).alias("path")).distinct()
        if full is not None and paths.where("path = ''").limit(1).count():
            full()
        else:
            apply(paths.where("path <> ''"))

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
