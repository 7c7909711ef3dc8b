"""Hours of the day in which work may run, in a time zone, and when they begin or end next.

A zone's changes of the clock are a table of periods with one offset each. Within a period the hours begin and end at
fixed instants of each day; a period's own beginning moves the clock, and may open or close the hours too. The instants
at which the hours really change are the flips; they alternate. An event looks up the flips of its own and the next two days
and takes the first one after it, so events are neither sorted nor shuffled by time.

A time that a change of the clock skips counts as the instant of the change; one that comes twice flips twice. The same
start and end mean all day, without flips. Times are seconds since 1970 in UTC.
"""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 24 * 3600
#: Days of flips that an event looks at: a closed day may follow a long one.
AHEAD = 3


def periods(spark: SparkSession, zone: str, first: int, last: int) -> DataFrame:
    """since, until, offset: the zone's periods that meet the seconds from `first` to `last`. A few rows a year."""
    tz = ZoneInfo(zone)
    offset = lambda at: int(datetime.fromtimestamp(at, UTC).astimezone(tz).utcoffset() / timedelta(seconds=1))
    out, since, at = [], first, first
    while at < last:
        step = min(at + 7 * DAY, last)
        if offset(step) != offset(at):
            low, high = at, step
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if offset(middle) == offset(at) else (low, middle)
            out.append((since, high, offset(low)))
            since, step = high, high
        at = step
    return spark.createDataFrame([*out, (since, last + 1, offset(last))], "since long, until long, offset int")


def is_open(local: Column, start: int, end: int) -> Column:
    """Whether a local time (seconds) lies in the hours from minute `start` to minute `end`, across midnight where the end
    comes first."""
    minute = F.floor(F.pmod(local, F.lit(DAY)) / 60)
    if start == end:
        return F.lit(True)
    return (minute >= start) & (minute < end) if start < end else (minute >= start) | (minute < end)


def flips(zones: DataFrame, start: int, end: int) -> DataFrame:
    """at, opens: the instants at which the hours begin or end."""
    if start == end:
        return zones.sparkSession.createDataFrame([], "at long, opens boolean")
    # The clock before a period's beginning is that of the period before.
    before = zones.select(F.col("until").alias("since"), F.col("offset").alias("old"))
    zones = zones.join(before, "since", "left")
    day = F.explode(F.sequence(F.floor((F.col("since") + F.col("offset")) / DAY) - 1, F.floor((F.col("until") + F.col("offset")) / DAY) + 1))
    days = zones.select("since", "until", "offset", day.alias("day"))
    walls = days.select("*", F.explode(F.array(F.lit(start * 60), F.lit(end * 60))).alias("second"))
    within = walls.select((F.col("day") * DAY + F.col("second") - F.col("offset")).alias("at"), "since", "until", "offset").where("at > since and at < until")
    inner = within.select("at", F.col("offset").alias("new"), F.col("offset").alias("old"))
    edges = zones.where("old is not null").select(F.col("since").alias("at"), F.col("offset").alias("new"), "old")
    opens, was = is_open(F.col("at") + F.col("new"), start, end), is_open(F.col("at") - 1 + F.col("old"), start, end)
    return inner.unionByName(edges).select("at", opens.alias("opens"), was.alias("was")).where("opens <> was").drop("was")


def with_hours(events: DataFrame, ts: str, start: int, end: int, zone: str, first: int, last: int) -> DataFrame:
    """events with `open`, whether the hours hold at `ts` (seconds), and `next_change`, when that changes; null for all day.

    first and last: seconds that hold all of `ts`, for which flips are worked out; events outside them have nulls."""
    start, end = start % 1440, end % 1440
    zones = periods(events.sparkSession, zone, first - DAY, last + (AHEAD + 1) * DAY)
    if start == end:
        return events.withColumns({"open": F.lit(True), "next_change": F.lit(None).cast("long")})
    found = flips(zones, start, end)
    ahead = found.select(F.explode(F.sequence(F.floor(F.col("at") / DAY) - AHEAD, F.floor(F.col("at") / DAY))).alias("__day"), F.struct("at", "opens").alias("f"))
    # A row for each day, with its few flips.
    near = ahead.groupBy("__day").agg(F.sort_array(F.collect_list("f")).alias("__flips"))
    rows = events.withColumn("__day", F.floor(F.col(ts) / DAY)).join(near, "__day", "left")
    after = F.filter("__flips", lambda f: f["at"] > F.col(ts))
    following = F.get(after, F.lit(0))
    out = rows.withColumns({"open": ~following["opens"], "next_change": following["at"]})
    inside = F.col(ts).between(first, last)
    return out.withColumns({c: F.when(inside, F.col(c)) for c in ("open", "next_change")}).drop("__day", "__flips")
