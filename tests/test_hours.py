"""Hours in time zones minute by minute, across changes of the clock."""

import random
from datetime import UTC, datetime
from zoneinfo import ZoneInfo

import pytest
from sievework.operators import hours


def opened(at, start, end, tz):
    local = datetime.fromtimestamp(at, UTC).astimezone(tz)
    minute = local.hour * 60 + local.minute
    return True if start == end else start <= minute < end if start < end else minute >= start or minute < end


@pytest.mark.parametrize(("zone", "start", "end"), [("Europe/Berlin", 150, 1320), ("Europe/Berlin", 1320, 360), ("America/New_York", 60, 420), ("Australia/Lord_Howe", 100, 130), ("Asia/Kathmandu", 0, 1), ("UTC", 1439, 0), ("Europe/Berlin", 120, 180)])
def test_next_change_minute_by_minute(spark, zone, start, end):
    tz, rng, rows = ZoneInfo(zone), random.Random(1), []
    for day in ("2024-03-09", "2024-03-30", "2024-04-06", "2024-10-05", "2024-10-26", "2024-11-02", "2024-07-01"):
        base = int(datetime.fromisoformat(day).replace(tzinfo=UTC).timestamp())
        rows += [base + rng.randint(0, 2 * hours.DAY) for _ in range(8)]
    right = {}
    for at in rows:
        now, later = opened(at, start, end, tz), at - at % 60 + 60
        while opened(later, start, end, tz) == now:
            later += 60
        right[at] = (now, later)
    events = spark.createDataFrame([(r,) for r in rows], "at long")
    got = hours.with_hours(events, "at", start, end, zone, min(rows), max(rows)).collect()
    assert {r["at"]: (r["open"], r["next_change"]) for r in got} == right and len(got) == len(rows)


def test_all_day_nulls_and_outside(spark):
    events = spark.createDataFrame([(1_700_000_000,), (None,), (1,)], "at long")
    assert {tuple(r) for r in hours.with_hours(events, "at", 60, 60, "UTC", 0, 1).collect()} == {(1_700_000_000, True, None), (None, True, None), (1, True, None)}
    got = {r["at"]: (r["open"], r["next_change"]) for r in hours.with_hours(events, "at", 60, 120, "UTC", 1_699_000_000, 1_701_000_000).collect()}
    assert got[None] == got[1] == (None, None) and got[1_700_000_000][0] is False
    assert hours.with_hours(events.limit(0), "at", 1, 2, "UTC", 0, 1).count() == 0
