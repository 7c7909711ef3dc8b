"""The parallel fold of costs against one after the other."""

import random

import numpy as np
import pytest
from sievework.operators import estimate


def one_by_one(jobs):
    out = {}
    for _, name, units, seconds in sorted(jobs, key=lambda j: (j[0], j[2] or 0, j[3] or 0)):
        if units and seconds and units > 0 and seconds > 0:
            s, u = out.get(name, (0.0, 0.0))
            half = 0.5 if u > 10 * estimate.ENOUGH.get(name, 20) else 1.0
            out[name] = (s * half + seconds, u * half + units)
    return out


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_tallies_in_ranges(spark, parts):
    rng = random.Random(parts)
    jobs = [(i, rng.choice(["image", "image", "image", "docChunk", "audioSecond", "own", None]), rng.choice([0.5, 1.0, 7.0, 150.0, 260.0, 0.0, -1.0]), rng.choice([0.25, 3.0, 11.0, None])) for i in range(4000)]
    jobs += [(7, "image", 3.0, 1.0), (7, "image", 3.0, 1.0), (7, "image", 2.0, 5.0)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["name"]: (pytest.approx(r["seconds"], rel=1e-9), pytest.approx(r["units"], rel=1e-9)) for r in estimate.tallies(spark.createDataFrame(jobs, "seq long, name string, units double, seconds double")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    right = one_by_one(jobs)
    assert got == right and len(right) == 5
    assert estimate.tallies(spark.createDataFrame([], "seq long, name string, units double, seconds double")).count() == 0


def test_a_map_holds_for_every_tally_before():
    rng = np.random.default_rng(2)
    for _ in range(30):
        units, seconds = rng.choice([1.0, 40.0, 90.0, 200.0], 60), rng.random(60)
        since, scale, u, s = estimate._composed(units, seconds, 200.0, 1000.0)
        assert (np.diff(since) > 0).all()
        for start in (0.0, 13.0, 160.0, 199.5, 200.0, 201.0, 399.0, 1000.0):
            now, took = start, 1.0
            for a, b in zip(units, seconds, strict=True):
                half = 0.5 if now > 200 else 1.0
                now, took = now * half + a, took * half + b
            k = int((since <= start).sum()) - 1
            assert start * scale[k] + u[k] == pytest.approx(now) and scale[k] + s[k] == pytest.approx(took)
