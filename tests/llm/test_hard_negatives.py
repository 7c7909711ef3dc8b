"""Hard negatives against a plain double loop: nulls, ties, repeated ids, odd vectors, several waves and blocks."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from sievework.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, modulus=10, positives=5, k=5, lower=80, upper=100):
    use = [(i, l, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, l in rows if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = collections.Counter()
    place = lambda r: (-r[0], r[1] is None, r[1] or 0)
    for a, label, v in use:
        if a is None or a % modulus:
            continue
        dot = [(sum(x * y for x, y in zip(v, w, strict=False)), i, l) for i, l, w in use]
        near = sorted((r for r in dot if r[2] == label and r[1] != a), key=place)[:positives]
        far = sorted((r for r in dot if r[2] != label), key=place)
        for p in near:
            for n, r in enumerate([r for r in far if lower * p[0] <= 100 * r[0] <= upper * p[0]][:k]):
                out[(a, p[1], n + 1, r[1], p[0], r[0])] += 1
    return out


def mined(spark, rows, **more):
    d = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("key", "of", "ID", "vector", "score")]).repartition(3)
    return collections.Counter(map(tuple, hard_negatives.mine(d, F.col("vec_id") % 10 == 0, **more).collect()))


def vectors(n, labels=3, width=8, seed=1):
    rng = np.random.default_rng(seed)
    # Few distinct values, so that scores tie.
    return [(i, [float(x) for x in rng.integers(-1, 4, width) / 4], int(rng.integers(0, labels))) for i in range(n)]


@pytest.mark.parametrize(("block", "abreast", "wave"), [(4096, 256, 16 << 20), (16, 3, 500)])
def test_equals_the_double_loop(spark, monkeypatch, block, abreast, wave):
    for name, value in (("BLOCK", block), ("ABREAST", abreast), ("WAVE_BYTES", wave)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = vectors(160)
    got = mined(spark, rows)
    assert got == brute(rows) and len(got) > 100


def test_other_limits(spark):
    rows = vectors(90, 2)
    assert mined(spark, rows, positives=3, k=7, lower=50, upper=120) == brute(rows, positives=3, k=7, lower=50, upper=120)


def test_rows_that_take_no_part_and_repeated_rows(spark):
    rows = vectors(60, 2, 4)
    rows += [(100, None, 1), (110, [1.0, None, 0.0, 0.0], 1), (120, [float("nan"), 1.0, 0.0, 0.0], 0), (130, [float("inf"), 1.0, 1.0, 1.0], 0), (140, [1.0] * 4, None), (None, [1.0] * 4, 1), (None, [0.5] * 4, 0)]
    rows += [rows[10], rows[20], (10, [0.5, 0.5, 0.5, 0.5], rows[10][2]), (20, [0.75, 0.5, 0.5, 0.5], 1 - rows[20][2]), (7, [], 1), (150, [], 0), (160, [0.5, 0.25], 1), (17, [0.5] * 9, 0)]
    assert mined(spark, rows) == brute(rows)


def test_one_label_and_few_rows(spark):
    assert not mined(spark, [(i, [1.0, 0.5], 1) for i in range(30)])
    assert not mined(spark, [])
    assert not mined(spark, [(i, [1.0], 1) for i in range(1, 9)])
    few = [(10, [1.0, 0.0], 1), (11, [0.9, 0.1], 1), (12, [0.85, 0.9], 2), (13, [-1.0, 0.0], 2)]
    assert mined(spark, few) == brute(few) and sum(brute(few).values()) == 1


def test_large_components(spark):
    """Sums beyond 2**53 stay exact; beyond the limit of a score they count as the limit."""
    rows = [(10, [4e5, 3.0], 1), (11, [8e5, 1.0], 1), (12, [8e5, 0.5], 2), (13, [7e5, 2.0], 2)]
    assert mined(spark, rows) == brute(rows)
    assert {r[4] for r in mined(spark, [(10, [1e30] * 3, 1), (11, [1e30] * 3, 1), (12, [1e30] * 3, 2)])} == {hard_negatives.MOST_SCORE}
    a, b = np.array([[2.0**31, 2.0**31 - 1]]), np.array([[2.0**22 + 1, 2.0**22 - 1]])
    assert hard_negatives.scores(a, b).tolist() == [[2**31 * (2**22 + 1) + (2**31 - 1) * (2**22 - 1)]]
