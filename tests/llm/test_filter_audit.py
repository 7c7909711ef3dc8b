"""The filter audit against removing documents order by order."""

import collections
import itertools
import random
import re

import numpy as np
import pytest
from sievework.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(rows):
    least = collections.defaultdict(list)
    for i, text, _ in rows:
        if i is not None:
            least[text or ""].append(i)
    out = []
    for i, text, part in rows:
        text = text or ""
        words = WORD.findall(text)
        capitals = sum("A" <= c <= "Z" for c in text)
        one = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * capitals > 2 * len(text), "D": bool(set(text) & set("#$%&*|")), "E": i is not None and min(least[text]) < i}
        out.append((i, part or "", one))
    return out


def brute(rows, labels):
    marks = collections.defaultdict(lambda: [0, 0])
    for i, good, toxic in labels:
        marks[i] = [max(marks[i][0], good == 1), max(marks[i][1], toxic == 1)]
    out, shapley = {}, collections.Counter()
    failed = fails(rows)
    for part in {p for _, p, _ in failed}:
        own = [(i, one) for i, p, one in failed if p == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                out[part, order, step] = [len(left), len(gone), sum(one[f] for _, one in own) - len(gone), sum(one[f] and sum(one.values()) == 1 for _, one in own), *(sum(marks[i][k] for i, _ in gone if i is not None) for k in (0, 1))]
                shapley[part, f] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def corpus():
    rng = random.Random(7)
    rows = []
    for i in range(150):
        n = rng.choice([0, 3, 150, 199, 200, 260])
        text = rng.choice([" ", "\n", "\t\x0b "]).join(rng.choice(["w%d" % rng.randint(0, 400), "Wort", "é😀", "x"] if rng.random() < 0.9 else ["BIG"]) for _ in range(n)) + rng.choice(["", "", "#", "　"])
        rows.append((i, text, rng.choice(["a", "b", None, ""])))
    rows += [(200 + i, rows[rng.randint(0, 149)][1], rng.choice("ab")) for i in range(40)]
    rows += [(300, None, "a"), (301, "", None), (None, rows[5][1], "a"), (None, "own", "a"), (None, "own", "a"), (7, rows[7][1], rows[7][2]), (2, rows[9][1], "b"), (400, "long " * 40_000, "b")]
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, 200, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    return rows, labels


def test_equals_removing_order_by_order(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS id", "2 AS mask", "3 AS Part", "4 AS good").repartition(4)
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == filter_audit.OUT
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got.collect()} == brute(rows, labels)


def test_empty_and_single(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert filter_audit.audit(none, labels).count() == 0
    one = spark.createDataFrame([(1, "x", "s")], "doc_id long, text string, source string")
    rows = filter_audit.audit(one, labels).collect()
    assert len(rows) == 600 and {r["shapley"] for r in rows if r["filter_order"][r["step"] - 1] == "A"} == {120}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_swaps_lead_through_all_orders(n):
    order, seen = list(range(n)), [tuple(range(n))]
    for i in filter_audit.swaps(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        seen.append(tuple(order))
    assert sorted(seen) == list(itertools.permutations(range(n)))


def test_a_swap_counts_two_steps_anew():
    rng = np.random.default_rng(1)
    counts = {c: rng.integers(0, 9, (3, 16)) for c in filter_audit.COUNTS}
    before, orders = None, 0
    for order, steps in filter_audit.walk(counts, 4):
        if before is not None:
            assert sum(a is not b for a, b in zip(before, steps, strict=True)) == 2
        before, orders = list(steps), orders + 1
        assert (steps[-1]["kept"] == counts["n"][:, 0]).all() and len(set(order)) == 4
    assert orders == 24
