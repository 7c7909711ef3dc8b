"""Operators on small fixtures with known results."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievework.operators import estimate, evaluate, ranking, rules, segment, sync


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_meaning_scale(spark):
    rows = [(i, i, "doc", "text", True, 0.70 + 0.01 * (i % 3)) for i in range(30)] + [(30 + i, 30 + i, "image", "image", True, 0.55 + 0.002 * (i % 3)) for i in range(30)]
    schema = "id long, file long, kind string, modality string, sets_scale boolean, cosine double"
    z = {r["id"]: r["z"] for r in ranking.with_meaning(spark.createDataFrame(rows, schema)).collect()}
    assert abs(z[1]) < 1e-9 and abs(z[31]) < 1e-9
    assert z[2] / z[32] == pytest.approx(5)
    later = rows + [(60 + i, 60 + i, "pdf", "text", False, 0.9) for i in range(401)]
    more = {r["id"]: r["z"] for r in ranking.with_meaning(spark.createDataFrame(later, schema)).collect()}
    assert all(abs(more[i] - z[i]) < 1e-9 for i in range(60))
    few = rows + [(100 + i, 100 + i, "audio", "audio", True, 0.8) for i in range(5)]
    means = {r["modality"]: r["mean"] for r in ranking.modality_means(spark.createDataFrame(few, schema)).collect()}
    assert means["audio"] == pytest.approx(sum(r[5] for r in few) / len(few))


@pytest.mark.parametrize(("scores", "strong"), [([6, 4.1, 3, 2.9, 0.7], 3), ([0.71], 1), ([], 0)])
def test_fold(spark, scores, strong):
    hits = spark.createDataFrame([(i, float(s)) for i, s in enumerate(scores)], "file long, score double")
    assert ranking.with_strength(hits).where("strong").count() == strong


@pytest.mark.parametrize(
    ("name", "machine"),
    [("clip_000123", True), ("frame-0042", True), ("3f9a1c0e-77aa", True), ("IMG_1234", False), ("20261021_143022", False), ("2026-10-21 14.30.22", False), ("holiday", False), ("DSC00042", False)],
)
def test_machine_names(spark, name, machine):
    assert one(spark, rules.looks_machine_named(F.lit(name))) is machine


@pytest.mark.parametrize(
    ("path", "action", "kind"),
    [
        ("/a/x.PDF", "index", "pdf"), ("/a/Screenshot 1.png", "index", "screenshot"), ("/a/Screenshots/b.png", "index", "screenshot"), ("/a/b.jpg", "index", "image"),
        ("/a/b.m4p", "skip", None), ("/a/b.py", "skip", None), ("/a/b.md", "index", "doc"), ("/a/b.ts", "skip", None), ("/a/b", "ignore", None), ("/a/b.mkv", "index", "video"),
    ],
)
def test_classify(spark, path, action, kind):
    found = one(spark, rules.classify(F.lit(path)))
    assert (found["action"], found["kind"]) == (action, kind)


@pytest.mark.parametrize(
    ("path", "action", "reason"),
    [
        ("/a/.env.local", "skip", "key or password file"), ("/a/id_rsa", "skip", "key or password file"), ("/a/x.pem", "skip", "key or password file"), ("/a/app.min.js", "skip", "minified"),
        ("/a/LICENSE.txt", "skip", "license"), ("/a/Makefile", "index", None), ("/a/Dockerfile.dev", "index", None), ("/a/x.json", "skip", "data file"), ("/a/x.ipynb", "index", None), ("/a/x.png", "ignore", None),
    ],
)
def test_classify_code(spark, path, action, reason):
    found = one(spark, rules.classify_code(F.lit(path)))
    assert (found["action"], found["reason"]) == (action, reason)


def test_folders(spark):
    walked = lambda p: one(spark, rules.is_walked(F.lit(p), F.lit("/r")))
    assert [walked(p) for p in ("/r/a/b", "/r/.git/x", "/r/node_modules/x", "/r/x.noindex/y", "/rr/a")] == [True, False, False, False, False]
    files = spark.createDataFrame([(f"/x/clips/clip_{i:06d}.wav", "audio") for i in range(400)] + [(f"/x/cam/IMG_{i}.jpg", "image") for i in range(400)] + [(f"/x/few/clip_{i}.wav", "audio") for i in range(50)], "path string, kind string")
    assert [tuple(r) for r in rules.dataset_folders(files).collect()] == [("/x/clips", 400)]
    paths = spark.createDataFrame([("/p/app/package.json", "doc"), ("/p/app/src/notes.md", "doc"), ("/p/app/Screenshot 1.png", "screenshot"), ("/p/notes.md", "doc")], "path string, kind string")
    left = rules.outside_projects(paths, rules.project_folders(paths), "/p")
    assert {r["path"] for r in left.collect()} == {"/p/app/Screenshot 1.png", "/p/notes.md"}


def test_chunks():
    text = " ".join(f"word{i}" for i in range(1, 601))
    pieces = segment.chunk_text(text, 500, 100)
    assert len(pieces) > 5 and all(len(p) <= 500 and p.startswith("word") for p in pieces) and pieces[-1].endswith("word600")


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="ab \n\t", max_size=400))
def test_chunks_cover_every_word(text):
    pieces = segment.chunk_text(text, 60, 10)
    held = " ".join(pieces)
    for word in text.split():
        if len(word) < 20:
            assert word in held


def test_stretches():
    block = "def f():\n" + "".join(f"    line {i} of the body of this function with words\n" for i in range(21)) + "\n\n"
    pieces = segment.stretches(block * 3, 1800)
    assert [p[1:] for p in pieces][0][0] == 1 and all(len(p[0]) <= 1800 for p in pieces)
    long = "def g():\n" + "".join(f"    value_{i} = compute({i}, some, more, arguments)\n" for i in range(101))
    cut = segment.stretches(long, 1800)
    assert all(b[1] == a[2] - 1 for a, b in zip(cut, cut[1:], strict=False)) and cut[-1][2] == 102
    cells = ["a = 1", "b = 2", "", "c\n" * 1200]
    packed = segment.pack_cells(cells)
    assert [p[1:] for p in packed][0] == (1, 2) and all(p[1:] == (4, 4) for p in packed[1:])


def test_media(spark):
    windows = lambda d: [tuple(w) for w in one(spark, segment.audio_windows(F.lit(d)))]
    assert windows(20.0) == [(0.0, 20.0)] and windows(31.0) == [(0.0, 30.0)] and windows(32.0) == [(0.0, 30.0), (25.0, 32.0)] and windows(0.0) == []
    assert [tuple(s) for s in one(spark, segment.steps(30, 30, F.lit(100)))] == [(0, 30), (30, 60), (60, 90), (90, 100)]
    frames = spark.createDataFrame([(1, float(i), h) for i, h in enumerate([0, 0b11111, 0b11110, 0b0, 0b1])], "file long, start double, hash long")
    assert [r["start"] for r in segment.kept_frames(frames).orderBy("start").collect()] == [0.0, 1.0, 3.0]


def test_sync_is_idempotent_and_matches_moves(spark):
    schema = "path string, size long, mtime double, inode long, device long"
    stored = spark.createDataFrame([("/a/1", 1, 1.0, 1, 1), ("/a/2", 2, 2.0, 2, 1), ("/a/3", 3, 3.0, 3, 1), ("/gone/4", 4, 4.0, 4, 1)], schema)
    crawled = spark.createDataFrame([("/a/1", 1, 1.0, 1, 1), ("/a/2", 2, 9.0, 2, 1), ("/b/3", 3, 3.0, 3, 1), ("/b/5", 5, 5.0, 5, 1)], schema)
    found = {r["path"]: (r["change"], r["old_path"]) for r in sync.reconcile(stored, crawled, ["/a"]).collect()}
    assert found == {"/a/1": ("unchanged", None), "/a/2": ("changed", None), "/b/3": ("moved", "/a/3"), "/b/5": ("added", None)}
    assert {r["change"] for r in sync.reconcile(crawled, crawled).collect()} == {"unchanged"}
    files = spark.createDataFrame([("/a",), ("/a/x",), ("/ab/x",), ("/b/x",)], "path string")
    assert [r["path"] for r in sync.pruned(files, ["/a"]).orderBy("path").collect()] == ["/a", "/a/x"]
    assert sync.pruned(files, []).count() == 0


def test_evaluation(spark):
    hits = spark.createDataFrame([("q1", "/a", 1, None, 1), ("q1", "/b", 5, None, 2), ("q2", "/c", 10, 20, 1), ("q3", "/x", 1, None, 1)], "query string, path string, loc int, loc_end int, rank int")
    expected = spark.createDataFrame([("q1", "t", "/b", 4, 6), ("q2", "t", "/c", 20, 30), ("q3", "u", "/y", None, None)], "query string, tag string, path string, first int, last int")
    got = {r["tag"]: (r["n"], r["r1"], r["r5"], round(r["mrr"], 4)) for r in evaluate.metrics(evaluate.first_ranks(hits, expected)).collect()}
    assert got == {"t": (2, 0.5, 1.0, 0.75), "u": (1, 0.0, 0.0, 0.0), "ALL": (3, 0.3333333333333333, 0.6666666666666666, 0.5)}


def test_estimates(spark):
    files = spark.createDataFrame([("/a/x.swift", "code", 14000, 0, 0.0), ("/a/y.py", "code", 100, 0, 0.0), ("/a/z.ipynb", "code", 112000, 0, 0.0)], "path string, kind string, size long, pages long, duration double")
    assert estimate.units(files).agg(F.sum("first_units")).first()[0] == 21
    jobs = spark.createDataFrame([(i, "image", 100.0, 100.0) for i in range(3)] + [(9, "image", 20.0, 2.0)], "seq long, name string, units double, seconds double")
    assert tuple(estimate.tallies(jobs).first()) == ("image", 152.0, 170.0)
    assert one(spark, estimate.subfolder(F.lit("/d/a/b.txt"), "/d")) == "/d/a" and one(spark, estimate.subfolder(F.lit("/d/b.txt"), "/d")) == "/d"


def test_batches_of_a_long_queue(spark, monkeypatch):
    """Ranges of a queue join to the runs of the whole; no window orders all of its rows in one task."""
    rng = random.Random(3)
    rows, kind = [], "code"
    for i in range(3000):
        if i % 1000 > 700 or rng.random() < 0.03:
            kind = rng.choice(["image", "doc", "code", None] if i < 2000 else ["pdf"])
        rows.append((i * 3, kind))
    expected, run, before, place = [], 0, None, 0
    for i, kind in rows:
        place += 1
        if before is not None and kind is not None and kind != before:
            run, place = run + 1, 1
        expected.append((i, run, (place - 1) // 8))
        before = kind
    shuffled = spark.createDataFrame(rng.sample(rows, len(rows)), "id long, kind string")
    for bucket_rows in (40, 50_000):
        monkeypatch.setattr(sync, "BUCKET_ROWS", bucket_rows, raising=False)
        found = sync.batches(shuffled, "id")
        assert sorted(map(tuple, found.select("id", "run", "batch").collect())) == expected
        assert found.columns == ["id", "kind", "run", "batch"] and sync.batches(shuffled.limit(0), "id").count() == 0
        assert bucket_rows > 40 or "windowspecdefinition(id#" not in found._jdf.queryExecution().optimizedPlan().toString()
