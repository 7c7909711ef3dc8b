"""The vector index against the search over all rows: scale, best files, blocks that are skipped, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from sievework.operators import ranking as R
from sievework.operators import search, vectors
from sievework.operators.keyword_index import KeywordIndex
from sievework.operators.keyword_index import build as build_words
from sievework.operators.vectors import VectorIndex, build

SCHEMA = "id long, file long, kind string, modality string, sets_scale boolean, vec array<float>"


def clustered(n, width=12, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(15, width))
    rows = []
    for i in range(n):
        v = centres[i % 15] + rng.normal(size=width) * 0.15
        rows.append((i, int(rng.integers(0, n // 3)), ["image", "doc", "pdf"][i % 3], ["text", "image", None, "rare"][min(i % 4, 3) if i % 200 else 3] if i % 4 != 3 or i % 40 == 3 else "text", i % 9 != 0, [float(x) for x in v / np.linalg.norm(v)]))
    return rows


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    rows = clustered(3000)
    rows += [(9001, 1, "doc", "text", True, None), (9002, 1, "doc", "text", True, [1.0, None] + [0.0] * 10), (9003, 1, "doc", "text", True, [float("nan")] + [0.0] * 11), (9004, 1, "doc", "text", True, [1.0])]
    folder, kept = str(tmp_path_factory.mktemp("vectors")), vectors.BLOCK
    vectors.BLOCK = 32
    segments = spark.createDataFrame(rows, SCHEMA).repartition(3)
    build(segments, folder)
    vectors.BLOCK = kept
    return segments.where("id < 9000"), VectorIndex(spark, folder), rows


def full(spark, segments, q, kinds=None):
    meant = R.with_meaning(R.cosines(segments, spark.createDataFrame([(q,)], "q array<float>")))
    return {r["file"]: r for r in R.best_per_file(meant, kinds).collect()}


@pytest.mark.parametrize("kinds", [None, ["doc", "pdf"]])
@pytest.mark.parametrize("hinted", [[], ["image"]])
def test_equals_the_search_over_all_rows(spark, both, kinds, hinted):
    segments, index, rows = both
    for at in (0, 7, 500):
        q = rows[at][5]
        scale, right = index.scale(q), full(spark, segments, q, kinds)
        value = lambda r, w=1.0: w * max(r["z"], 0) + (r["kind"] in hinted)
        for k, gate in ((1, -9.0), (25, -9.0), (40, 2.0)):
            order = sorted((r for r in right.values() if r["z"] >= gate), key=lambda r: (-round(value(r), 7), r["file"]))[:k]
            for small in (0, 10**9):
                got = index.best_files(q, scale, k, kinds, hinted, gate=gate, small=small)
                assert [(f, s, pytest.approx(z, abs=1e-6), kind) for f, s, z, _, kind in got] == [(r["file"], r["segment"], r["z"], r["kind"]) for r in order]
        some = sorted(right)[:30]
        assert {r[0]: (r[1], pytest.approx(r[2], abs=1e-6)) for r in index.of_files([*some, 10**9], q, scale, kinds)} == {f: (right[f]["segment"], right[f]["z"]) for f in some}


def test_blocks_are_skipped(both, monkeypatch):
    _, index, rows = both
    seen = []
    score = VectorIndex._score

    def counted(self, blocks, *more, **named):
        seen.append(blocks.count())
        return score(self, blocks, *more, **named)

    monkeypatch.setattr(VectorIndex, "_score", counted)
    q = rows[4][5]
    assert len(index.best_files(q, index.scale(q), 10, small=0)) == 10
    assert sum(seen) < 0.5 * index.heads.count() and index.rows == 3000
    plan = index.blocks.where(F.col("pivot").isin([1]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(pivot" in plan


def test_bounds_hold(both):
    _, index, _ = both
    heads = {r["block"]: r for r in index.heads.collect()}
    for b in index.blocks.collect():
        x, head = np.frombuffer(b["vectors"], np.float32).reshape(b["n"], -1).astype(float), heads[b["block"]]
        assert np.linalg.norm(x - np.array(head["centre"]), axis=1).max() <= head["radius"] and b["n"] <= 32


def test_fused_search_equals_the_plain_one(spark, both, tmp_path):
    segments, index, rows = both
    rng = np.random.default_rng(5)
    words = "river stone lamp table window garden cloud seven invoice photo".split()
    build_words(spark.createDataFrame([(i, int(rng.integers(0, 1000)), "n", " ".join(words[k] for k in rng.integers(0, len(words), 3))) for i in range(300)], "rowid long, file long, name string, body string"), str(tmp_path))
    index_words = KeywordIndex(spark, str(tmp_path))
    for query, at, kinds in (("river stone", 3, None), ("photo of a lamp", 11, ["image", "doc"]), ("zzzz", 8, None)):
        q = spark.createDataFrame([(rows[at][5],)], "q array<float>")
        plain = search.search(segments, q, index_words, query, kinds, limit=15).collect()
        quick = search.search(segments, q, index_words, query, kinds, limit=15, vectors=index).collect()
        shown = lambda hits: [(r["file"], round(r["score"], 6), r["segment"], r["keyword_rank"], r["strong"]) for r in hits]
        assert shown(plain) == shown(quick) and plain


def test_empty_and_without_scale(spark, tmp_path):
    for name, rows in (("none", []), ("null", [(1, 1, "doc", "text", True, None)])):
        build(spark.createDataFrame(rows, SCHEMA), str(tmp_path / name))
        index = VectorIndex(spark, str(tmp_path / name))
        assert index.scale([1.0]) is None and index.rows == 0
    build(spark.createDataFrame([(1, 1, "doc", "text", False, [1.0, 0.0])], SCHEMA), str(tmp_path / "unset"))
    assert VectorIndex(spark, str(tmp_path / "unset")).scale([1.0, 0.0]) is None
