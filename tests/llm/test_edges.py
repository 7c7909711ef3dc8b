"""Large groups at other thresholds, repeated and null ids, clashing columns, components beyond one task, run() itself."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from sievework.llm import bpe, exact_dedup, graph, jaccard_join, language_id, mixing, quality
from test_corpus_operators import EN, near_brute, prose

CLASH = {"gone": 1, "digest": "d", "keep_id": 2, "Keep_Points": 3, "bytes": 4, "ID": 5, "size": 6, "position": 7, "range": 8, "__drop": 9, "__id": 10, "component_id": 11}


def clashing(spark, rows, schema):
    d = spark.createDataFrame(rows, schema)
    return d.select("*", *[F.lit(v).alias(k) for k, v in CLASH.items()])


@pytest.mark.parametrize(("window", "up"), [(3, 50), (3, 80), (5, 80), (3, 90)])
def test_jaccard_join_of_large_groups_at_any_threshold(spark, monkeypatch, window, up):
    """Sizes from one to twice, so that bands and chunks meet; groups far larger than a block."""
    monkeypatch.setattr(jaccard_join, "CHUNK", 8)
    monkeypatch.setattr(jaccard_join, "WIDE_CHUNK", 16)
    rng, texts = np.random.default_rng(up), {}
    for i in range(120):
        words = [f"w{k}" for k in range(int(rng.integers(60, 130)))]
        for at in rng.integers(0, len(words), int(rng.integers(0, 5))):
            words[at] = f"new{i}_{at}"
        texts[i] = " ".join(words)
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: tuple(r)[1:] for r in jaccard_join.jaccard_classes(d, window=window, up=up).collect()}
    assert got == near_brute(texts, window, up)


def test_jaccard_join_with_a_shared_passage(spark):
    """Unlike texts that share a long passage are no group, whatever the passage's length."""
    passage = [f"p{k}" for k in range(60)]
    texts = {i: " ".join([*(f"a{i}_{k}" for k in range(40)), *passage, *(f"b{i}_{k}" for k in range(30))]) for i in range(150)}
    texts |= {200 + i: texts[i].replace(f"a{i}_3 ", "x ", 1) for i in range(0, 150, 10)}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in jaccard_join.jaccard_classes(d, window=5, up=80).collect()}
    assert got == near_brute(texts, 5, 80) and len({c for _, c, _ in got.values()}) == 150


def test_jaccard_join_of_repeated_and_null_ids(spark):
    a, b = prose(EN, 1, 60), prose(EN, 2, 60)
    rows = [(5, a), (5, b), (7, a + " x"), (None, a), (8, b + " y"), (9, None), (9, ""), (7, a + " x"), (None, None)]
    d = clashing(spark, rows, "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["n_shingles"] > 0, r["component_id"]) for r in jaccard_join.jaccard_classes(d).collect())
    assert got == {(5, True, 5): 2, (7, True, 5): 2, (None, True, None): 1, (8, True, 5): 1, (9, False, 9): 2, (None, False, None): 1}
    kept = jaccard_join.keep_documents(d)
    assert kept.columns == d.columns
    # Both classes are named 5, by rows of their own.
    assert collections.Counter((r["doc_id"], r["text"]) for r in kept.collect()) == {(5, a): 1, (5, b): 1, (None, a): 1, (9, None): 1, (9, ""): 1, (None, None): 1}


@pytest.mark.parametrize("few", [2_000_000, 10])
def test_components(spark, few):
    rng = np.random.default_rng(few)
    edges = [(int(a), int(b)) for a, b in rng.integers(-300, 300, (260, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(60)] + [(5, 5)]
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for x, y in edges:
        low, high = sorted((find(x), find(y)))
        root[high] = low
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(5), "a", "b", few).collect()}
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: find(n) for n in linked}
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b", few).count() == 0


def test_exact_dedup_and_mixing_with_clashing_columns(spark):
    rows = [(None, "a", None), (5, "a", "s"), (5, "b", "s"), (6, "a ", "t"), (7, None, "t"), (8, prose(EN, 3, 200), "u"), (9, prose(EN, 4, 100), None)]
    d = clashing(spark, rows, "doc_id long, text string, source string")
    kept = exact_dedup.keep_documents(d)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == [5, 6, 7, 8, 9]
    mixed = mixing.training_order(d)
    plan = [r["copies"] * r["rows"] for r in mixing.decisions(d).collect()]
    assert mixed.columns == d.columns and mixed.count() == sum(plan)


def test_mixing_is_in_order_and_follows_given_tilts(spark):
    rows = [(i, prose(EN, i, 30 + i % 7), "ab"[i % 2]) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    tilts = {"a": 1.0, "b": -1.0}
    order = [r["source"] for r in mixing.training_order(d, tilts=tilts).collect()]
    half = len(order) // 2
    assert order[:half].count("a") / order.count("a") > 0.65 and order[:half].count("b") / order.count("b") < 0.4
    found = mixing.decisions(d, tilts=tilts).where("copies > 0").withColumn("at", mixing._position_of(F.lit(0)))
    first = {r["id"]: r["at"] for r in found.collect()}
    seen = [first[r["doc_id"]] for r in mixing.training_order(d, tilts=tilts).dropDuplicates(["doc_id"]).collect()]
    assert len(seen) == len(first)


def test_language_id_learns_every_language_and_rejects(spark):
    rng, rows = np.random.default_rng(1), []
    for k in range(120):
        letters = [chr(97 + c) for c in rng.permutation(26)[:7]]
        rows += [(1000 * k + i, " ".join("".join(letters[c] for c in rng.integers(0, 7, 5)) for _ in range(40)), f"l{k:03}") for i in range(4)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(set(model.labels)) == 120
    test = spark.createDataFrame([(i, t) for i, t, _ in rows[::7]] + [(-1, "зззз щщщщ " * 20), (-2, "1234")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_id.identify(test, model).collect()}
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang in rows[::7]]) > 0.95
    assert got[-1]["rejected"] and got[-2]["lang_pred"] == "und"
    # By brute force: the nearest centroid of each vector, by its definition.
    for i, text, _ in rows[:30:7]:
        for piece in language_id.tk.pieces(language_id.pa.array([text])):
            vector = model.vectors(piece)[0]
        assert got[i]["lang_pred"] == model.labels[int((model.centroids @ vector).argmax())] and got[i]["score"] == pytest.approx(float((model.centroids @ vector).max()), abs=1e-5)


def test_run_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    clean = [prose(EN, i, 70) for i in range(40)]
    texts = [*clean, clean[3], clean[3].replace(" ", "  "), clean[5] + " more", *(clean[7].replace("fox", f"fox{k}", 1) for k in range(3)), "short", None, "a b c " * 60, "%%% ".join(clean[9].split())]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    judged = {r["doc_id"] for r in quality.judge(d).where("kept").collect()}
    best = {}
    for i in judged:
        best.setdefault(re.sub(r"[\x20\x09-\x0D]", "", texts[i]), []).append(i)
    exact = {min(own, key=lambda i: (-len(texts[i]), i)) for own in best.values()}
    near = near_brute({i: texts[i] for i in exact}, 5, 80)
    kept = {i for i in exact if near[i][1] == i}
    # The mix, by its definition: each source in the order of its ids' digests, up to its target, three passes at most.
    import hashlib

    size = {i: len(texts[i].split()) for i in kept}
    sources = sorted({f"s{i % 3}" for i in kept})
    weight, whole = {s: k % 3 + 1 for k, s in enumerate(sources)}, {s: sum(size[i] for i in kept if f"s{i % 3}" == s) for s in sources}
    full: set = set()
    while True:
        rest = sum(whole.values()) - sum(3 * whole[s] for s in full)
        share = {s: weight[s] * rest / sum(weight[x] for x in sources if x not in full) for s in sources if s not in full}
        over = {s for s in share if share[s] > 3 * whole[s]}
        if not over:
            break
        full |= over
    target = {s: 3.0 * whole[s] if s in full else share[s] for s in sources}
    right = collections.Counter()
    for s in sources:
        at = 0
        for i in sorted((i for i in kept if f"s{i % 3}" == s), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i)):
            right[i] = sum(at + k * whole[s] + size[i] / 2 < target[s] for k in range(3))
            at += size[i]
    tokens = bpe.Tokenizer(bpe.default_spec())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter(r["doc_id"] for r in got) == +right
    for r in got:
        assert (bytes(r["ids"]), r["decoded"]) == tokens.encode_decode([texts[r["doc_id"]]])[0]
