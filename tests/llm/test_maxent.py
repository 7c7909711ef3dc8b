"""The score against the model's definition, word by word, and the sum of all words' probabilities."""

import collections
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from sievework.llm import maxent, textkernel

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["the cat sat on the mat .", "The dog sat on the log .", "the cat ran , the dog ran .", None, "", "one", "der hund lief zum haus .", "der kater lief zum hof .", "the cat sat on the log .", "x " * 40] * 3


def words(text):
    return [*WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")), None]


def hash_of(word):
    if word is None:
        return int(maxent.END)
    piece = next(textkernel.pieces(pa.array([word])))
    return int(piece.hashes(*(x[:1] for x in piece.words()[:2]))[0])


def leaf_of(word):
    if word is None:
        return 0
    data = b" " + word.encode()
    sums = np.zeros(8)
    for a, b in zip(data, data[1:], strict=False):
        sums += maxent.PLANES[((a << 8 | b) * 0x9E3779B1 & 0xFFFFFFFF) >> 26]
    return sum(1 << k for k in range(8) if sums[k] > 0)


M = (1 << 64) - 1


def mix(x):
    return int(textkernel.mix(np.array([x & M], np.uint64))[0])


def shares(values, features, bias, outputs):
    x = [sum(values[f * outputs + k] for f in [*features, maxent.ROWS + bias]) for k in range(outputs)]
    top = max(x)
    e = [math.exp(v - top) for v in x]
    return [v / sum(e) for v in e]


def probability(model, one, two, leaf, skip, target):
    """P(leaf of the target | history) by the definition: hashed features, two softmaxes."""
    history = [mix(one), mix(two + 7), mix(leaf * 512 + skip + 0x77770000)]
    w, p = (1 << maxent.WORD_BITS) - 1, (1 << maxent.PAIR_BITS) - 1
    place = lambda h: [h[0] & w, (h[1] & w) + (1 << maxent.WORD_BITS), (h[2] & p) + (2 << maxent.WORD_BITS)]
    cut, cls = (maxent.ROWS + 1) * maxent.CLASSES, target // maxent.LEAVES
    salt = (cls + 1) * 0x9E3779B97F4A7C15 & M
    own = [((x ^ salt ^ (x >> 29)) * 0xBF58476D1CE4E5B9 & M) >> 20 for x in history]
    return shares(model.values[:cut], place(history), 0, maxent.CLASSES)[cls] * shares(model.values[cut:], place(own), cls, maxent.LEAVES)[target % maxent.LEAVES]


@pytest.fixture(scope="module")
def trained(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    return d, *maxent.train(d)


def test_score_against_the_definition(trained):
    d, model, table = trained
    count = collections.Counter(w for t in TEXTS for w in words(t))
    size, kinds = collections.Counter(), collections.Counter()
    for w, n in count.items():
        size[leaf_of(w)] += n
        kinds[leaf_of(w)] += 1
    assert {hash_of(w): (leaf_of(w), n) for w, n in count.items()} == {r["word"] & M: (r["leaf"], r["n"]) for r in table.collect()}
    more = d.sparkSession.createDataFrame([(100, "the bird sat on zzzyx ."), (101, "the")], d.schema)
    every = {**dict(enumerate(TEXTS)), 100: "the bird sat on zzzyx .", 101: "the"}
    for r in maxent.score(d.unionAll(more), model, table).collect():
        own = words(every[r["doc_id"]])
        past, at = [int(maxent.BEFORE), int(maxent.BEGIN)], [257, 256]
        total = 0.0
        for w in own:
            leaf = leaf_of(w)
            total += math.log10(probability(model, past[-1], past[-2], at[-1], at[-2], leaf)) + math.log10((count[w] + 0.1) / (size[leaf] + 0.1 * (kinds[leaf] + 1)))
            past.append(hash_of(w))
            at.append(leaf)
        assert r["score"] == pytest.approx(total, rel=1e-4), every[r["doc_id"]]


def test_all_words_together_have_probability_one(trained):
    _, model, table = trained
    seen = [(r["leaf"], r["n"]) for r in table.collect()]
    for one, two, leaf, skip in ((int(maxent.BEGIN), int(maxent.BEFORE), 256, 257), (hash_of("the"), hash_of("on"), leaf_of("the"), leaf_of("on")), (5, 6, 7, 8)):
        of = [probability(model, one, two, leaf, skip, k) for k in range(256)]
        total = sum(of[k] * (n + 0.1) / 10 ** model.leaf_total[k] for k, n in seen) + sum(of[k] * 0.1 / 10 ** model.leaf_total[k] for k in range(256))
        assert total == pytest.approx(1, abs=1e-5)


def test_learns_from_the_history(trained):
    d, model, table = trained
    found = maxent.score(d, model, table).agg({"score": "sum", "base_score": "sum"}).first()
    assert found["sum(score)"] > found["sum(base_score)"]


def test_weights_are_averaged_by_tokens(spark):
    parts = [np.array([1, 2], np.float32), np.array([3, 6], np.float32)]
    parts = [p.astype(np.float16) for p in parts]
    rows = [(0, -1, 10, parts[0].tobytes()), (0, -1, 30, parts[1].tobytes()), (1, -1, 40, parts[0].tobytes()), (5, 3, 2, None)]
    d = spark.createDataFrame([(a, b, c, bytearray(x) if x else None) for a, b, c, x in rows], "word long, leaf int, n long, weights binary").repartition(4)
    assert maxent._averaged(d).tolist() == [2.5, 5.0, 1.0, 2.0]
