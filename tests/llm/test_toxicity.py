"""The string kernel against its definition, and what is found of insults that were tampered with."""

import collections
import itertools

import numpy as np
import pytest
from sievework.llm import toxicity

INSULTS = ["blockhead", "nitwit", "dimwit", "scoundrel", "numbskull"]
WORDS = "the quick brown fox jumps over a lazy dog while seven bright rivers run down to the sea and nobody minds at all today heading wit blocks county under dims".split()


def weights(word):
    """The weight of each subsequence of ORDER letters: LAMBDA to the letters it spans, summed over its places."""
    out = collections.Counter()
    for places in itertools.combinations(range(len(word)), toxicity.ORDER):
        out[tuple(word[i] for i in places)] += toxicity.LAMBDA ** (places[-1] - places[0] + 1)
    return out


def test_kernel_against_its_definition():
    words = [b"idiot", b"idxiot", b"moron", b"oronmo", b"nitwit", b"nitnitwit", b"ab", b"mississippi"]
    data, starts, ends = toxicity._letters(words)
    letters = toxicity._padded(data, starts, ends, int((ends - starts).max()))
    for i, j in itertools.product(range(len(words)), repeat=2):
        a, b = weights(b" " + words[i] + b" "), weights(b" " + words[j] + b" ")
        right = sum(n * b[s] for s, n in a.items())
        assert toxicity._full(letters[i : i + 1], letters[j : j + 1])[0] == pytest.approx(right, rel=1e-4, abs=1e-6), (words[i], words[j])


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return [WORDS[i] for i in rng.integers(0, len(WORDS), n)]


@pytest.fixture(scope="module")
def model(spark):
    rng, rows, labels = np.random.default_rng(3), [], []
    for i in range(400):
        words = prose(i, 40)
        if i % 4 == 0:
            words.insert(int(rng.integers(0, 40)), INSULTS[i // 4 % len(INSULTS)])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    return toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))


def found(spark, model, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["score"] >= toxicity.THRESHOLD for r in sorted(toxicity.scored(d, model).collect(), key=lambda r: r["doc_id"])]


def tampered(word, kind, rng):
    at = int(rng.integers(1, len(word)))
    return {"plain": word, "inserted": word[:at] + chr(97 + int(rng.integers(0, 26))) + word[at:], "doubled": word[:at] + word[at - 1] + word[at:], "dotted": ".".join(word), "spaced": " ".join(word), "marked": word[:at] + "*" + word[at:] + "!!"}[kind]


@pytest.mark.parametrize("kind", ["plain", "inserted", "doubled", "dotted", "spaced", "marked"])
def test_tampered_insults(spark, model, kind):
    rng, texts = np.random.default_rng(11), []
    for i in range(100):
        words = prose(5000 + i, 60)
        words.insert(int(rng.integers(0, 60)), tampered(INSULTS[i % len(INSULTS)], kind, rng))
        texts.append(" ".join(words))
    assert sum(found(spark, model, texts)) >= 90
    clean = [" ".join(prose(9000 + i, 60)) for i in range(100)]
    assert sum(found(spark, model, clean)) <= 2


def test_long_words_repeats_and_ties(spark, model):
    text = " ".join([*prose(1, 20), "nitwit", *prose(2, 20)])
    long = "x" * 30_000 + " " + "nitwit" * 40 + " " + text
    assert found(spark, model, [text, text, long, "nitwit", "x" * 30_000]) == [True, True, True, True, False]
    assert len(found(spark, model, ["nitwit" * 5000])) == 1
