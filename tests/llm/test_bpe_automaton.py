"""The compiled automaton of small merge lists against merging by rank, over all short words."""

import itertools

import numpy as np
import pytest
from sievework.llm import bpe

LISTS = [
    ["a a", "aa a", "aa aa"],
    ["a b", "b a", "ab a", "a ba", "ab ab"],
    ["a b", "ab b", "b b", "abb b", "b a", "bb ab", "a a"],
    ["b c", "a bc", "a b", "ab c", "c a", "abc abc", "c c", "cc a"],
    ["a b</w>", "b a", "ba b</w>", "a a", "aa b</w>", "b b", "bb</w> b"],
]


def merged(word, ranks):
    parts = [*word[:-1], word[-1] + bpe.END]
    while True:
        best = min((ranks[p], i) for i, p in enumerate(itertools.pairwise(parts)) if p in ranks) if any(p in ranks for p in itertools.pairwise(parts)) else None
        if best is None:
            return parts
        out, i = [], 0
        pair = next(p for p, r in ranks.items() if r == best[0])
        while i < len(parts):
            if tuple(parts[i : i + 2]) == pair:
                out.append(parts[i] + parts[i + 1])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out


def automaton(merges):
    vocab = {x + e: None for x in "abc" for e in ("", bpe.END)}
    pairs = [tuple(m.split()) for m in merges]
    pairs = [p for p in pairs if not p[0].endswith(bpe.END)]
    for u, v in pairs:
        vocab.setdefault(u + v)
    return bpe.MergeAutomaton({label: i for i, label in enumerate(vocab)}, pairs), {p: r for r, p in enumerate(pairs)}


@pytest.mark.parametrize("merges", LISTS)
def test_all_words(merges):
    own, ranks = automaton(merges)
    words = {"".join(w) for n in range(1, 9) for w in itertools.product("ab" if n > 6 else "abc", repeat=n)}
    for word, path in own.paths(words).items():
        assert [own.labels[i] for i in path] == merged(word, ranks), word


@pytest.mark.parametrize("merges", LISTS)
def test_arcs_are_the_pairs_that_stay_apart(merges):
    """A token may end the word after another if and only if merging both tokens' letters gives them back."""
    own, ranks = automaton(merges)
    for t, y in itertools.product(range(len(own.labels)), repeat=2):
        a, b = own.labels[t], own.labels[y]
        if own.reachable[t] and own.reachable[y] and not a.endswith(bpe.END) and b.endswith(bpe.END):
            assert own.step(t, y) == (merged(a + b.removesuffix(bpe.END), ranks) == [a, b]), (a, b)


def test_long_words_of_one_letter():
    own, ranks = automaton(LISTS[0])
    rng = np.random.default_rng(0)
    words = {"a" * int(n) for n in rng.integers(1, 400, 30)}
    for word, path in own.paths(words).items():
        assert [own.labels[i] for i in path] == merged(word, ranks)
