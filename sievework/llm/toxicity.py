"""Toxicity by a support vector machine over a subsequence string kernel with Nystrom landmarks.

The kernel of two words sums, over the subsequences of `ORDER` letters that both have, LAMBDA to the power of the letters
that they span in both, scaled by what each word has with itself. For each landmark it counts as 0 to 1 from a floor to
what the landmark keeps with one letter inserted anywhere, so such a word is as near as the landmark's own form, and two
letters take a little off. The floor lies above the words of clean documents, where these stay below that form. A word
has the gap before and after it as letters. Only words whose kernel over three-letter subsequences within five letters
reaches `NEAR` are compared in full. Marks between letters are left out first, and
letters that stand apart ("i d i o t") are joined. A word of more than `LONG` letters counts as its overlapping parts, and a longer
word's beginnings of `BEGINNINGS` bytes count as words too (and are landmarks where several words share them), so that
a stem is found with any ending. A sentence's kernel with a landmark is its best word's.

Landmarks are words that documents labelled toxic hold much oftener than others, more than chance explains among so many words,
unlike each other; copies and near copies of a document count once. The sentences'
kernels with them, whitened by the landmarks' own kernel matrix (Nystrom), are the features of a linear support vector
machine. It learns first from whole documents, then from sentences: those of clean documents, those of toxic documents
that the first machine finds or that hold a landmark no clean document holds, and such landmarks with letters inserted. A document scores as its worst sentence, and a
little higher the more of its sentences are toxic, mapped to a probability by a logistic curve.

Labelled rows: at most `SAMPLE` toxic and as many clean documents, by a hash of their ids. Scoring covers every
text, whole. An upper bound on the kernel, one number for each subsequence, leaves the full kernel to few words.

Defined cases: a null, empty or wordless text scores as a document without any landmark; a null label is no label;
without toxic or without clean labels every score is the share of toxic ones; an id labelled more than once counts for
each label; repeated rows are scored each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .shared import fold, read, small_batches, tidy

SAMPLE, LANDMARKS, CANDIDATES = 1500, 160, 300
LAMBDA, SPAN, NEAR, BITS = 0.7, 5, 0.45, 15
#: Letters of a subsequence; the least floor, as a share of what one inserted letter leaves.
ORDER, FLOOR = 5, 0.65
THRESHOLD, CLOSE = 0.3, 0.005
#: A landmark is in so many toxic documents of the sample, and so large a share of them, at least.
LEAST, LEAST_SHARE = 4, 0.005
#: Landmarks that chance alone would give, at most on average.
CHANCE = 1.0
#: Weights of the number of toxic sentences that are tried.
MORE = (0.0, 0.1, 0.25, 0.5, 1.0)
#: Groups of landmarks that have a bound of their own.
GROUPS = 24
#: Pairs of least hashes by which copies are known.
BANDS = 3
#: Bytes of the beginnings of words that count as words too, and the letter that ends them, so that they are unlike short
#: words.
BEGINNINGS, CUT = (5, 7), 1
#: Documents that hold a beginning, for each that holds the most frequent word with it, at least.
SEVERAL = 1.2
#: Letters of the longest word that is taken whole (even); landmarks are shorter.
LONG = 64
#: Words that a worker remembers as far from all landmarks, before it starts anew.
FAR = 500_000
#: And as close to one.
CLOSE_WORDS = 200_000
#: Places of the second and third letter after the first.
PAIRS = [(j, k) for j in range(1, SPAN - 1) for k in range(j + 1, SPAN)]
_KEPT = np.zeros(256, bool)
_KEPT[[*range(48, 58), *range(97, 123), *range(128, 256), 9, 10, 11, 12, 13, 32]] = True
_CLOSES = np.zeros(256, bool)
_CLOSES[[10, 33, 46, 63]] = True


def _norm(length: np.ndarray) -> np.ndarray:
    total = np.zeros(len(length))
    for _, k in PAIRS:
        total += np.maximum(length - k, 0) * LAMBDA ** (2 * (k - 2))
    return np.sqrt(np.maximum(total, 1e-9))


def _codes(data: np.ndarray, j: int, k: int) -> np.ndarray:
    """Bucket of each subsequence that begins at a byte; data has SPAN bytes to spare."""
    n = len(data) - SPAN
    code = data[:n].astype(np.uint32) | data[j : n + j].astype(np.uint32) << 8 | data[k : n + k].astype(np.uint32) << 16
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


class Words:
    """The words of a piece without marks, with their sentences and texts."""

    def __init__(self, piece: tk.Texts):
        low = piece.lowered().data
        at = np.flatnonzero(_KEPT[low])
        data = low[at]
        starts, ends = self._bounds(data)
        single = ends - starts == 1
        joined = single[1:] & single[:-1] & (starts[1:] - ends[:-1] == 1) & (data[ends[:-1]] == 32) if len(starts) else single[1:]
        if joined.any():
            keep = np.ones(len(data), bool)
            keep[ends[:-1][joined]] = False
            at, data = at[keep], data[keep]
            starts, ends = self._bounds(data)
        closes = np.cumsum(_CLOSES[piece.data])
        data = np.concatenate(([32], data, np.full(SPAN + 1, 32))).astype(np.uint8)
        data[~tk._IS_WORD[data]] = 32
        places = at[starts] if len(starts) else starts
        texts = piece.text_of(places)
        #: A sentence number grows from text to text, since a line feed ends each text.
        sentences = closes[places] if len(places) else places
        # Spans with the gap on either side; a long word counts as its overlapping parts.
        ends = ends + 2
        parts = np.maximum(-(-(ends - starts - LONG) // (LONG // 2)), 0) + 1
        word = np.repeat(np.arange(len(starts)), parts)
        self.data, self.texts, self.sentences = data, texts[word], sentences[word]
        self.starts = starts[word] + (np.arange(len(word)) - np.repeat(np.cumsum(parts) - parts, parts)) * (LONG // 2)
        self.ends = np.minimum(self.starts + LONG, ends[word])
        self._begun(starts, ends, texts, sentences)

    def _begun(self, starts: np.ndarray, ends: np.ndarray, texts: np.ndarray, sentences: np.ndarray) -> None:
        """The beginnings of longer words as words of their own, behind the text: an insult that takes endings."""
        data, items = [self.data[:-SPAN]], [(self.starts, self.ends, self.texts, self.sentences)]
        at = len(data[0])
        for n in BEGINNINGS:
            long = np.flatnonzero(ends - starts - 2 > n)
            # No letter is cut in two.
            long = long[(self.data[starts[long] + n + 1] & 0xC0) != 0x80]
            letters = np.concatenate((self.data[starts[long, None] + np.arange(1, n + 1)], np.full((len(long), 2), [CUT, 32], np.uint8)), 1)
            # A gap belongs to the words on both its sides.
            data.append(letters.ravel())
            first = at - 1 + (n + 2) * np.arange(len(long))
            items.append((first, first + n + 3, texts[long], sentences[long]))
            at += letters.size
        self.data = np.concatenate([*data, np.full(SPAN, 32, np.uint8)])
        self.starts, self.ends, self.texts, self.sentences = (np.concatenate(x) for x in zip(*items, strict=True))

    @staticmethod
    def _bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = tk._IS_WORD[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        return edges[0::2], edges[1::2]

    def string(self, i: int) -> bytes:
        return self.data[self.starts[i] + 1 : self.ends[i] - 1].tobytes()


def _letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(w) for w in words], np.int64) + 2
    ends = np.cumsum(sizes - 1) + 1
    return np.frombuffer(b" " + b" ".join(words) + b" " * (SPAN + 1), np.uint8), ends - sizes, ends


def _padded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """Words as rows of `width` letters, padded with zeros."""
    at = starts[:, None] + np.arange(width)
    return np.where(at < ends[:, None], data[np.minimum(at, len(data) - 1)], 0)


def _full(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The gap-weighted kernel of ORDER-letter subsequences for each row's two words, by dynamic programming over their
    letters: ways[:, j] is the weight of the subsequences so far that end before two's letter j, decayed to it."""
    n, a, b = len(one), one.shape[1], two.shape[1]
    same = (one[:, :, None] == two[:, None, :]) & (one > 0)[:, :, None]
    same = np.ascontiguousarray(same.transpose(1, 2, 0)).astype(np.float32) * np.float32(LAMBDA * LAMBDA)
    ends = same.copy()
    for _ in range(ORDER - 1):
        ways, new = np.zeros((b + 1, n), np.float32), np.empty_like(ends)
        for i in range(a):
            new[i] = same[i] * ways[:b]
            line = np.zeros(n, np.float32)
            ways *= np.float32(LAMBDA)
            for j in range(b):
                ways[j] += line
                line = np.float32(LAMBDA) * line + ends[i, j]
            ways[b] += line
        ends = new
    return ends.sum((0, 1))


@dataclass
class Landmarks:
    words: list[bytes]

    def __post_init__(self):
        data, starts, ends = _letters(self.words)
        table = np.zeros((1 << BITS, len(self.words)), np.float32)
        norm = _norm(ends - starts)
        for j, k in PAIRS:
            code = _codes(data, j, k)
            for m, (lo, hi) in enumerate(zip(starts, ends, strict=True)):
                for i in range(lo, hi - k):
                    table[code[i], m] += LAMBDA ** (k - 2) / norm[m]
        self.table = table
        self.letters = _padded(data, starts, ends, int((ends - starts).max(initial=0)))
        self.alone = _full(self.letters, self.letters) if self.words else np.zeros(0)
        # Each landmark with a letter of no word inserted at each place.
        forms = [(m, w[:at] + b"\2" + w[at:]) for m, w in enumerate(self.words) for at in range(1, len(w))]
        self.top = np.ones(len(self.words), np.float32)
        if forms:
            mark, spans = np.array([m for m, _ in forms]), _letters([w for _, w in forms])
            letters = _padded(*spans, int((spans[2] - spans[1]).max()))
            left = np.concatenate([_full(letters[k : k + 1024], self.letters[mark[k : k + 1024]]) / np.sqrt(_full(letters[k : k + 1024], letters[k : k + 1024]) * self.alone[mark[k : k + 1024]]) for k in range(0, len(mark), 1024)])
            np.minimum.at(self.top, mark, left.astype(np.float32))
        self.alike = self.kernel(data, starts, ends) if self.words else np.zeros((0, 0), np.float32)
        self.tuned(FLOOR * self.top)
        own = self.scaled(self.alike)
        # Landmarks alike form a group; the largest weight in a group bounds each of its kernels.
        leaders: list[int] = []
        group = np.zeros(len(self.words), np.int64)
        for m in range(len(self.words)):
            close = [g for g, lead in enumerate(leaders) if own[m, lead] > 0.1]
            if not close and len(leaders) < GROUPS:
                leaders.append(m)
            group[m] = close[0] if close else len(leaders) - 1 if leaders[-1] == m else m % GROUPS
        bound = lambda of, n: np.stack([table[:, of == g].max(1) for g in range(n) if (of == g).any()], 1) if leaders else np.zeros((1 << BITS, 0), np.float32)
        self.bounds = (bound(group // 4, GROUPS), bound(group, GROUPS))
        #: Hashes of words known to be far from every landmark, by this worker.
        self.far: set[int] = set()
        #: And where the kernels of those that aren't stand.
        self.close: dict[int, int] = {}
        self.kernels = np.zeros((1024, len(self.words)), np.float16)

    def tuned(self, floor: np.ndarray) -> None:
        self.floor = floor
        own = self.scaled(self.alike)
        values, vectors = np.linalg.eigh((own + own.T) / 2 + 0.05 * np.eye(len(own))) if self.words else (np.zeros(0), own)
        self.whiten = ((vectors / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T).astype(np.float32)

    def scaled(self, kernels: np.ndarray) -> np.ndarray:
        """Kernels from each landmark's floor to what one inserted letter leaves of it, as 0 to 1."""
        return np.clip((kernels - self.floor) / (self.top - self.floor), 0, 1)

    @staticmethod
    def _sums(table: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each word the sum of its subsequences' rows of the table, scaled by the word's length."""
        out = np.zeros((len(starts), table.shape[1]), np.float32)
        step = max(256, 160_000 // max(table.shape[1], 16))
        for lo in range(0, len(starts), step):
            some = slice(lo, lo + step)
            size = ends[some] - starts[some]
            word = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
            at, left = starts[some][word] + place, size[word] - place
            total = np.zeros((len(word), table.shape[1]), np.float32)
            for j, k in PAIRS:
                use = np.flatnonzero(left > k)
                if len(use):
                    first = at[use]
                    code = (data[first].astype(np.uint32) | data[first + j].astype(np.uint32) << 8 | data[first + k].astype(np.uint32) << 16) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)
                    total[use] += table[code] * np.float32(LAMBDA ** (k - 2))
            out[some] = np.add.reduceat(total, np.cumsum(size) - size) / _norm(size)[:, None]
        return out

    def kernel(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Kernel of each word with each landmark that it is near to; 0 for others."""
        out = np.zeros((len(starts), len(self.words)), np.float32)
        for lo in range(0, len(starts), 8192):
            some = slice(lo, lo + 8192)
            word, mark = np.nonzero(self._sums(self.table, data, starts[some], ends[some]) >= NEAR)
            size = (ends - starts)[some]
            different = np.unique(word)
            # Words of like lengths together: a long one would widen all.
            for least, most in itertools.pairwise((0, 10, 14, 20, 32, LONG)):
                own = different[(size[different] > least) & (size[different] <= most)]
                if not len(own):
                    continue
                letters = _padded(data, starts[some][own], ends[some][own], int(size[own].max()))
                step = max(16, 2_000_000 // (letters.shape[1] * max(letters.shape[1], self.letters.shape[1])))
                alone = np.concatenate([_full(letters[k : k + step], letters[k : k + step]) for k in range(0, len(own), step)])
                at = np.flatnonzero(np.isin(word, own))
                row = np.searchsorted(own, word[at])
                for k in range(0, len(at), step):
                    part, r = at[k : k + step], row[k : k + step]
                    found = _full(letters[r], self.letters[mark[part]]) / np.sqrt(np.maximum(alone[r] * self.alone[mark[part]], 1e-30))
                    out[lo + word[part], mark[part]] = found
        return out

    def near(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of the words that may be near some landmark, by bounds ever closer."""
        found = np.arange(len(starts))
        for table in self.bounds:
            if len(found):
                found = found[self._sums(table, data, starts[found], ends[found]).max(1) >= NEAR]
        return found


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 1000.0) -> np.ndarray:
    """A linear support vector machine with squared hinge by Newton steps over its active rows; the last weight is the
    bias."""
    x = np.concatenate((x, np.ones((len(x), 1))), 1).astype(np.float32)
    sign = np.where(y, 1.0, -1.0)
    weight = 2 * cost * weight / weight.sum()
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    now, active = np.zeros(x.shape[1]), np.ones(len(x), bool)
    for _ in range(60):
        own = x[active]
        new = np.linalg.solve(ridge + (own * weight[active][:, None].astype(np.float32)).T @ own, own.T @ (weight * sign)[active])
        now = new if _ < 20 else (now + new) / 2
        wrong = sign * (x @ now.astype(np.float32)) < 1
        if (wrong == active).all():
            break
        active = wrong
    return now


def _f1(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows by falling score, and F1 where the cut lies behind each."""
    order = np.argsort(-score, kind="stable")
    hit, miss = np.cumsum((weight * y)[order]), np.cumsum((weight * ~y)[order])
    f1 = 2 * hit / (hit + miss + (weight * y).sum())
    # No cut lies between equal scores.
    ties = np.append(np.diff(score[order]) == 0, False)
    return order, np.where(ties, 0.0, f1)


def _best_f1(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    return float(_f1(score, y, weight)[1].max())


def _curve(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """A logistic curve through scores, by Newton steps on a slightly smoothed likelihood."""
    a, b = 1.0, 0.0
    target = np.where(y, 0.99, 0.01)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -30, 30)))
        g = weight * (p - target)
        h = weight * np.maximum(p * (1 - p), 1e-6)
        grad = np.array([(g * score).sum() + 1e-3 * a, g.sum()])
        hess = np.array([[(h * score * score).sum() + 1e-3, (h * score).sum()], [(h * score).sum(), h.sum() + 1e-6]])
        da, db = np.linalg.solve(hess, grad)
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -2, 2)
    # The curve's slope stays; it passes THRESHOLD below the least score whose F1 is the best or close to it, since a tampered
    # insult that stands alone scores lower than most toxic documents of the sample.
    order, f1 = _f1(score, y, weight)
    good = np.flatnonzero(f1 >= f1.max() - CLOSE)
    cut = float(score[order][good[-1]])
    below = score[score < cut]
    cut = (cut + float(below.max())) / 2 if len(below) else cut
    a = max(float(a), 2.0)
    return a, float(np.log(THRESHOLD / (1 - THRESHOLD))) - a * cut


@dataclass
class Model:
    landmarks: Landmarks
    weights: np.ndarray
    curve: tuple[float, float]
    #: What the logarithm of the number of toxic sentences adds.
    more: float = 0.0

    def sentences(self, piece: tk.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Kernels (not scaled) of the sentences that are near a landmark, and their texts."""
        words = Words(piece)
        if not len(words.starts) or not self.landmarks.words:
            return np.zeros((0, len(self.landmarks.words))), np.zeros(0, np.int64)
        spans = tk.Texts(words.data, np.array([len(words.data) - 1]), 0).hashes(words.starts, words.ends)
        # Each different word once.
        different, first, which = np.unique(spans, return_index=True, return_inverse=True)
        marks = self.landmarks
        names = different.tolist()
        if len(marks.far) > FAR:
            marks.far.clear()
        if len(marks.close) > CLOSE_WORDS // 2:
            marks.close.clear()
        new = np.array([i for i, h in enumerate(names) if h not in marks.far and h not in marks.close], np.int64)
        found = new[marks.near(words.data, words.starts[first[new]], words.ends[first[new]])]
        marks.far.update(np.setdiff1d(different[new], different[found]).tolist())
        base = len(marks.close)
        marks.close.update((names[i], base + k) for k, i in enumerate(found.tolist()))
        if base + len(found) > len(marks.kernels):
            marks.kernels = np.concatenate((marks.kernels, np.zeros((base + 2 * len(found), marks.kernels.shape[1]), np.float16)))
        marks.kernels[base : base + len(found)] = marks.kernel(words.data, words.starts[first[found]], words.ends[first[found]])
        row = np.array([marks.close.get(h, -1) for h in names])
        near = np.flatnonzero(row[which] >= 0)
        near = near[np.argsort(words.sentences[near], kind="stable")]
        if not len(near):
            return np.zeros((0, len(self.landmarks.words))), near
        kernels = marks.kernels[row[which[near]]]
        sentence = words.sentences[near]
        cuts = np.flatnonzero(np.concatenate(([True], sentence[1:] != sentence[:-1])))
        return np.maximum.reduceat(kernels, cuts).astype(np.float32), words.texts[near][cuts]

    def decide(self, kernels: np.ndarray) -> np.ndarray:
        """Of scaled kernels."""
        return kernels @ (self.landmarks.whiten @ self.weights[:-1]) + self.weights[-1]

    def raw(self, piece: tk.Texts) -> np.ndarray:
        worst, count = self.worst(piece)
        return worst + self.more * np.log1p(count)

    def worst(self, piece: tk.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Of each text its worst sentence's decision, and the number of its sentences that are toxic by theirs."""
        out, count = np.full(piece.n, self.weights[-1]), np.zeros(piece.n)
        kernels, texts = self.sentences(piece)
        if len(texts):
            decided = self.decide(self.landmarks.scaled(kernels))
            np.maximum.at(out, texts, decided)
            np.add.at(count, texts, decided > 0)
        return out, count

    def score(self, piece: tk.Texts) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * self.raw(piece) + b, -500, 500)))


def _uneven(bad: int, good: int, share: float) -> float:
    """How unlikely it is that so many of a word's documents are toxic, where a share of all is: the bound by Chernoff on the
    negative logarithm of its chance."""
    n, own = bad + good, bad / (bad + good)
    if own <= share:
        return 0.0
    return n * (own * np.log(own / share) + ((1 - own) * np.log((1 - own) / (1 - share)) if own < 1 else 0.0))


def _groups(texts: list[str]) -> np.ndarray:
    """A number for each text, the same for copies and near copies: those whose least hashes of three-word shingles agree
    in two places of one of `BANDS` pairs."""
    first: dict[tuple, int] = {}
    out = np.arange(len(texts))
    for i, text in enumerate(texts):
        words = text.lower().encode().split()
        shingles = np.array([zlib.crc32(b" ".join(words[k : k + 3])) for k in range(max(1, len(words) - 2))], np.uint64)
        least = [int(((shingles * np.uint64(2 * k + 1) + np.uint64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(20)).min()) for k in range(2 * BANDS)]
        keys = [(k, least[2 * k], least[2 * k + 1]) for k in range(BANDS)]
        met = [out[first[key]] for key in keys if key in first]
        out[i] = min(met, default=i)
        for key in keys:
            first.setdefault(key, i)
    return out


def _chosen(pieces: list[tk.Texts], toxic: np.ndarray, groups: np.ndarray) -> Landmarks:
    """Words that tell toxic documents from others, best first, each unlike those before. Copies count once."""
    n1, n0 = max(len(np.unique(groups[toxic])), 1), max(len(np.unique(groups[~toxic])), 1)
    least = max(LEAST, LEAST_SHARE * n1)

    def holding(label: bool, only: set[bytes] | None) -> Counter:
        """Documents of the label that hold each word."""
        out: Counter = Counter()
        seen = np.zeros(0, np.uint64)
        for piece in pieces:
            words = Words(piece)
            use = np.flatnonzero((toxic[piece.first + words.texts] == label) & (words.ends - words.starts >= 5) & (words.ends - words.starts <= 42))
            # Once for each group of texts and word: in this piece, then over pieces.
            spans = tk.Texts(words.data, np.array([len(words.data) - 1]), 0).hashes(words.starts[use], words.ends[use])
            keys, first = np.unique(spans + groups[piece.first + words.texts[use]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True)
            new = ~np.isin(keys, seen)
            seen = np.union1d(seen, keys[new])
            out.update(w for w in map(words.string, use[first[new]]) if only is None or w in only)
        return out

    every = holding(True, None)
    bad = {w: c for w, c in every.items() if c >= least}
    good = holding(False, set(bad))
    value = {w: (np.log((c + 0.2) / n1) - np.log((good[w] + 0.2) / n0)) * np.sqrt(c) for w, c in bad.items()}
    # Of all these words, one at most is expected to be so uneven by chance.
    share, most = n1 / (n1 + n0), np.log(max(len(every), 1) / CHANCE)
    # A beginning says more than the words only where several of them begin so.
    largest: Counter = Counter()
    for w, c in bad.items():
        for n in BEGINNINGS:
            largest[w[:n]] = max(largest[w[:n]], c if w[-1] != CUT else 0)
    value = {w: v for w, v in value.items() if w[-1] != CUT or bad[w] > SEVERAL * largest[w[:-1]]}
    best = sorted((w for w in value if value[w] > 0 and _uneven(bad[w], good[w], share) > most), key=lambda w: (-round(value[w], 9), -len(w), w))[:CANDIDATES]
    chosen: list[bytes] = []
    if best:
        alike = Landmarks(best)
        taken = np.zeros(len(best), bool)
        far = np.ones(len(best), bool)
        for i in range(len(best)):
            if far[i] and len(chosen) < LANDMARKS:
                chosen.append(best[i])
                taken[i] = True
                far &= alike.scaled(alike.alike[i]) < 0.9
    return Landmarks(chosen)


def _inserted(word: bytes, rng: np.random.Generator) -> bytes:
    at, extra = int(rng.integers(1, len(word))), bytes([int(rng.integers(97, 123))])
    return word[:at] + (word[at - 1 : at] if rng.random() < 0.3 else extra) + word[at:]


def fit(texts: list[str], toxic: np.ndarray, prior: float) -> Model:
    """Learns from labelled texts. prior: the share of toxic ones among all labelled rows."""
    none = Model(Landmarks([]), np.zeros(1), (0.0, float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))))
    if not toxic.any() or toxic.all():
        return none
    pieces = list(tk.pieces(pa.array(texts, pa.string())))
    landmarks = _chosen(pieces, toxic, _groups(texts))
    if not landmarks.words:
        return none
    weigh = lambda y: np.where(y, prior / max(y.sum(), 1), (1 - prior) / max((~y).sum(), 1))
    model = Model(landmarks, np.zeros(len(landmarks.words) + 1), (1.0, 0.0))
    found = []
    for piece in pieces:
        kernels, owner = model.sentences(piece)
        found.append((kernels, owner + piece.first))
    kernels, owner = np.concatenate([k for k, _ in found]), np.concatenate([t for _, t in found])
    del found
    # Floors above the clean documents' words, where one inserted letter leaves more than these have.
    bad = toxic[owner]
    clean = kernels[~bad].max(0) if (~bad).any() else np.zeros(len(landmarks.words))
    landmarks.tuned(np.where(clean < 0.98 * landmarks.top, np.maximum(FLOOR * landmarks.top, clean), FLOOR * landmarks.top))
    kernels = landmarks.scaled(kernels)
    # Sentences far from every landmark look like the empty one, which is added below.
    some = kernels.max(1) >= 0.1 if len(kernels) else np.zeros(0, bool)
    kernels, owner, bad = kernels[some], owner[some], bad[some]
    whole = np.zeros((len(texts), len(landmarks.words)), np.float32)
    np.maximum.at(whole, owner, kernels)
    even = lambda y: np.where(y, 0.5 / max(y.sum(), 1), 0.5 / max((~y).sum(), 1))
    model.weights = _machine(whole @ landmarks.whiten, toxic, even(toxic))
    clean = kernels[~bad].max(0) if (~bad).any() else np.zeros(len(landmarks.words))
    sure = clean < 0.999
    use = ~bad | (model.decide(kernels) > 0) | (kernels[:, sure] >= 0.999).any(1)
    rng = np.random.default_rng(7)
    spoilt = [(i, _inserted(landmarks.words[i], rng)) for i in np.flatnonzero(sure) if len(landmarks.words[i]) >= 4 for _ in range(8)]
    extra = landmarks.scaled(landmarks.kernel(*_letters([w for _, w in spoilt]))) if spoilt else np.zeros((0, len(landmarks.words)))
    # Where clean sentences hold words as near to a landmark, its altered forms don't teach anything.
    extra = extra[[k for k, (i, _) in enumerate(spoilt) if extra[k, i] > clean[i] + 0.02]] if spoilt else extra
    x = np.concatenate((kernels[use], extra, np.zeros((1, len(landmarks.words)))))
    y = np.concatenate((bad[use], np.ones(len(extra), bool), [False]))
    model.weights = _machine(x @ landmarks.whiten, y, even(y))
    worst, count = (np.concatenate(x) for x in zip(*map(model.worst, pieces), strict=True))
    weight = weigh(toxic) * len(toxic)
    # The least of the weights of the count that divide best.
    model.more = max(MORE, key=lambda m: (round(_best_f1(worst + m * np.log1p(count), toxic, weight), 3), -m))
    model.curve = _curve(worst + model.more * np.log1p(count), toxic, weight)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits on the bounded sample of labelled rows."""
    marked = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) == 1).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chance = F.pmod(F.xxhash64("id", F.lit("toxicity sample")), F.lit(1 << 40)) / (1 << 40)
    size = F.when(F.col("toxic"), F.lit(sizes.get(True, 0))).otherwise(F.lit(sizes.get(False, 0)))
    some = marked.withColumn("chance", chance).where(F.col("chance") * size < 1.3 * SAMPLE + 30)
    some = some.withColumn("place", F.expr("row_number() over (partition by toxic order by chance, id)")).where(F.col("place") <= SAMPLE)
    # 2 * SAMPLE rows at most, so texts stay where they are.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id").select("toxic", "text", "chance").toPandas().sort_values(["chance", "toxic", "text"])
    total = sum(sizes.values())
    return fit([t or "" for t in rows["text"]], rows["toxic"].to_numpy(bool), sizes.get(True, 0) / total if total else 0.0)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score. The model is a few MB whatever the corpus."""
    small_batches(docs.sparkSession)
    # Without what the driver remembers of words.
    marks = Landmarks(model.landmarks.words)
    marks.tuned(model.landmarks.floor)
    sent = docs.sparkSession.sparkContext.broadcast(Model(marks, model.weights, model.curve, model.more))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tk.pieces(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first, piece.n), pa.array(sent.value.score(piece))], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), f"id {kind}, score double").withColumnRenamed("id", id_col)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir), read(spark, sf_dir, "labels")
    held = fold(F.col("doc_id"), 4) == 2
    found = scored(docs, train(docs.where(~held), labels.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
