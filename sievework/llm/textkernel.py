"""Words, lines and n-grams of many texts at once, as numpy arrays over one byte buffer.

A word's or line's 64-bit hash is a polynomial over a table of random values per byte, taken from one running sum and
mixed with its length, so no Python object is made for a word. `pieces` cuts an Arrow column into buffers of a few
MB (a longer text is a buffer of its own), which bounds memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 2 << 20
PIECE_TEXTS = 4000
U64 = np.uint64

_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, PIECE_BYTES + PIECE_TEXTS + 2)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(size, U64(base))
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Texts:
    """Some texts in one byte buffer, each followed by a line feed. Spans are [start, end) in the buffer."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, first: int):
        #: first: the number of the first text in its Arrow column; ends: where each text's bytes end.
        self.data, self.ends, self.first, self.n = data, ends, first, len(ends)
        self.begins = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
        self._sums = None

    def lowered(self) -> Texts:
        return Texts(_LOWER[self.data], self.ends, self.first)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and texts of all words."""
        inside = np.zeros(len(self.data) + 2, bool)
        inside[1:-1] = _IS_WORD[self.data]
        edge = inside[1:] != inside[:-1]
        at = np.flatnonzero(edge)
        starts, ends = at[0::2], at[1::2]
        return starts, ends, self.text_of(starts)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and texts of all lines, cut at line feeds."""
        ends = np.flatnonzero(self.data == 10)
        starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
        return starts, ends, self.text_of(starts)

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, "left")

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        up, down = _power(len(self.data) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_VALUES[self.data] * up[: len(self.data)], out=self._sums[1:])
        return mix((self._sums[ends] - self._sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def string(self, start: int, end: int) -> str:
        return self.data[start:end].tobytes().decode("utf-8", "replace")


def pieces(column: pa.Array) -> Iterator[Texts]:
    """The texts of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    at, n = 0, len(column)
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + PIECE_BYTES, "right")) - 1
        end = min(max(end, at + 1), at + PIECE_TEXTS, n)
        sizes = np.diff(offsets[at : end + 1])
        ends = np.cumsum(sizes + 1) - 1
        out = np.full(int(ends[-1]) + 1, 10, np.uint8)
        keep = np.ones(len(out), bool)
        keep[ends] = False
        out[keep] = data[offsets[at] : offsets[end]]
        yield Texts(out, ends, at)
        at = end


def counts_of(text_of: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(text_of, minlength=n).astype(np.int64)


def windows(words: np.ndarray, text_of: np.ndarray, size: int, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and texts of all windows of `size` words. short: a text of fewer words gives its whole sequence as one."""
    hashed = np.zeros(max(len(words) - size + 1, 0), np.uint64)
    for k in range(size):
        hashed = mix(hashed + words[k : k + len(hashed)] * U64(2 * k + 3))
    full = text_of[: len(hashed)] == text_of[size - 1 :] if len(hashed) else np.zeros(0, bool)
    hashed, owner = hashed[full], text_of[: len(full)][full]
    if short:
        count = counts_of(text_of, n)
        few = np.flatnonzero((count > 0) & (count < size))
        if len(few):
            first = np.cumsum(count) - count
            own = np.zeros(len(few), np.uint64)
            for k in range(size - 1):
                has = count[few] > k
                own[has] = mix(own[has] + words[first[few][has] + k] * U64(2 * k + 3))
            own = mix(own + count[few].astype(np.uint64) * U64(0xD1B54A32D192ED03))
            hashed, owner = np.concatenate((hashed, own)), np.concatenate((owner, few))
    return hashed, owner


def sets(hashed: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, hash), sorted by both. The hash keeps 52 bits, the text's number has the 12 above."""
    key = (owner.astype(np.uint64) << U64(52)) | (hashed >> U64(12))
    key.sort()
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return key & U64((1 << 52) - 1), (key >> U64(52)).astype(np.int64)
