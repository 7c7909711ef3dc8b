"""BPE encoding and decoding by a tokenization automaton.

The automaton reads a word as a path of tokens. A state is what may follow the last token read, an arc is labelled with
a token and leads to that token's state. It is compiled from the automaton that reads every sequence of letters, by one
gadget for each merge u v -> uv, in order of the merges: the state behind uv gets the arcs that the state behind v has;
the arc v is cut from the state behind u; and each state that still has the arc u gets the arc uv. States with the same
arcs, and tokens that the same states read, are then made one, which leaves a table of bits of about 20 MB. It is
compiled once, by the driver, and sent to the workers.

Of a word's token paths the automaton accepts exactly one, the one that merging in order of rank gives. `paths` finds it
from left to right: each beginning of a word has one accepted path, and a token that ends a beginning continues the path
before it if the table has the arc. Decoding emits the arcs' labels.

Defined cases: a null or empty text has no tokens and decodes to the empty text; a word of any length takes time in
proportion to its length; the strings of special tokens in a text are their ids, as in the library; ids are not read,
so repeated and null ids pass through; an empty table gives an empty result; only the two named columns are read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .shared import read, small_batches, tidy

END = "</w>"
#: The tokenizer file's own split pattern.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: White space of the split pattern; str.split() also cuts at the four separators below.
BREAKS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
SEPARATORS = re.compile("[\x1c-\x1f]")
#: Pieces that a worker remembers before it starts anew; letters in the longest; letters of text encoded together.
REMEMBERED, LONGEST_REMEMBERED, TOGETHER = 300_000, 1000, 6 << 20
def byte_letters() -> dict[int, str]:
    """Each byte's printable letter: its own where it has one, else the next from code point 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _same(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each kind, and each one's kind."""
    _, first, kind = np.unique(keys, return_index=True, return_inverse=True)
    return first, kind


class MergeAutomaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.ids, self.labels = vocab, [""] * (max(vocab.values()) + 1)
        for label, i in vocab.items():
            self.labels[i] = label
        size = len(self.labels)
        # Nothing follows a token that ends a word, so it has no state of its own; special tokens stand alone.
        letters = [i for label, i in vocab.items() if len(label.removesuffix(END)) == 1]
        inner = sorted({i for label, i in vocab.items() if not label.endswith(END)} & ({*letters} | {vocab[u + v] for u, v in merges}))
        states = np.full(size, -1)
        states[inner] = np.arange(len(inner))
        #: arcs[state, token // 8] has the bit token % 8.
        arcs = np.zeros((len(inner), size // 8 + 1), np.uint8)
        first = np.zeros(arcs.shape[1] * 8, bool)
        first[letters] = True
        arcs[states[[i for i in letters if states[i] >= 0]]] = np.packbits(first, bitorder="little")
        self.reachable = bytearray(size)
        for i in letters:
            self.reachable[i] = 1
        for u, v in merges:
            self._gadget(arcs, states, vocab[u], vocab[v], vocab[u + v])
        self._shrink(arcs, states)
        #: For tokens within a word and at its end: each ending of a label to the token that it is, or -1.
        self.within: dict[str, int] = {}
        self.final: dict[str, int] = {}
        for label, i in vocab.items():
            plain, of = label.removesuffix(END), self.final if label.endswith(END) else self.within
            for k in range(1, len(plain)):
                of.setdefault(plain[k:], -1)
            if self.reachable[i]:
                of[plain] = i

    def _gadget(self, arcs: np.ndarray, states: np.ndarray, u: int, v: int, uv: int) -> None:
        byte, bit = v >> 3, v & 7
        if not (self.reachable[u] and self.reachable[v] and arcs[states[u], byte] >> bit & 1):
            return
        self.reachable[uv] = 1
        if states[uv] >= 0:
            arcs[states[uv]] = arcs[states[v]]
        # Of two equal merges that overlap the left one is made: uv may be followed by v, but u not by uv.
        arcs[states[u], byte] &= np.uint8(255 ^ 1 << bit)
        arcs[:, uv >> 3] |= (arcs[:, u >> 3] >> np.uint8(u & 7) & np.uint8(1)) << np.uint8(uv & 7)

    def _shrink(self, arcs: np.ndarray, states: np.ndarray) -> None:
        """Makes states with the same arcs one, and tokens that the same states read."""
        rng = np.random.default_rng(49)
        marks = rng.integers(1, 1 << 63, arcs.shape[1], dtype=np.uint64) | np.uint64(1)
        keys = np.zeros(len(arcs), np.uint64)
        for lo in range(0, len(arcs), 1024):
            keys[lo : lo + 1024] = (arcs[lo : lo + 1024].astype(np.uint64) * marks).sum(1, dtype=np.uint64)
        first, kind = _same(keys)
        arcs = arcs[first]
        columns = np.zeros(arcs.shape[1] * 8, np.uint64)
        for row, mark in zip(arcs, rng.integers(1, 1 << 63, len(arcs), dtype=np.uint64), strict=True):
            columns += np.unpackbits(row, bitorder="little") * mark
        token, column = _same(columns)
        #: A state's arcs as bits; each token's state behind it, and the byte and bit of its arc.
        self.rows = [np.packbits(np.unpackbits(row, bitorder="little")[token], bitorder="little").tobytes() for row in arcs]
        self.state = np.where(states >= 0, kind[states], -1).tolist()
        self.byte = (column[: len(states)] >> 3).tolist()
        self.bit = (1 << (column[: len(states)] & 7)).tolist()

    def step(self, state: int, token: int) -> bool:
        """Whether an arc `token` leaves the state behind the token `state`."""
        return bool(self.rows[self.state[state]][self.byte[token]] & self.bit[token])

    def _arc(self, word: str, end: int, last: list[int], arcs: dict[str, int]) -> tuple[int, int]:
        """The last token, and where it begins, of the accepted path of word[:end]. last: the same for shorter ones."""
        rows, state, byte, bit = self.rows, self.state, self.byte, self.bit
        for begin in range(end - 1, -1, -1):
            token = arcs.get(word[begin:end])
            if token is None:
                break
            if token >= 0 and (not begin or rows[state[last[begin]]][byte[token]] & bit[token]):
                return token, begin
        raise ValueError(f"no path for {word!r}")

    def paths(self, words: set[str]) -> dict[str, list[int]]:
        """The accepted paths of words in byte letters. In sorted order, words share the paths of a common beginning."""
        out: dict[str, list[int]] = {}
        last, start, before = [-1], [0], ""
        for word in sorted(words):
            n, same = len(word), 0
            most = min(len(before), n) - 1
            while same < most and word[same] == before[same]:
                same += 1
            del last[same + 1 :], start[same + 1 :]
            for end in range(same + 1, n):
                token, begin = self._arc(word, end, last, self.within)
                last.append(token)
                start.append(begin)
            token, at = self._arc(word, n, last, self.final)
            path = [token]
            while at > 0:
                path.append(last[at])
                at = start[at]
            out[word], before = path[::-1], word
        return out

    def emit(self, ids) -> str:
        labels = self.labels
        return " ".join([labels[i] for i in ids])


def newer_letters() -> str:
    """Letters and digits that the regex library knows and the Unicode tables of unicodedata don't: no letters here."""
    unknown = "".join(chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn")
    return "".join(regex.findall(r"[\p{L}\p{N}]", unknown))


class Tokenizer:
    """The automaton with the file's normaliser, splitter and special tokens."""

    def __init__(self, spec: str):
        file = json.loads(spec)
        model = file["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.automaton = MergeAutomaton(model["vocab"] | special, merges)
        self.special = special
        self.special_in = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.letters = byte_letters()
        self.newer = frozenset(newer_letters())
        self.split = regex.compile(SPLIT)
        self.forget()

    def _words(self, piece: str) -> list[str]:
        """The words of a piece of text without white space, in byte letters."""
        if not piece.isascii():
            piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
        piece = piece.lower()
        if self.newer.isdisjoint(piece):
            words = self.split.findall(piece)
        else:
            # Each stands for itself as a private-use character, which is neither letter nor digit.
            words, at = [], 0
            for word in self.split.findall("".join("\ue000" if c in self.newer else c for c in piece)):
                words.append(piece[at : at + len(word)])
                at += len(word)
        return [w if w.isalpha() and w.isascii() else w.encode().decode("latin-1").translate(self.letters) for w in words]

    def _learn(self, pieces: list[str]) -> None:
        """Adds what the pieces encode and decode to. Their unknown words are encoded together."""
        cut = [self._words(x) for x in pieces]
        words = self.words
        paths = self.automaton.paths({w for own in cut for w in own if w not in words})
        for w, path in paths.items():
            words[w] = array("I", path).tobytes(), self.automaton.emit(path)
        for piece, own in zip(pieces, cut, strict=True):
            if len(own) == 1:
                self.ids[piece], self.decoded[piece] = words[own[0]]
            else:
                self.ids[piece] = b"".join([words[w][0] for w in own])
                self.decoded[piece] = " ".join([words[w][1] for w in own])

    def forget(self) -> None:
        """Frees what a task has learned: the worker's next task may be another operator's."""
        #: Known so far: for pieces between white space and for words.
        self.ids: dict[str, bytes] = {}
        self.decoded: dict[str, str] = {}
        self.words: dict[str, tuple[bytes, str]] = {}

    def encode_decode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids, as little-endian unsigned 32-bit integers, and what they decode to."""
        if len(self.ids) > REMEMBERED:
            self.ids, self.decoded = {}, {}
        if len(self.words) > REMEMBERED // 2:
            self.words = {}
        cut = [self.special_in.split(t) if self.special_in and "<|" in t else [t] for t in texts]
        plain = [[[x for x in BREAKS.split(p) if x] if SEPARATORS.search(p) else p.split() for p in parts[::2]] for parts in cut]
        ids, decoded = self.ids, self.decoded
        self._learn([x for x in set().union(*[p for parts in plain for p in parts]) if x not in ids])
        out = []
        for parts, pieces in zip(cut, plain, strict=True):
            if len(parts) == 1:
                out.append((b"".join(map(ids.__getitem__, pieces[0])), " ".join(map(decoded.__getitem__, pieces[0]))))
                continue
            first, second = [], []
            for k, part in enumerate(parts):
                first += [array("I", [self.special[part]]).tobytes()] if k % 2 else map(ids.__getitem__, pieces[k // 2])
                second += [part] if k % 2 else map(decoded.__getitem__, pieces[k // 2])
            out.append((b"".join(first), " ".join(second)))
        if max(map(len, texts), default=0) > LONGEST_REMEMBERED:
            for x in {x for parts in plain for p in parts for x in p if len(x) > LONGEST_REMEMBERED}:
                del ids[x], decoded[x]
        return out


_tokenizers: dict[str, Tokenizer] = {}


def tokenizer(spec: str) -> Tokenizer:
    """The driver's tokenizer for a file's content: compiled once."""
    if spec not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[spec] = Tokenizer(spec)
    return _tokenizers[spec]


def default_spec() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def encode_decode(docs: DataFrame, spec: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (binary: little-endian unsigned 32-bit integers), decoded. spec: the tokenizer file's content; what is
    compiled from it takes some ten MB whatever the input, and is sent to the executors once."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(tokenizer(spec or default_spec()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value

        def done(rows: list[tuple[pa.Array, list[str]]]) -> Iterator[pa.RecordBatch]:
            found = own.encode_decode([t for _, texts in rows for t in texts])
            for keys, texts in rows:
                ids, decoded = zip(*found[: len(texts)], strict=True)
                del found[: len(texts)]
                yield pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["id", "ids", "decoded"])

        held, size = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, begin = [], at
                while at < batch.num_rows and size < TOGETHER:
                    texts.append(batch.column(1)[at].as_py() or "")
                    size += len(texts[-1])
                    at += 1
                held.append((batch.column(0).slice(begin, at - begin), texts))
                if size >= TOGETHER:
                    yield from done(held)
                    held, size = [], 0
        if held:
            yield from done(held)
        own.forget()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), f"id {kind}, ids binary, decoded string").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, spec: str | None = None, ids_col: str = "ids") -> DataFrame:
    """The input with a column `decoded`, from ids alone; unknown ids are left out, null ids give a null. A column of
    that name is replaced."""
    spark = encoded.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(tokenizer(spec or default_spec()).automaton)
    rows = encoded.select(*[c for c in encoded.columns if c.lower() != "decoded"])
    at = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        size = len(own.labels)
        for batch in batches:
            found = [None if x is None else own.emit(i for i in np.frombuffer(x, "<u4").tolist() if i < size) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "decoded"])

    return rows.mapInArrow(tidy(run), StructType([*rows.schema.fields, StructField("decoded", StringType())]))


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    found = encode_decode(read(spark, sf_dir))
    return found.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
