"""Language-model scoring by a hashed maximum-entropy model with class-factored softmax.

P(word | history) = P(class | history) * P(leaf | class, history) * P(word | leaf). A word's spelling, as the shares of
its hashed byte bigrams, lies on one side of each of eight fixed hyperplanes; the first four sides are its class, the
others its leaf within the class, so a word never seen has both. The first two factors are softmaxes over hashed features
of the history: the word before, the one before that (a skip feature), the leaves of both together, and a bias; the
second factor's features and bias are the class's own. P(word | leaf) is the leaf's share of additively smoothed counts,
with one place for all unseen words, so the model sums to one.

The counts cover every training document. The weights are trained by distributed gradient updates in `ROUNDS` rounds,
each over its part of all training documents: every task makes Adagrad steps from the round's weights, and the tasks'
weights are averaged by the tokens that they saw, first within salts, then over them.

Words are scored in sparse numpy batches. The `HEAD` most frequent words' counts, a bounded table, are sent to the
workers; the other words of a document go, with their numbers, through a join with the table of counts.

Defined cases: a null or empty text is the end alone; an end after each text counts as a token; the first words have
begin marks as history; without training documents every word is unseen; repeated rows count and are scored each; null
ids are scored as others; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .shared import discard, fold, read, small_batches, tidy, written

#: Classes, and leaves in each; buckets of byte bigrams (powers of two); the most frequent words sent to workers.
CLASSES, LEAVES, BIGRAMS, HEAD = 16, 16, 64, 400_000
#: Bits of word features and of leaf features; Adagrad's step; tokens of a step; rounds; blocks and salts of an average.
WORD_BITS, PAIR_BITS, STEP, BATCH, ROUNDS, BLOCKS, SALTS = 14, 14, 0.5, 131_072, 2, 32, 16
#: Bytes of input for a task at least.
TASK_BYTES = 8 << 20
#: Where Adagrad's sums of squares start in the first round, and in later ones, whose weights are no longer nothing.
FIRST_SQUARES, LATER_SQUARES = 1e-2, 4.0
ADD = 0.1
U64 = np.uint64
END, BEGIN, BEFORE = U64(0x0E4D), U64(0xBE61), U64(0xBEF0)
ROWS = (2 << WORD_BITS) + (1 << PAIR_BITS)
#: Hyperplanes through the space of bigram shares: a side is the sign of the sum over a word's bigrams.
PLANES = np.random.default_rng(20250703).normal(size=(BIGRAMS, 8)).astype(np.float32)


def leaves_of(piece: tk.Texts, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CLASSES * LEAVES numbers of words: class * LEAVES + leaf."""
    out = np.zeros(len(starts), np.int64)
    for lo in range(0, len(starts), 16_384):
        size = (ends - starts)[lo : lo + 16_384]
        first = np.cumsum(size) - size
        inner = np.repeat(starts[lo : lo + 16_384] - first, size) + np.arange(size.sum())
        before = piece.data[np.maximum(inner - 1, 0)].astype(np.uint32)
        before[first] = 32
        bigram = ((before << np.uint32(8) | piece.data[inner]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 6)
        out[lo : lo + 16_384] = (np.add.reduceat(PLANES[bigram], first) > 0) @ (1 << np.arange(8))
    return out


class Tokens:
    """A piece's tokens in order: hashes, leaves, texts, features. Each different word is classed once; the end of a
    text is in leaf 0 beside others."""

    def __init__(self, piece: tk.Texts):
        low = piece.lowered()
        starts, ends, owner = low.words()
        hashed = low.hashes(starts, ends)
        words, first, which = np.unique(hashed, return_index=True, return_inverse=True)
        n = len(starts) + piece.n
        last = np.cumsum(tk.counts_of(owner, piece.n) + 1) - 1
        word = np.ones(n, bool)
        word[last] = False
        self.hashes, self.leaves = np.full(n, END), np.zeros(n, np.int64)
        self.hashes[word], self.leaves[word] = hashed, leaves_of(low, starts[first], ends[first])[which] if len(words) else 0
        self.texts = np.repeat(np.arange(piece.n), np.diff(np.concatenate(([-1], last))))
        begins = np.concatenate(([0], last[:-1] + 1))
        second = np.setdiff1d(begins + 1, [*begins, n])

        def shifted(values, begin, before):
            one, two = np.empty_like(values), np.empty_like(values)
            one[1:], two[2:] = values[:-1], values[:-2]
            one[begins], two[begins], two[second] = begin, before, begin
            return one, two

        one, two = shifted(self.hashes, BEGIN, BEFORE)
        leaf, skip = shifted(self.leaves, CLASSES * LEAVES, CLASSES * LEAVES + 1)
        self.history = (tk.mix(one), tk.mix(two + U64(7)), tk.mix((leaf * 512 + skip).astype(np.uint64) + U64(0x77770000)))
        self.classes, self.of_class = self.leaves // LEAVES, self.leaves % LEAVES

    def features(self, some: slice, by_class: bool) -> np.ndarray:
        """Rows of the weights for the word before, the word skipped to, and both leaves."""
        history = [x[some] for x in self.history]
        if by_class:
            salt = (self.classes[some] + 1).astype(np.uint64) * U64(0x9E3779B97F4A7C15)
            history = [((x ^ salt ^ (x >> U64(29))) * U64(0xBF58476D1CE4E5B9)) >> U64(20) for x in history]
        word, pair = U64((1 << WORD_BITS) - 1), U64((1 << PAIR_BITS) - 1)
        return np.stack([(history[0] & word).astype(np.int64), (history[1] & word).astype(np.int64) + (1 << WORD_BITS), (history[2] & pair).astype(np.int64) + (2 << WORD_BITS)])


class Softmax:
    """Weights of one factor: a row for each feature, and a bias for each class before it."""

    def __init__(self, outputs: int, biases: int, values: np.ndarray | None = None):
        self.outputs = outputs
        size = (ROWS + biases) * outputs
        self.weights = (np.zeros(size, np.float32) if values is None else values.astype(np.float32)).reshape(-1, outputs)
        self.square = np.full(self.weights.shape, FIRST_SQUARES if values is None else LATER_SQUARES, np.float32)

    def share(self, features: np.ndarray, bias: np.ndarray) -> np.ndarray:
        x = self.weights.take(features[0], axis=0)
        for rows in (features[1], features[2], ROWS + bias):
            x += self.weights.take(rows, axis=0)
        np.clip(x, -40, 40, out=x)
        np.exp(x, out=x)
        x /= (x @ np.ones(self.outputs, np.float32))[:, None]
        return x

    def update(self, features: np.ndarray, bias: np.ndarray, right: np.ndarray) -> None:
        error = self.share(features, bias)
        error[np.arange(len(right)), right] -= 1
        word, pair = 1 << WORD_BITS, 1 << PAIR_BITS
        for rows, begin, end in ((features[0], 0, word), (features[1], word, 2 * word), (features[2], 2 * word, 2 * word + pair), (ROWS + bias, ROWS, len(self.weights))):
            # Rows fit 16 bits, which numpy sorts by digits.
            order = np.argsort(rows.astype(np.uint16), kind="stable")
            rows = rows[order]
            at = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
            grad = np.zeros((end - begin, self.outputs), np.float32)
            grad[rows[at] - begin] = np.add.reduceat(error.take(order, axis=0), at, axis=0)
            square = self.square[begin:end]
            square += grad * grad
            grad *= STEP
            grad /= np.sqrt(square)
            self.weights[begin:end] -= grad


class Factors:
    """Both softmaxes of the history."""

    def __init__(self, values: np.ndarray | None = None):
        cut = (ROWS + 1) * CLASSES
        self.classes = Softmax(CLASSES, 1, None if values is None else values[:cut])
        self.leaves = Softmax(LEAVES, CLASSES, None if values is None else values[cut:])
        self.seen = 0

    def values(self) -> np.ndarray:
        return np.concatenate((self.classes.weights.ravel(), self.leaves.weights.ravel()))

    def update(self, tokens: Tokens) -> None:
        for lo in range(0, len(tokens.leaves), BATCH):
            some = slice(lo, lo + BATCH)
            own = tokens.classes[some]
            self.classes.update(tokens.features(some, False), np.zeros_like(own), own)
            self.leaves.update(tokens.features(some, True), own, tokens.of_class[some])
            self.seen += len(own)

    def log10(self, tokens: Tokens) -> np.ndarray:
        """log10 of the probability of each token's class and leaf given its history."""
        out = np.zeros(len(tokens.leaves))
        for lo in range(0, len(out), BATCH):
            some = slice(lo, lo + BATCH)
            own, leaf = tokens.classes[some], tokens.of_class[some]
            at = np.arange(len(own))
            p = self.classes.share(tokens.features(some, False), np.zeros_like(own))[at, own]
            q = self.leaves.share(tokens.features(some, True), own)[at, leaf]
            out[some] = np.log10(np.maximum(p, 1e-30)) + np.log10(np.maximum(q, 1e-30))
        return out


@dataclass
class Model:
    values: np.ndarray
    #: log10 of each leaf's smoothed total; of the unigram model's; the training tokens.
    leaf_total: np.ndarray
    total: float
    train_tokens: int
    head: np.ndarray
    head_counts: np.ndarray


def _combined(keys: list[np.ndarray], counts: list[np.ndarray], leaves: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, first, which = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    return words, np.bincount(which, np.concatenate(counts), len(words)).astype(np.int64), np.concatenate(leaves)[first]


def _pass(sent):
    """A round's texts to word counts (word, leaf, n) and, with leaf -1, the task's weights in blocks (block, n: the tokens
    it saw, weights)."""

    def out(k, c, n, w=None):
        return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(np.asarray(c, np.int32)), pa.array(np.asarray(n, np.int64)), pa.array(w or [None] * len(k), pa.binary())], ["word", "leaf", "n", "weights"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Factors(sent.value)
        keys, counts, leaves, size = [], [], [], 0
        for batch in batches:
            for piece in tk.pieces(batch.column(0)):
                tokens = Tokens(piece)
                trainer.update(tokens)
                words, first, count = np.unique(tokens.hashes, return_index=True, return_counts=True)
                keys.append(words)
                counts.append(count)
                leaves.append(tokens.leaves[first])
                size += len(words)
                if size > 2_000_000:
                    k, n, c = _combined(keys, counts, leaves)
                    keys, counts, leaves, size = [k], [n], [c], len(k)
                    if size > 1_000_000:
                        yield out(k, c, n)
                        keys, counts, leaves, size = [], [], [], 0
        if keys:
            k, n, c = _combined(keys, counts, leaves)
            yield out(k, c, n)
        if trainer.seen:
            parts = np.array_split(trainer.values().astype(np.float16), BLOCKS)
            yield out(np.arange(BLOCKS, dtype=np.uint64), np.full(BLOCKS, -1), np.full(BLOCKS, trainer.seen), [p.tobytes() for p in parts])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Means of blocks (word: the block's number, n, weights as 16-bit floats) by n, of each task's part."""
    sums: dict[int, list] = {}
    for batch in batches:
        for block, seen, weights in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            part = np.frombuffer(weights, np.float16)
            old = sums.setdefault(block, [0, np.zeros(len(part))])
            old[0] += seen
            old[1] += part.astype(float) * seen
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([(w / n).astype(np.float16).tobytes() for n, w in sums.values()], pa.binary())], ["word", "n", "weights"])


def _averaged(trained: DataFrame) -> np.ndarray | None:
    """The mean of the tasks' weights: a few MB whatever the corpus."""
    kind = "word long, n long, weights binary"
    blocks = trained.where("leaf < 0").select("word", "n", "weights", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"))
    blocks = blocks.repartition("word", "salt").select("word", "n", "weights").mapInArrow(tidy(_added), kind)
    found = sorted(blocks.repartition("word").mapInArrow(tidy(_added), kind).collect(), key=lambda r: r["word"])
    return np.concatenate([np.frombuffer(r["weights"], np.float16).astype(np.float32) for r in found]) if found else None


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int | None = None) -> tuple[Model, DataFrame]:
    """The model and the table of counts (word's hash, leaf, count)."""
    small_batches(docs.sparkSession)
    context, rounds = docs.sparkSession.sparkContext, rounds or ROUNDS
    rows = docs.select(F.pmod(F.xxhash64(id_col, text_col), F.lit(rounds)).alias("round"), F.col(text_col).alias("text"))
    # A task for each `TASK_BYTES` of input or so: small ones would send more weights than they have text.
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = max(context.defaultParallelism, min(-(-size // TASK_BYTES), 1 << 30))
    values, passes = None, []
    for k in range(rounds):
        own = rows.where(F.col("round") == k).select("text").coalesce(tasks).mapInArrow(tidy(_pass(context.broadcast(values))), "word long, leaf int, n long, weights binary")
        passes.append(written(own, "maxent-pass"))
        found = _averaged(passes[-1])
        values = values if found is None else found

    every = reduce(DataFrame.unionAll, [p.where("leaf >= 0").select("word", "leaf", "n") for p in passes])
    counts = written(every.groupBy("word").agg(F.first("leaf").alias("leaf"), F.sum("n").alias("n")), "maxent-counts")
    discard(*passes)
    size, kinds = np.zeros(CLASSES * LEAVES), np.zeros(CLASSES * LEAVES)
    for r in counts.groupBy("leaf").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        size[r["leaf"]], kinds[r["leaf"]] = r["n"], r["v"]
    # The least count of the head, from a histogram over eighths of powers of two.
    grade = F.floor(F.log2("n") * 8).cast("int")
    by_grade, room, least = {r[0]: r[1] for r in counts.groupBy(grade.alias("g")).count().collect()}, HEAD, None
    for g in sorted(by_grade, reverse=True):
        room -= by_grade[g]
        if room < 0:
            break
        least = g
    top = counts.where(grade >= (least if least is not None else 1 << 30)).select("word", "n").toArrow()
    head = top["word"].to_numpy().view(np.uint64)
    order = np.argsort(head)
    known = top["n"].to_numpy()[order]
    total = math.log10(size.sum() + ADD * (kinds.sum() + 1))
    values = Factors().values() if values is None else values
    return Model(values, np.log10(size + ADD * (kinds + 1)), total, int(size.sum()), head[order], known), counts


def score(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, factors = sent.value, Factors(sent.value.values)
        for batch in batches:
            for piece in tk.pieces(batch.column(1)):
                tokens = Tokens(piece)
                n = len(tokens.hashes)
                model_part = factors.log10(tokens) - own.leaf_total[tokens.leaves]
                at = np.minimum(np.searchsorted(own.head, tokens.hashes), max(len(own.head) - 1, 0))
                known = own.head[at] == tokens.hashes if len(own.head) else np.zeros(n, bool)
                word_part = np.where(known, np.log10((own.head_counts[at] if len(own.head) else np.zeros(n)) + ADD), 0)
                rest = np.flatnonzero(~known)
                keys, uses = tokens.hashes[rest], tk.counts_of(tokens.texts[rest], piece.n)
                offsets = pa.array(np.concatenate(([0], np.cumsum(uses))).astype(np.int32))
                total = lambda x: np.bincount(tokens.texts, x, piece.n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(piece.first, piece.n), pa.array(tk.counts_of(tokens.texts, piece.n)), pa.array(tk.counts_of(tokens.texts[known], piece.n)), pa.array(total(word_part)), pa.array(total(model_part)), pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64)))],
                    ["id", "n_tokens", "known", "words", "model", "rest"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    first = rows.mapInArrow(tidy(run), f"id {kind}, n_tokens long, known long, words double, model double, rest array<long>")
    first = written(first.withColumn("row", F.monotonically_increasing_id()), "maxent-scored")
    rest = first.select("row", F.explode("rest").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("uses"))
    rest = rest.join(counts.select("word", "n"), "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("uses")).otherwise(0)).alias("more"),
        F.sum(F.col("uses") * F.log10(F.coalesce("n", F.lit(0)) + ADD)).alias("rare"),
    )
    rare = F.coalesce("rare", F.lit(0.0))
    return first.join(rest, "row", "left").select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("words") + rare - F.col("n_tokens") * model.total).alias("base_score"),
        (F.col("words") + rare + F.col("model")).alias("score"),
    )


def op2_maxent(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir)
    held = fold(F.col("doc_id"), 10) == 0
    model, counts = train(docs.where(~held))
    found = score(docs, model, counts)
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
