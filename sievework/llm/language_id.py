"""Language identification by nearest centroid over normalised TF-IDF vectors of hashed character n-grams.

A text's vector holds its letters' n-grams of one to three bytes, hashed to `DIMENSIONS` buckets, as (1 + log tf) * idf,
scaled to length 1. Document frequencies are counted over every training document. Each language gets `CLUSTERS`
centroids by spherical k-means on at most `SAMPLE` of its training documents, a hash of whose ids is smallest; each
language is clustered by a task of its own, and only centroids come to the driver, 64 KB a language. A text belongs to the language of its nearest centroid by cosine;
it is rejected where that cosine is below what all but `REJECTED` of the centroid's own sample reach.

Defined cases: a text that is null, empty or without a letter is `und` with score 0; training rows with a null
language are left out; without training rows every text is `und`; repeated rows count and are judged each; an empty
table gives an empty result; other columns are not read. Every text is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .shared import fold, read, small_batches, small_side, tidy, written

#: A power of two.
DIMENSIONS = 4096
CLUSTERS, SAMPLE, REJECTED = 4, 500, 0.005
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
U64 = np.uint64


def term_counts(piece: tk.Texts) -> np.ndarray:
    """Counts of n-grams by text and bucket. What is no letter counts as a gap."""
    data = piece.lowered().data
    data = np.where(_LETTERS[data], data, 32).astype(np.uint32)
    one, two = np.full(len(data), 32, np.uint32), np.full(len(data), 32, np.uint32)
    one[1:], two[2:] = data[:-1], data[:-2]
    begins = piece.begins
    one[begins] = two[begins] = 32
    two[begins[begins + 1 < len(data)] + 1] = 32
    owner = np.repeat(np.arange(piece.n, dtype=np.int64), np.diff(np.concatenate((begins, [len(data)]))))
    bits = int(DIMENSIONS).bit_length() - 1
    out = np.zeros(piece.n * DIMENSIONS, np.float32)
    for k, code in enumerate((data, data | one << 8, data | one << 8 | two << 16)):
        bucket = ((code.astype(np.uint32) + np.uint32(k << 28)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
        used = (data != 32) | (one != 32)
        out += np.bincount((owner * DIMENSIONS + bucket)[used], minlength=len(out)).astype(np.float32)
    return out.reshape(piece.n, DIMENSIONS)


def _groups(piece: tk.Texts, at_most: int = 256) -> Iterator[tuple[int, tk.Texts]]:
    """A piece in parts of few texts: a part's matrix of counts stays within a few MB."""
    for lo in range(0, piece.n, at_most):
        hi = min(lo + at_most, piece.n)
        begin = piece.begins[lo]
        yield lo, tk.Texts(piece.data[begin : piece.ends[hi - 1] + 1], piece.ends[lo:hi] - begin, piece.first + lo)


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    labels: list[str]
    #: The least cosine of each centroid that isn't rejected.
    least: np.ndarray

    def vectors(self, piece: tk.Texts) -> np.ndarray:
        counts = term_counts(piece)
        found = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * self.idf
        return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)

    def predict(self, piece: tk.Texts) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Each text's language, its cosine, and whether it is rejected."""
        labels: list[str] = []
        scores, rejected = np.zeros(piece.n), np.ones(piece.n, bool)
        for lo, part in _groups(piece):
            near = self.vectors(part) @ self.centroids.T if self.labels else None
            for i in range(part.n):
                text = part.string(int(part.begins[i]), int(part.ends[i]))
                if near is None or not LETTER.search(text):
                    labels.append(UNKNOWN)
                    continue
                best = int(near[i].argmax())
                labels.append(self.labels[best])
                scores[lo + i] = min(max(float(near[i, best]), 0.0), 1.0)
                rejected[lo + i] = near[i, best] < self.least[best]
        return labels, scores, rejected


def _clustered(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from spread-out starts: unit centroids, and each row's cosine to its own."""
    starts = [0]
    for _ in range(min(k, len(x)) - 1):
        starts.append(int((x @ x[starts].T).max(1).argmin()))
    centroids = x[starts]
    for _ in range(rounds):
        own = (x @ centroids.T).argmax(1)
        sums = np.stack([x[own == j].sum(0) if (own == j).any() else centroids[j] for j in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    near = x @ centroids.T
    return centroids, near


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from the rows that have a language."""
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for piece in tk.pieces(batch.column(0)):
                for _, part in _groups(piece):
                    total += (term_counts(part) > 0).sum(0)
                    n += part.n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMENSIONS + 1)), pa.array(np.concatenate((total, [n])))], ["bucket", "n"])

    counted = rows.select("text").mapInArrow(tidy(frequencies), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = np.zeros(DIMENSIONS + 1)
    for bucket, n in counted.collect():
        found[bucket] = n
    idf = np.log((1 + found[-1]) / (1 + found[:-1])) + 1

    # A row for each language: texts stay where they are, however many of them a language has.
    sizes = written(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("all")), "languages")
    # About 1.5 * SAMPLE rows of each language by hash, of which the SAMPLE smallest stay.
    chance = F.pmod(F.xxhash64("id", F.lit("language sample")), F.lit(1 << 40)) / (1 << 40)
    some = rows.join(small_side(sizes), "lang").withColumn("chance", chance).where(F.col("chance") * F.col("all") < 1.5 * SAMPLE + 30)
    some = some.withColumn("place", F.expr("row_number() over (partition by lang order by chance, id)")).where(F.col("place") <= SAMPLE)
    base = Model(idf, np.zeros((0, DIMENSIONS)), [], np.zeros(0))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tk.pieces(batch.column(1)):
                for _, part in _groups(piece):
                    vectors = base.vectors(part).astype(np.float32)
                    keep = [batch.column(k).slice(part.first, part.n) for k in (0, 2)]
                    yield pa.RecordBatch.from_arrays([*keep, pa.array([v.tobytes() for v in vectors], pa.binary())], ["lang", "chance", "vector"])

    def clustered(frame: pd.DataFrame) -> pd.DataFrame:
        """A language's sample, SAMPLE rows at most, to its centroids."""
        frame = frame.sort_values(["chance", "vector"])
        x = np.stack([np.frombuffer(v, np.float32) for v in frame["vector"]])
        x = x[np.linalg.norm(x, axis=1) > 0]
        if not len(x):
            return pd.DataFrame({"lang": [], "cluster": [], "centroid": [], "least": []})
        middle, near = _clustered(x, CLUSTERS)
        best = near.argmax(1)
        least = [float(np.quantile(near[best == j, j], REJECTED)) if (best == j).any() else 1.0 for j in range(len(middle))]
        return pd.DataFrame({"lang": [frame["lang"].iloc[0]] * len(middle), "cluster": range(len(middle)), "centroid": [m.astype(np.float32).tobytes() for m in middle], "least": least})

    vectors = some.select("lang", "text", "chance").mapInArrow(tidy(described), "lang string, chance double, vector binary")
    found = sorted(vectors.groupBy("lang").applyInPandas(clustered, "lang string, cluster int, centroid binary, least double").collect(), key=lambda r: (r["lang"], r["cluster"]))
    centroids = np.stack([np.frombuffer(r["centroid"], np.float32) for r in found]) if found else base.centroids
    return Model(idf, centroids, [r["lang"] for r in found], np.array([r["least"] for r in found]))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score (cosine), rejected. The model's size is bounded by its parameters, not by the corpus."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tk.pieces(batch.column(1)):
                labels, scores, rejected = sent.value.predict(piece)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first, piece.n), pa.array(labels, pa.string()), pa.array(scores), pa.array(rejected)], ["id", "lang_pred", "score", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), f"id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir)
    held = fold(F.col("doc_id"), 3) == 1
    found = identify(docs, train(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
