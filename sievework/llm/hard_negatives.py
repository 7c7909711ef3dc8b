"""Hard-negative mining by a full sort of every anchor's scores, in blocks.

Vectors become integers, floor(256 * x), so that scores are exact and the same everywhere. Anchors are worked on in
waves whose bytes are bounded (`WAVE_BYTES`): a wave is sent to every task, and each task multiplies it with the rows it
reads, block by block (`BLOCK`). In a block each anchor's scores are sorted by score and id:

1. The first `positives` entries of the anchor's label are kept, merged block by block and then across tasks.
2. With the positives known, a binary search finds the place of each positive's score, its upper limit, and the first `k`
   entries of another label from there on are read down to the lower limit; they too are merged block by block and then
   across tasks.

A task so holds one block's scores and `positives * k` entries an anchor, and gives out no more than those, whatever
the number of rows, labels or ties. Tasks' entries meet by anchor and a salt first, then by anchor.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take no part; a null id is no
anchor, keeps its label, and stands behind all other ids in a tie; an anchor's positives never bear its own id; rows
that repeat an id are rows of their own, as positives, negatives and anchors; vectors of unlike length are compared as if
the shorter had zeros behind; components beyond 2**31 and scores beyond 2**63/100 count as these limits; a negative
positive score leaves no room for negatives; an anchor without positives or negatives has no row; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, read, tidy, written

#: Steps of a component; positives of an anchor; negatives of a positive; limits in hundredths of the positive's score.
STEPS, POSITIVES, NEGATIVES, LOWER, UPPER = 256, 5, 5, 80, 100
#: Bytes of a wave of anchors; rows of a block; anchors whose scores over a block are held at once; salts of a merge.
WAVE_BYTES, BLOCK, ABREAST, SALTS = 16 << 20, 4096, 256, 64
#: A component's and a score's limit.
MOST, MOST_SCORE = 2**31, (2**63 - 1) // 100


def _vectors(rows: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """id, label, vector (array of long) of the rows that take part."""
    x = F.col(vector_col)
    taken = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(x, lambda v: v.cast("double")).alias("v"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    taken = taken.where(F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite))
    clipped = lambda v: F.greatest(F.least(v, F.lit(float(MOST))), F.lit(float(-MOST)))
    return taken.select("id", "label", F.transform("v", lambda v: F.floor(clipped(v * STEPS))).alias("vector"))


def _matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """Lists of longs as rows of float64 (exact, components being at most 2**31), zeros behind."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    lengths = np.diff(ends)
    out = np.zeros((len(lengths), max([width, *lengths.tolist()])))
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products as int64. Sums that a double can't hold exactly are taken over 16-bit halves."""
    width = min(anchors.shape[1], rows.shape[1])
    a, b = anchors[:, :width], rows[:, :width]
    if not width or not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * width < 2**53:
        return (a @ b.T).astype(np.int64)
    exact = a.astype(np.int64).astype(object) @ b.astype(np.int64).astype(object).T
    return np.clip(exact, -MOST_SCORE, MOST_SCORE).astype(np.int64)


class _Wave:
    """Anchors of a wave: key, id, label, vectors; and of each its positives' scores, once known."""

    def __init__(self, table: pa.Table):
        self.key, self.label = table["key"].to_numpy(), table["label"].to_numpy()
        self.id = table["id"].to_numpy()
        self.vectors = _matrix(table["vector"])
        self.limits = np.zeros((len(self.key), 0), np.int64)
        self.known = np.zeros((len(self.key), 0), bool)

    def with_positives(self, found: pa.Table, positives: int) -> None:
        place = {k: i for i, k in enumerate(self.key.tolist())}
        self.limits, self.known = np.zeros((len(self.key), positives), np.int64), np.zeros((len(self.key), positives), bool)
        at = np.array([place[k] for k in found["key"].to_pylist()], np.int64), found["place"].to_numpy() - 1
        self.limits[at], self.known[at] = found["score"].to_numpy(), True


class _Best:
    """The first `k` entries (score downwards, id upwards, null ids last) of each list so far."""

    def __init__(self, shape: tuple[int, ...], k: int):
        self.k = k
        self.score, self.id = np.zeros((*shape, k), np.int64), np.zeros((*shape, k), np.int64)
        self.null, self.void = np.zeros((*shape, k), bool), np.ones((*shape, k), bool)

    def merge(self, where: slice, score: np.ndarray, id_: np.ndarray, null: np.ndarray, void: np.ndarray) -> None:
        parts = [np.concatenate((old[where], new), -1) for old, new in ((self.score, score), (self.id, id_), (self.null, null), (self.void, void))]
        order = np.lexsort((parts[1], parts[2], -parts[0], parts[3]))[..., : self.k]
        for old, new in zip((self.score, self.id, self.null, self.void), parts, strict=True):
            old[where] = np.take_along_axis(new, order, -1)


def _read_on(same: np.ndarray, start: np.ndarray, k: int) -> np.ndarray:
    """The places of the first `k` marked entries from each start on, len(same) where there are fewer. same: marks in
    the order of an anchor's entries."""
    counted = np.cumsum(same)
    before = np.where(start > 0, counted[np.maximum(start - 1, 0)], 0)
    return np.searchsorted(counted, before[:, None] + np.arange(1, k + 1), "left")


def _block(wave: _Wave, best: _Best, ids: np.ndarray, nulls: np.ndarray, labels: np.ndarray, rows: np.ndarray, lower: int, upper: int) -> None:
    """A block's rows, sorted by each anchor's scores, into the best entries so far."""
    k, first = best.k, not wave.limits.shape[1]
    for low in range(0, len(wave.key), ABREAST):
        part = slice(low, min(low + ABREAST, len(wave.key)))
        found = scores(wave.vectors[part], rows)
        order = np.lexsort((np.broadcast_to(ids, found.shape), np.broadcast_to(nulls, found.shape), -found))
        ranked = np.take_along_axis(found, order, -1)
        own = labels[order] == wave.label[part, None]
        wanted = own & (nulls[order] | (ids[order] != wave.id[part, None])) if first else ~own
        places = np.empty((len(found), *best.score.shape[1:]), np.int64)
        for i in range(len(found)):
            start = np.zeros(1, np.int64) if first else np.searchsorted(-ranked[i] * 100, -wave.limits[low + i] * upper, "left")
            places[i] = _read_on(wanted[i], start, k)[0] if first else _read_on(wanted[i], start, k)
        flat = places.reshape(len(found), -1)
        void, at = flat >= len(ids), np.minimum(flat, len(ids) - 1)
        score, source = np.take_along_axis(ranked, at, -1).reshape(places.shape), np.take_along_axis(order, at, -1).reshape(places.shape)
        void = void.reshape(places.shape)
        if not first:
            void |= ~wave.known[part, :, None] | (score * 100 < wave.limits[part, :, None] * lower)
        best.merge(part, score, ids[source], nulls[source], void)


def _task(wave, k: int, lower: int, upper: int):
    """Rows to the wave's best entries in this task: key, of (number of the positive, 0 in the first pass), score, id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, seen = wave.value, [], False
        positives = own.limits.shape[1]
        best = _Best((len(own.key), positives) if positives else (len(own.key),), k)

        def work() -> None:
            table = pa.Table.from_batches(held)
            id_ = table["id"]
            _block(own, best, id_.fill_null(0).to_numpy(), id_.is_null().to_numpy(), table["label"].to_numpy(), _matrix(table["vector"]), lower, upper)
            held.clear()

        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                held.append(batch.slice(low, BLOCK))
                seen = True
                if sum(b.num_rows for b in held) >= BLOCK:
                    work()
        if held:
            work()
        if seen:
            at = np.nonzero(~best.void)
            of = at[1] + 1 if len(at) == 3 else np.zeros(len(at[0]), np.int64)
            columns = [pa.array(own.key[at[0]]), pa.array(of), pa.array(best.score[at]), pa.array(best.id[at], mask=best.null[at])]
            yield pa.RecordBatch.from_arrays(columns, ["key", "of", "score", "id"])

    return run


def _first(entries: DataFrame, k: int) -> DataFrame:
    """The first `k` of each (key, of), with their place. A task gives `k` at most, and salts merge them before the
    last window, which sees SALTS * k rows of a list at most."""
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    salted = entries.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    near = Window.partitionBy("key", "of", "salt").orderBy(*order)
    over = Window.partitionBy("key", "of").orderBy(*order)
    few = salted.withColumn("place", F.row_number().over(near)).where(F.col("place") <= k)
    return few.withColumn("place", F.row_number().over(over)).where(F.col("place") <= k).drop("salt")


def mine(
    rows: DataFrame,
    anchors: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label: Column | None = None,
    positives: int = POSITIVES,
    k: int = NEGATIVES,
    lower: int = LOWER,
    upper: int = UPPER,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows that `anchors`, a
    condition on `rows`, names. `lower` and `upper` are hundredths of the positive's score."""
    spark = rows.sparkSession
    label = F.col("label") if label is None else label
    out_schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    every = written(_vectors(rows, id_col, vector_col, label), "vectors")
    asked = written(_vectors(rows.where(anchors), id_col, vector_col, label), "anchors")
    n, width = asked.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    if not n:
        discard(every, asked)
        return spark.createDataFrame([], out_schema)
    waves = -(-n * 8 * (width + 3) // WAVE_BYTES)
    numbered = asked.repartition(waves).select(F.spark_partition_id().alias("wave"), F.monotonically_increasing_id().alias("key"), "*")
    dealt = written(numbered, "anchor-waves")
    discard(asked)
    parts, done = [], []
    for number in range(waves):
        # A wave's size is bounded: rows are dealt out evenly over the waves.
        table = dealt.where(F.col("wave") == number).drop("wave").toArrow()
        if not table.num_rows:
            continue
        wave = _Wave(table)
        sent = spark.sparkContext.broadcast(wave)
        schema = "key long, of long, score long, id long"
        near = written(_first(every.mapInArrow(tidy(_task(sent, positives, lower, upper)), schema), positives), "positives")
        wave.with_positives(near.select("key", "place", "score").toArrow(), positives)
        again = spark.sparkContext.broadcast(wave)
        far = _first(every.mapInArrow(tidy(_task(again, k, lower, upper)), schema), k)
        named = near.select("key", F.col("place").cast("long").alias("of"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        mined = far.select("key", "of", F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, ["key", "of"])
        parts.append(written(mined.join(dealt.where(F.col("wave") == number).select("key", F.col("id").alias("anchor_id")), "key"), "mined"))
        done.append(near)
        sent.destroy()
        again.destroy()
    discard(every, dealt, *done)
    out = spark.read.schema(parts[0].schema).parquet(*[p.written_to for p in parts])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=shifted)


SQL = r"""
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s
  WHERE same AND vec_id IS DISTINCT FROM anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INT) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
WHERE 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""
