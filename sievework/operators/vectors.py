"""The stored vector index: exact search in blocks that a bound can skip, and a query's scale from moments.

Vectors are dealt to the nearest of some pivots, sorted by their distance to it, and packed into blocks of `BLOCK` rows
as one binary matrix each. A block's head has its centre and radius: no vector x of it has q.x above
q.centre + |q| * radius. A search for the best files scores the blocks with the highest bounds first; blocks whose bound
is below the last file of the answer are not read. Blocks lie in a folder for each pivot, so the others' files are not
opened. The answer equals that of a search over all rows.

A query's scale needs the mean of all cosines by modality, and their pooled deviation. Both follow from moments that are
summed once when the index is built: the sum of a modality's vectors s and of their outer products m give the sum of
cosines q.s and of their squares q.m.q, so no search reads all vectors for its scale.

Only pivots are fitted on a sample (`SAMPLE` rows, chosen by the hash of their id); a poor sample makes blocks wide, not
answers wrong. Rows with a null vector, a null or non-finite component, or another length than the first are not
indexed; repeated ids are rows of their own; an empty table makes an empty index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranking import KIND_BONUS, LEAST_SPREAD, MODALITY_LEAST, dot

#: Rows of a block; rows from which pivots are fitted, most pivots, rounds of the fit; tasks that sum moments.
BLOCK, SAMPLE, PIVOTS, ROUNDS, TASKS = 1024, 20_000, 1024, 8, 512
#: Rows of an index that is read whole; blocks that are scored before bounds are compared.
SMALL, FIRST = 100_000, 8
ROW = "id long, file long, kind string, modality string, sets_scale boolean, vec array<float>"
BLOCKS = "block long, n int, ids array<long>, files array<long>, kinds array<string>, modalities array<string>, vectors binary"
HEADS = "pivot int, block long, n int, centre array<float>, radius double, modalities array<string>"
PLACES = "file long, pivot int, block long"
MOMENTS = "modality string, n long, sums array<double>, products array<double>"
FOUND = "file long, segment long, z double, cosine double, kind string"


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Centres of a few rounds of k-means, begun at rows that are spread over the sample."""
    centres = sample[np.linspace(0, len(sample) - 1, count).astype(int)].astype(np.float64)
    for _ in range(ROUNDS):
        own = _nearest(sample, centres)[0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        n = np.bincount(own, minlength=count)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centre and its distance."""
    own, far = np.zeros(len(rows), np.int32), np.zeros(len(rows))
    half = (centres * centres).sum(1) / 2
    for low in range(0, len(rows), 4096):
        part = rows[low : low + 4096].astype(np.float64)
        own[low : low + 4096] = (half - part @ centres.T).argmin(1)
        far[low : low + 4096] = np.linalg.norm(part - centres[own[low : low + 4096]], axis=1)
    return own, far


def _packed(number: int, rows: pa.Table) -> tuple[list, list]:
    matrix = _matrix(rows["vec"].combine_chunks()).astype(np.float32)
    centre = matrix.mean(0, dtype=np.float64).astype(np.float32)
    # Rounded up, against the rounding of norms and products.
    radius = float(np.linalg.norm(matrix.astype(np.float64) - centre, axis=1).max()) * (1 + 1e-6) + 1e-6
    lists = [rows[c].to_pylist() for c in ("id", "file", "kind", "modality")]
    return [number, rows.num_rows, *lists, matrix.tobytes()], [number, rows.num_rows, centre.tolist(), radius, sorted({m for m in lists[3] if m is not None})]


def build(segments: DataFrame, folder: str) -> None:
    """Writes the index of segments (id, file, kind, modality, sets_scale, vec)."""
    spark = segments.sparkSession
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = segments.select("id", "file", "kind", F.col("modality").cast("string").alias("modality"), "sets_scale", F.col("vec").cast("array<float>").alias("vec")).where(F.col("vec").isNotNull() & finite)
    first = rows.select(F.size("vec").alias("d")).first()
    width = first["d"] if first else 0
    rows = rows.where(F.size("vec") == width)
    count = rows.count() if width else 0
    if not count:
        for name, schema in (("blocks", f"pivot int, {BLOCKS}"), ("heads", HEADS), ("places", PLACES), ("moments", MOMENTS)):
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/{name}")
        return
    sample = _matrix(rows.orderBy(F.xxhash64("id")).limit(SAMPLE).select("vec").toArrow()["vec"].combine_chunks())
    centres = _pivots(sample, min(PIVOTS, len(sample), -(-count // (4 * BLOCK))))
    sent = spark.sparkContext.broadcast(centres)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, far = _nearest(_matrix(batch.column("vec")), sent.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(far)], [*batch.schema.names, "pivot", "distance"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, heading = TaskContext.get().partitionId() << 32, None, [c.split()[0] for c in BLOCKS.split(", ")]

        def given(rows: pa.Table) -> pa.RecordBatch:
            block, head = _packed(number, rows)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([rows["pivot"][0].as_py(), *block, head[2], head[3]], kinds, strict=True)], ["pivot", *heading, "centre", "radius"])

        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.binary(), pa.list_(pa.float32()), pa.float64()]
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            while held.num_rows:
                pivots = held["pivot"].to_numpy()
                run = int((pivots != pivots[0]).argmax()) or held.num_rows
                if run == held.num_rows and run < BLOCK:
                    break
                run = min(run, BLOCK)
                yield given(held.slice(0, run))
                number, held = number + 1, held.slice(run).combine_chunks()
        if held is not None and held.num_rows:
            yield given(held)

    kinds = f"pivot int, {BLOCKS}, centre array<float>, radius double"
    near = rows.mapInArrow(dealt, f"{ROW}, pivot int, distance double").repartitionByRange("pivot", "distance").sortWithinPartitions("pivot", "distance", "id")
    near.mapInArrow(packed, kinds).write.mode("overwrite").partitionBy("pivot").parquet(f"{folder}/blocks")
    blocks = spark.read.schema(f"{kinds}").parquet(f"{folder}/blocks")
    blocks.select("pivot", "block", "n", "centre", "radius", F.array_distinct("modalities").alias("modalities")).write.mode("overwrite").parquet(f"{folder}/heads")
    places = blocks.select(F.explode(F.array_distinct("files")).alias("file"), "pivot", "block")
    places.repartitionByRange("file").sortWithinPartitions("file").write.mode("overwrite").parquet(f"{folder}/places")
    _moments(rows.where("sets_scale"), width).write.mode("overwrite").parquet(f"{folder}/moments")
    sent.unpersist()


def _moments(rows: DataFrame, width: int) -> DataFrame:
    """modality, n, sums, products, in at most a row for each of TASKS / 16 groups of tasks and modality."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            for name in dict.fromkeys(names):
                own = names == name
                if batch.num_columns == 2:
                    x = _matrix(batch.column(1))[own].astype(np.float64)
                    new = [int(own.sum()), x.sum(0), x.T @ x]
                else:
                    some = batch.filter(pa.array(own))
                    new = [sum(some.column(1).to_pylist()), _matrix(some.column(2)).sum(0), _matrix(some.column(3)).sum(0).reshape(width, width)]
                old = held.get(name)
                held[name] = [a + b for a, b in zip(old, new, strict=True)] if old else new
        if held:
            columns = [pa.array(list(held), pa.string()), pa.array([v[0] for v in held.values()]), pa.array([v[1].tolist() for v in held.values()]), pa.array([v[2].ravel().tolist() for v in held.values()])]
            yield pa.RecordBatch.from_arrays(columns, ["modality", "n", "sums", "products"])

    first = rows.select("modality", "vec").coalesce(TASKS).mapInArrow(summed, MOMENTS)
    return first.repartition(max(1, TASKS // 16)).mapInArrow(summed, MOMENTS).coalesce(1).mapInArrow(summed, MOMENTS)


@dataclass(frozen=True)
class Scale:
    """z of a cosine: less its modality's mean and the mean difference, over the pooled deviation."""

    means: dict[str | None, float]
    other: float
    mu: float
    sigma: float

    def shift(self, modality: str | None) -> float:
        return self.means.get(modality, self.other) + self.mu


class VectorIndex:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        read = lambda name, schema: spark.read.schema(schema).parquet(f"{folder}/{name}")
        self.blocks, self.heads, self.places = read("blocks", f"{BLOCKS}, pivot int"), read("heads", HEADS), read("places", PLACES)
        # A row for each modality.
        self.moments = [(r["modality"], r["n"], np.array(r["sums"]), np.array(r["products"])) for r in read("moments", MOMENTS).collect()]
        self.rows = self.heads.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def scale(self, q: list[float]) -> Scale | None:
        """The scale of a query; None where no row sets one."""
        v, total = np.array(q, np.float64), sum(n for _, n, _, _ in self.moments)
        if not total:
            return None
        sums = {m: (n, float(s @ v), float(v @ p.reshape(len(v), -1) @ v)) for m, n, s, p in self.moments}
        overall = sum(s for _, s, _ in sums.values()) / total
        # Rows without modality are measured against all.
        means = {m: s / n if n >= MODALITY_LEAST and m is not None else overall for m, (n, s, _) in sums.items()}
        mu = sum(s - n * means[m] for m, (n, s, _) in sums.items()) / total
        squares = sum(c - 2 * means[m] * s + n * means[m] ** 2 for m, (n, s, c) in sums.items()) / total
        return Scale(means, overall, mu, max(np.sqrt(max(squares - mu * mu, 0.0)), LEAST_SPREAD))

    def _score(self, blocks: DataFrame, q: list[float], scale: Scale, k: int | None, kinds: list[str] | None, hinted: list[str], weight: float, gate: float = -np.inf, files: list[int] | None = None) -> list[tuple]:
        """The best k files of some blocks (all of `files` where k is None), each with its best segment."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v, held = np.array(q, np.float64), []
            for batch in batches:
                for r in batch.to_pylist():
                    cosine = np.frombuffer(r["vectors"], np.float32).reshape(r["n"], -1).astype(np.float64) @ v
                    z = (cosine - np.array([scale.shift(m) for m in r["modalities"]])) / scale.sigma
                    file, segment, kind = np.array(r["files"]), np.array(r["ids"]), np.array(r["kinds"], object)
                    use = np.ones(len(z), bool) if kinds is None else np.isin(kind, kinds)
                    if files is not None:
                        use &= np.isin(file, files)
                    held.append([x[use] for x in (file, segment, z, cosine, kind)])
                    if len(held) > 16:
                        held = [best(held)]
            if held:
                out = best(held)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string()), strict=True)], [c.split()[0] for c in FOUND.split(", ")])

        def best(held: list) -> list:
            file, segment, z, cosine, kind = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((segment, -z, file))
            order = order[np.r_[True, file[order][1:] != file[order][:-1]]] if len(order) else order
            if k is not None:
                order = order[z[order] >= gate]
                value = weight * np.maximum(z[order], 0) + KIND_BONUS * np.isin(kind[order], hinted)
                order = order[np.lexsort((file[order], -value))[:k]]
            return [x[order] for x in (file, segment, z, cosine, kind)]

        # Tasks give k files each.
        rows = blocks.select("n", "ids", "files", "kinds", "modalities", "vectors").mapInArrow(run, FOUND).toArrow()
        if not rows.num_rows:
            return []
        out = best([[rows.column(i).to_numpy() for i in range(5)]])
        return [tuple(x.item() if hasattr(x, "item") else x for x in r) for r in zip(*out, strict=True)]

    def best_files(self, q: list[float], scale: Scale, k: int, kinds: list[str] | None = None, hinted: list[str] = (), weight: float = 1.0, gate: float = -np.inf, small: int = SMALL) -> list[tuple]:
        """(file, segment, z, cosine, kind) of the k files of highest weight * z + bonus, each by its best segment, whose z
        reaches the gate."""
        score = lambda blocks: self._score(blocks, q, scale, k, kinds, list(hinted), weight, gate)
        if self.rows <= small:
            return score(self.blocks)
        v = F.array(*[F.lit(float(x)) for x in q])
        norm = float(np.linalg.norm(np.array(q, np.float64)))
        names = [m for m in scale.means if m is not None]
        shift = lambda m: F.when(m.isNull(), scale.shift(None)).otherwise(F.coalesce(*[F.when(m == name, scale.shift(name)) for name in names], F.lit(scale.other + scale.mu)))
        least = F.array_min(F.transform("modalities", shift))
        z = (dot(F.col("centre"), v) + norm * F.col("radius") - least) / scale.sigma
        bounds = self.heads.where(z >= gate - 1e-9).select("pivot", "block", (weight * F.greatest(z, F.lit(0.0)) + (KIND_BONUS if hinted else 0.0) + 1e-9).alias("bound"))
        near = bounds.orderBy(F.desc("bound"), "block").limit(FIRST).collect()
        found = score(self._some(near))
        value = lambda r: weight * max(r[2], 0.0) + KIND_BONUS * (r[4] in hinted)
        least_value = min(map(value, found)) if len(found) >= k else 0.0
        rest = bounds.where((F.col("bound") >= least_value) & ~F.col("block").isin([r["block"] for r in near]))
        pivots = [r["pivot"] for r in rest.select("pivot").distinct().collect()]
        if pivots:
            # A row for each pivot at most; the blocks meet in a join.
            more = score(self.blocks.where(F.col("pivot").isin(pivots)).join(rest.select("block"), "block", "left_semi"))
            best: dict[int, tuple] = {}
            for r in (*found, *more):
                if r[0] not in best or (r[2], -r[1]) > (best[r[0]][2], -best[r[0]][1]):
                    best[r[0]] = r
            found = sorted(best.values(), key=lambda r: (-value(r), r[0]))[:k]
        return found

    def _some(self, heads: list) -> DataFrame:
        return self.blocks.where(F.col("pivot").isin(sorted({r["pivot"] for r in heads})) & F.col("block").isin([r["block"] for r in heads]))

    def of_files(self, files: list[int], q: list[float], scale: Scale, kinds: list[str] | None = None) -> list[tuple]:
        """The same of some files, which are few."""
        if not files:
            return []
        if self.rows <= SMALL:
            return self._score(self.blocks, q, scale, None, kinds, [], 1.0, files=files)
        at = self.places.where(F.col("file").isin(files)).select("pivot", "block").distinct()
        pivots = [r["pivot"] for r in at.select("pivot").distinct().collect()]
        return self._score(self.blocks.where(F.col("pivot").isin(pivots)).join(at.select("block"), "block", "left_semi"), q, scale, None, kinds, [], 1.0, files=files)
