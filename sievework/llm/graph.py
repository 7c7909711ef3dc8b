"""Connected components of a graph in a DataFrame.

Each task first contracts the edges that it holds to a forest (node, least node of its tree), which shrinks a graph of
many edges to a few for each node. A forest of `FEW` edges at most, a few ten MB, is finished by one task; a larger one
goes through alternating large and small stars, contracted by tasks after each round, until it fits or doesn't change.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, tidy, written

#: Edges that one task finishes; edges that a task holds before it contracts them.
FEW, HELD = 2_000_000, 1_000_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (u, v), and the least node that each reaches."""
    nodes, place = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _contracted(whole: bool):
    """Edges (u, v) to (node, least): every node's (whole), or only those that aren't the least of their tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size > HELD:
                # What the contraction leaves doesn't count, or a large forest would be contracted again and again.
                held, size = [forest(*map(np.concatenate, zip(*held, strict=True)))], 0
        nodes, least = forest(*map(np.concatenate, zip(*held, strict=True)))
        use = slice(None) if whole else nodes != least
        yield pa.RecordBatch.from_arrays([pa.array(nodes[use]), pa.array(least[use])], ["u", "v"])

    return run


def _with_least(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with the least neighbour of u. The minimum is combined in map tasks; adaptive execution splits
    the join where one node has very many edges."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    linked = _with_least(edges).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
    return linked.select("e.*").where("u > v").distinct()


def components(edges: DataFrame, a: str, b: str, few: int | None = None) -> DataFrame:
    """A written table (node, component) for each node of an edge of longs: component is the least node reachable.
    Self-edges are ignored."""
    few = FEW if few is None else few
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v")
    pairs, before = written(pairs.mapInArrow(tidy(_contracted(False)), "u long, v long"), "edges"), None
    named = lambda df: df.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        count, mark = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if count <= few:
            out = written(named(pairs.coalesce(1).mapInArrow(tidy(_contracted(True)), "u long, v long")), "components")
            break
        if (count, mark) == before:
            out = written(named(pairs.union(pairs.select("v", "v").distinct())), "components")
            break
        before, old = (count, mark), pairs
        pairs = written(_small_star(_large_star(old)).mapInArrow(tidy(_contracted(False)), "u long, v long"), "stars")
        discard(old)
    discard(pairs)
    return out
