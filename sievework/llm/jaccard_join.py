"""N-gram Jaccard self-join as a blocked sparse matrix product of the document by n-gram incidence.

Only rows of the incidence matrix that can pass the threshold meet in a block:

1. Documents with the same set are one row of the matrix (they are linked with each other).
2. Sets whose sizes differ too much for the threshold never meet: a set belongs to a size class, and near a class's
   upper bound to the next one as well. Two sets of one class that pass differ in at most d n-grams, where d follows
   from the class's sizes. The class cuts the hash range into more than d / 2 parts, so in some part two such sets
   differ in one n-gram at most, and agree on all but one of its sub-parts. Each part has a key for each sub-part left
   out, the others' content; on one of them the two sets meet. Keys hold five n-grams or more, so a passage that many
   documents share seldom brings them together.
3. Sets that share a key are first compared by parity sketches, whose distance is a lower bound on the sets' own: each
   with the first set of its bucket; then, in buckets whose sets are not all tied together yet, all with all, in blocks.
   What sketches leave possible ties sets to groups; a shared passage, whose sets are far apart, ties nothing. The groups
   are the blocks of the product; a group larger than a block is cut into size bands and chunks, of which only equal or
   neighbouring bands are multiplied.
4. Within a block the product is accumulated over slabs of n-gram columns; pairs whose overlap is below the bound of
   their two sizes are discarded, the others are links. A block returns, for each row, its number of links and the
   least row that it reaches; components then join the blocks' results.

Every pair at or above the threshold is found; nothing is capped or sampled. Work is in proportion to the text but for
groups of near copies, whose own product (not its pairs) is spread over tasks of bounded size.

Defined cases: a text without words (or null) has an empty set, no links, and itself as its component; a text with
fewer words than the window has its whole sequence as its one n-gram; each row is a document of its own, so rows that
repeat an id are linked and named by their own texts; a null id has no links and a null component, and its row stays;
rows that repeat an id and a text stay or go together; an empty table gives an empty result; other columns, whatever
their names, stay as they are.

N-grams are compared by 52-bit hashes within a pair of documents: two different n-grams of a pair of 400-word texts
agree with a probability of about 4e-11.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .graph import components
from .shared import discard, free_names, read, small_batches, small_side, tidy, written

WINDOW = 3
#: A threshold of UP / DOWN = 0.9.
UP, DOWN = 90, 100
#: Documents, n-grams in a chunk; n-gram columns in a slab of the product.
CHUNK, CHUNK_GRAMS, SLAB = 128, 1_000_000, 4096
#: Least bits of a sketch (a power of two); rows and n-grams of a chunk of sketches.
SKETCH, WIDE_CHUNK, WIDE_GRAMS = 256, 1024, 8_000_000
#: Sub-parts of a part of the hash range.
SUBS = 3
U64 = np.uint64


class Classes:
    """Size classes [low, next low) with the number of parts of the hash range."""

    def __init__(self, up: int = UP, down: int = DOWN, ratio: float = 1.4, largest: int = 1 << 40):
        self.up, self.down = up, down
        # Sets that pass are at most a class apart.
        ratio = max(ratio, down / up)
        lows = [1]
        while lows[-1] < largest:
            lows.append(max(lows[-1] + 1, int(lows[-1] * ratio)))
        self.lows = np.array(lows, np.int64)
        # A pair passes when down * i >= up * (a + b - i), so a + b - 2 * i <= (a + b) * (down - up) / (down + up).
        most = 2 * (self.lows[1:] - 1) * (down - up) // (down + up)
        # At most half of so many differences' parts hold two or more of them. Parts to spare for those with an empty
        # key: what the class's smallest set has by chance, and some more.
        self.spare = 2 + most // 100
        for _ in range(6):
            parts = most // 2 + 1 + self.spare
            empty = parts * SUBS * np.exp(-self.lows[:-1] / parts * (SUBS - 1) / SUBS)
            self.spare = np.minimum(np.ceil(empty + 4 * np.sqrt(empty) + 1).astype(np.int64), most // 2 + 2)
        #: No parts: such small sets pass only if they are equal.
        self.parts = np.where(most > 0, most // 2 + 1 + self.spare, 0)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lows, n, "right") - 1

    def reaches_next(self, n: np.ndarray, cls: np.ndarray) -> np.ndarray:
        return n * self.down >= self.up * self.lows[cls + 1]


def _keys_in(cls: Classes, grams: np.ndarray, owner: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and texts; label: each text's class, -1 for none. grams are sorted by text and hash."""
    use = label[owner] >= 0
    grams, owner = grams[use], owner[use]
    if not len(grams):
        return grams, owner
    fine = (((grams >> U64(20)) * (cls.parts[label[owner]] * SUBS).astype(np.uint64)) >> U64(32)).astype(np.int64)
    at = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (fine[1:] != fine[:-1]))))
    text, part, sub = owner[at], fine[at] // SUBS, fine[at] % SUBS
    content = tk.mix(np.add.reduceat(tk.mix(grams + U64(0x51ED2701)), at) + sub.astype(np.uint64))
    new = np.concatenate(([True], (text[1:] != text[:-1]) | (part[1:] != part[:-1])))
    row = np.cumsum(new) - 1
    held, filled = np.zeros((row[-1] + 1, SUBS), np.uint64), np.zeros((row[-1] + 1, SUBS), np.int64)
    held[row, sub], filled[row, sub] = content, 1
    text, part = text[new], part[new]
    name = lambda c, p, j: tk.mix((c.astype(np.uint64) << U64(40) | p.astype(np.uint64)) * U64(SUBS) + U64(j))
    keys, who, hollow = [], [], np.zeros(len(text), bool)
    for j in range(SUBS):
        # All but one sub-part.
        full = filled.sum(1) > filled[:, j]
        hollow |= ~full
        key = tk.mix(held.sum(1, dtype=np.uint64) - held[:, j] + name(label[text], part, j))
        keys.append(key[full])
        who.append(text[full])
    # A set with more hollow parts than its class has to spare may agree with another on empty keys alone.
    texts, rows, empty = *np.unique(text, return_counts=True), np.bincount(text, hollow)
    missing = cls.parts[label[texts]] - rows + empty[texts].astype(np.int64)
    for t in texts[missing > cls.spare[label[texts]]]:
        own = np.flatnonzero(text == t)
        sizes = np.zeros((int(cls.parts[label[t]]), SUBS), np.int64)
        sizes[part[own]] = filled[own]
        for j in range(SUBS):
            hole = np.flatnonzero(sizes.sum(1) == sizes[:, j])
            keys.append(tk.mix(name(np.full(len(hole), label[t]), hole, j) + U64(0xE3779B)))
            who.append(np.full(len(hole), t))
    return np.concatenate(keys), np.concatenate(who)


def _sets(piece: tk.Texts, window: int) -> tuple[np.ndarray, np.ndarray]:
    low = piece.lowered()
    starts, ends, text_of = low.words()
    return tk.sets(*tk.windows(low.hashes(starts, ends), text_of, window, piece.n, short=True))


def _set_keys(grams: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's whole set."""
    key1, key2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    if len(grams):
        at = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        key1[owner[at]] = np.add.reduceat(tk.mix(grams + U64(1)), at)
        key2[owner[at]] = np.add.reduceat(tk.mix(grams ^ U64(0xA5A5A5A5A5A5)), at)
    return key1, key2


def _sketches(grams: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """For each text about as many bits as n-grams, each the parity of the n-grams hashed to it: two sets' sketches
    differ in at most as many bits as the sets do in n-grams. A longer sketch folds to a shorter one."""
    bits = np.left_shift(1, np.ceil(np.log2(np.maximum(sizes, SKETCH))).astype(np.int64))
    ends = np.cumsum(bits)
    bit = (tk.mix(grams + U64(0x5CE7C4)) & (bits[owner] - 1).astype(np.uint64)).astype(np.int64) + (ends - bits)[owner]
    parity = np.bincount(bit, minlength=int(ends[-1]) if len(ends) else 0) & 1
    offsets = np.concatenate(([0], ends // 8)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.packbits(parity.astype(np.uint8)).tobytes())])


def _folded(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches cut to `size` bytes, a power of two that none falls short of."""
    out = np.empty((len(sketches), size), np.uint8)
    for i, s in enumerate(sketches):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(s, np.uint8).reshape(-1, size), axis=0)
    return out


def _may_pass(differ: np.ndarray, n: np.ndarray, m: np.ndarray, up: int, down: int) -> np.ndarray:
    """Whether sets of n and m n-grams that differ in at least `differ` may reach the threshold."""
    return (differ * (up + down) <= (down - up) * (n + m)) & (np.minimum(n, m) * down >= up * np.maximum(n, m))


def _described(window: int):
    """Rows (id, text, digest) to (id, digest, n, key1, key2, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tk.pieces(batch.column(1)):
                grams, owner = _sets(piece, window)
                key1, key2 = _set_keys(grams, owner, piece.n)
                sizes = tk.counts_of(owner, piece.n)
                own = [batch.column(k).slice(piece.first, piece.n) for k in (0, 2)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(sizes), pa.array(key1.view(np.int64)), pa.array(key2.view(np.int64)), _sketches(grams, owner, sizes)], ["id", "digest", "n", "key1", "key2", "sketch"])

    return run


def _keyed(window: int, cls: Classes):
    """Rows (text) to (part, node): the keys of each different set, whose node is its first hash. A task gives a set's
    keys once, however many copies it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for piece in tk.pieces(batch.column(0)):
                grams, owner = _sets(piece, window)
                n = tk.counts_of(owner, piece.n)
                node = _set_keys(grams, owner, piece.n)[0].view(np.int64)
                new = np.zeros(piece.n, bool)
                for i, key in enumerate(node.tolist()):
                    if n[i] and key not in seen:
                        new[i] = True
                        seen.add(key)
                if len(seen) > 2_000_000:
                    seen.clear()
                own = cls.of(np.maximum(n, 1))
                usable = new & (cls.parts[own] > 0)
                after = new & cls.reaches_next(n, own) & (cls.parts[own + 1] > 0)
                found = [_keys_in(cls, grams, owner, np.where(mask, c, -1)) for mask, c in ((usable, own), (after, own + 1))]
                keys, who = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(node[who])], ["part", "node"])

    return run


def _checked(up: int, down: int):
    """Rows (a, b, n, m, sketch, other) to those pairs (a, b) that may pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            one, two = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            size = np.array([min(len(x), len(y)) for x, y in zip(one, two, strict=True)], np.int64)
            differ = np.zeros(len(size), np.int64)
            for width in np.unique(size):
                at = np.flatnonzero(size == width)
                odd = _folded([one[i] for i in at], width) ^ _folded([two[i] for i in at], width)
                differ[at] = np.bitwise_count(odd).sum(1, dtype=np.int64)
            keep = pa.array(_may_pass(differ, n, m, up, down))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], ["a", "b"])

    return run


def _product(grams: list[np.ndarray], side: np.ndarray, up: int, down: int) -> np.ndarray:
    """Links as a boolean matrix. side: with both 0 and 1, only pairs across sides count."""
    sizes = np.array([len(g) for g in grams], np.int64)
    row = np.repeat(np.arange(len(grams)), sizes)
    _, column, uses = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    shared = uses > 1
    column, row = (np.cumsum(shared) - 1)[column[shared[column]]], row[shared[column]]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    overlap = np.zeros((len(grams), len(grams)), np.float32)
    for at in range(0, int(shared.sum()), SLAB):
        lo, hi = np.searchsorted(column, (at, at + SLAB))
        slab = np.zeros((len(grams), SLAB), np.float32)
        slab[row[lo:hi], column[lo:hi] - at] = 1
        overlap += slab @ slab.T
    total = sizes[:, None] + sizes[None, :]
    links = overlap.astype(np.int64) * (up + down) >= up * total
    np.fill_diagonal(links, False)
    if len(np.unique(side)) > 1:
        links &= side[:, None] != side[None, :]
    return links


def _least_reached(links: np.ndarray, ids: np.ndarray) -> np.ndarray:
    low = ids.copy()
    while True:
        new = np.minimum(low, np.where(links, low[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new == low).all():
            return low
        low = new


def _possible(up: int, down: int):
    """Blocks of rows with sketches to (id, low): low is the least row that it reaches by pairs that may pass."""

    def block(table: pa.Table) -> pa.RecordBatch:
        ids, n, side = (table[c].to_numpy() for c in ("id", "n", "side"))
        sketches = table["sketch"].to_pylist()
        packed = _folded(sketches, min(map(len, sketches)))
        alike = np.zeros((len(ids), len(ids)), np.float32)
        for at in range(0, packed.shape[1], SLAB // 8):
            signs = np.unpackbits(packed[:, at : at + SLAB // 8], axis=1).astype(np.float32) * 2 - 1
            alike += signs @ signs.T
        pairs = _may_pass(((8 * packed.shape[1] - alike) / 2).astype(np.int64), n[:, None], n[None, :], up, down)
        if len(np.unique(side)) > 1:
            pairs &= side[:, None] != side[None, :]
        low = _least_reached(pairs, ids)
        tied = low < ids
        return pa.RecordBatch.from_arrays([pa.array(ids[tied]), pa.array(low[tied])], ["id", "low"])

    return _by_block(block)


def _linked(window: int, up: int, down: int):
    """Blocks of rows with texts to (id, low, links). Rows with the same id and another text go."""

    def block(table: pa.Table) -> pa.RecordBatch:
        grams: list[np.ndarray] = []
        found_id: list[np.ndarray] = []
        for piece in tk.pieces(table["text"]):
            found, owner = _sets(piece, window)
            grams += np.split(found, np.cumsum(tk.counts_of(owner, piece.n))[:-1])
            found_id.append(_set_keys(found, owner, piece.n)[0].view(np.int64))
        ids, copies, side = (table[c].to_numpy() for c in ("id", "copies", "side"))
        own = np.flatnonzero(np.concatenate(found_id) == ids)
        # Rows that repeat an id and a text come more than once.
        own = own[np.unique(ids[own] * 2 + side[own], return_index=True)[1]]
        ids, copies = ids[own], copies[own]
        links = _product([grams[i] for i in own], side[own], up, down) if len(own) else np.zeros((0, 0), bool)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(_least_reached(links, ids)), pa.array(links @ copies)], ["id", "low", "links"])

    return _by_block(block)


def _by_block(of_table):
    """Rows sorted by (root, band, x, y), whole blocks in turn; `of_table` gets each block's rows."""

    def block(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        return of_table(pa.Table.from_batches(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        held_key = None
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(4)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if held and tuple(keys[lo]) != held_key:
                    yield block(held)
                    held = []
                held, held_key = [*held, batch.slice(lo, hi - lo)], tuple(keys[lo])
        if held:
            yield block(held)

    return run


def _sized(members: DataFrame, chunk: int, grams: int) -> DataFrame:
    """members (root, id, n, ...) with `fits`: whether their group is no larger than a block."""
    whole = members.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("grams"))
    return members.join(whole, "root").withColumn("fits", (F.col("m") <= chunk) & (F.col("grams") <= 2 * grams))


def _blocks(members: DataFrame, chunk: int, grams: int, up: int, down: int, kept: tuple[str, ...]) -> DataFrame:
    """`_sized` members to (root, band, x, y, side, *kept): each pair of sets that can pass at up / down is in one block.
    chunk, grams: what a chunk of a group that doesn't fit holds."""
    none = F.lit(0)
    small = members.where("fits").select("root", none.alias("band"), none.alias("x"), none.alias("y"), none.alias("side"), *kept)
    # Sizes that differ by more than one band are further apart than the threshold allows. Bands are a little wider than
    # down / up, so that rounding can't part sizes that are just so far apart.
    width = float(np.log(down / up) + 1e-6)
    large = members.where("not fits").withColumn("b", F.floor(F.log("n") / F.lit(width)).cast("int"))
    bands = large.groupBy("root", "b").agg(F.greatest(F.ceil(F.count(F.lit(1)) / chunk), F.ceil(F.sum("n") / grams)).cast("int").alias("chunks"))
    bands = written(bands, "ngram-bands")
    near = lambda by, name: bands.select("root", (F.col("b") + by).alias("b"), F.col("chunks").alias(name))
    around = bands.join(near(-1, "above"), ["root", "b"], "left").join(near(1, "below"), ["root", "b"], "left")
    large = large.join(small_side(written(around, "ngram-bands")), ["root", "b"])
    x = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    to = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), f)).otherwise(F.array().cast("array<struct<band:int,x:int,y:int,side:int>>"))
    place = lambda band, i, j, side: F.struct(band.cast("int").alias("band"), i.alias("x"), j.alias("y"), side.cast("int").alias("side"))
    large = large.withColumn("c", x)
    within = to(F.col("chunks"), lambda y: place(2 * F.col("b") + 2, F.least("c", y), F.greatest("c", y), F.when(F.col("c") > y, 1).otherwise(0)))
    upward = to(F.coalesce("above", none), lambda y: place(2 * F.col("b") + 3, F.col("c"), y, F.lit(0)))
    downward = to(F.coalesce("below", none), lambda y: place(2 * F.col("b") + 1, y, F.col("c"), F.lit(1)))
    large = large.select("root", F.explode(F.concat(within, upward, downward)).alias("p"), *kept)
    return small.union(large.select("root", "p.band", "p.x", "p.y", "p.side", *kept))


ORDER = ("root", "band", "x", "y")


def _tied(keyed: DataFrame, rows: DataFrame, up: int, down: int) -> DataFrame:
    """A written table (node, component) of the sets that sketches leave together: keyed (part, node), rows (node, n, sketch)."""
    earlier = F.expr("min(node) over (partition by part order by node rows between unbounded preceding and current row)")
    later = keyed.select("part", "node", earlier.alias("first")).where("first < node").distinct()
    # Buckets with the same sets are one bucket, named by a hash of those after the first.
    bucket = "over (partition by part)"
    later = later.select("first", "node", F.expr(f"bit_xor(xxhash64(node)) {bucket}").alias("rest"), F.expr(f"count(1) {bucket}").alias("size"))
    met = written(later.distinct(), "ngram-met")

    # Every set with the first of its bucket.
    stars = met.select("first", "node").distinct()
    stars = stars.join(rows.select(F.col("node").alias("first"), F.col("n").alias("m"), F.col("sketch").alias("other")), "first").join(rows, "node")
    near = written(stars.select("first", "node", "m", "n", "other", "sketch").mapInArrow(tidy(_checked(up, down)), "a long, b long"), "ngram-near")
    tied = components(near, "a", "b")

    # Buckets of three or more sets, not all of one component yet.
    wide = met.where("size > 1").select("first", "rest", "node")
    wide = wide.union(wide.select("first", "rest", F.col("first").alias("node")).distinct()).join(small_side(tied), "node", "left")
    wide = wide.select(F.xxhash64("first", "rest").alias("root"), F.col("node").alias("id"), F.coalesce("component", "node").alias("component"))
    apart = wide.groupBy("root").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("root")
    wide = wide.join(apart, "root").join(rows, F.col("id") == F.col("node")).select("root", "id", "n", "sketch")
    wide = written(_sized(wide, WIDE_CHUNK, WIDE_GRAMS), "ngram-wide")
    blocks = _blocks(wide, WIDE_CHUNK, WIDE_GRAMS, up, down, ("id", "n", "sketch")).repartition(*ORDER).sortWithinPartitions(*ORDER)
    more = written(blocks.select(*ORDER, "side", "id", "n", "sketch").mapInArrow(tidy(_possible(up, down)), "id long, low long"), "ngram-more")
    out = components(near.union(more), "a", "b")
    discard(met, near, tied, wide, more)
    return out


def _judged(docs: DataFrame, id_col: str, text_col: str, window: int, up: int, down: int) -> DataFrame:
    """One row for each input row: id, digest (of its text), n, component_id, n_links, stays."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sets = texts.withColumn("digest", F.xxhash64("text")).mapInArrow(tidy(_described(window)), "id long, digest long, n long, key1 long, key2 long, sketch binary")
    sets = written(sets, "ngram-sets")
    same = ["key1", "key2", "n"]
    rows = sets.where("n > 0 and id is not null").groupBy(*same).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch"))
    rows = written(rows, "ngram-rows")

    keyed = texts.where("id is not null").select("text").mapInArrow(tidy(_keyed(window, Classes(up, down))), "part long, node long")
    groups = _tied(keyed, rows.select(F.col("key1").alias("node"), "n", "sketch"), up, down)
    members = groups.join(rows.drop("sketch"), groups["node"] == rows["key1"]).select(F.col("component").alias("root"), F.col("node").alias("id"), "rep", "n", "copies")
    members = written(_sized(members, CHUNK, CHUNK_GRAMS), "ngram-members")
    blocks = written(_blocks(members, CHUNK, CHUNK_GRAMS, up, down, ("id", "rep", "copies")), "ngram-blocks")
    loaded = texts.withColumnRenamed("id", "rep").join(small_side(blocks), "rep").select(*ORDER, "side", "id", "copies", "text")
    loaded = loaded.repartition(*ORDER).sortWithinPartitions(*ORDER)
    linked = written(loaded.mapInArrow(tidy(_linked(window, up, down)), "id long, low long, links long"), "ngram-links")

    # A class is named by its least id; of the sets with that id, the one with the least hashes stays.
    found = components(linked, "low", "id")
    links = linked.groupBy(F.col("id").alias("node")).agg(F.sum("links").alias("links")).join(small_side(found), "node")
    links = written(links, "ngram-counts")
    tied = rows.select(*same, "rep").join(small_side(links), rows["key1"] == links["node"])
    best = written(tied.groupBy("component").agg(F.min(F.struct("rep", "key1", "key2")).alias("of")).selectExpr("component", "of.rep best_id", "of.key1 best1", "of.key2 best2"), "ngram-best")
    tied = written(tied.select(*same, "links", "component").join(small_side(best), "component").drop("component"), "ngram-tied")
    classes = rows.select(*same, "rep", "copies").join(small_side(tied), same, "left")
    own = {"best_id": "rep", "best1": "key1", "best2": "key2"}
    classes = classes.select(*same, *[F.coalesce(c, other).alias(c) for c, other in own.items()], (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    classes = written(classes, "ngram-classes")
    discard(groups, members, blocks, linked, rows, found, links, best, tied)
    out = sets.select("id", "digest", *same).join(small_side(classes), same, "left")
    alone = F.col("id").isNull() | F.col("best_id").isNull()
    stays = alone | ((F.col("id") == F.col("best_id")) & (F.col("key1") == F.col("best1")) & (F.col("key2") == F.col("best2")))
    return out.select("id", "digest", "n", F.when(alone, F.col("id")).otherwise(F.col("best_id")).alias("component_id"), F.when(alone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"), stays.alias("stays"))


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, up: int = UP, down: int = DOWN) -> DataFrame:
    """One row for each input row: id, n_shingles, component_id, n_links (documents linked with it, copies included).
    Two documents link when down * intersection >= up * union."""
    found = _judged(docs, id_col, text_col, window, up, down)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "n_links")


def keep_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, up: int = UP, down: int = DOWN) -> DataFrame:
    """One document of each class stays: the one that names it. Documents without an id or without words stay."""
    gone, digest = free_names(docs, "gone", "digest")
    drop = _judged(docs, id_col, text_col, window, up, down).where("not stays").select(F.col("id").alias(gone), F.col("digest").alias(digest)).distinct()
    drop = small_side(written(drop, "ngram-drop"))
    return docs.join(drop, (docs[id_col].cast("long") == drop[gone]) & (F.xxhash64(docs[text_col]) == drop[digest]), "left_anti")


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(read(spark, sf_dir))
