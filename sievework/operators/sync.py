"""The index in step with its folders: reconcile, moves, pruning, queueing, and the tables' states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rules import is_inside

TOLERANCE = 0.001
#: Rows of a range of the queue, about; the most ranges, about.
BUCKET_ROWS, BUCKETS = 50_000, 500
KIND_ORDER = ["screenshot", "image", "pdf", "doc", "audio", "video", "code"]


def reconcile(stored: DataFrame, crawled: DataFrame, present_roots: list[str] | None = None) -> DataFrame:
    """path, change, old_path: added, changed, moved, removed, unchanged. Both have path, size, mtime, inode, device.

    By path first, then what is left by (device, inode): a file of the same size and time (within a millisecond) at a
    path that is gone has moved. A stored file counts once, for the first crawled path. Of rows that repeat a path, on
    either side, the one with the least inode counts (then device, size, time). Files under a root that is not there now
    are not removed."""
    facts = ("inode", "device", "size", "mtime")
    once = lambda rows: rows.groupBy("path").agg(F.min(F.struct(*facts)).alias("f")).select("path", "f.*")
    crawled, stored = once(crawled), once(stored)
    s = stored.select(F.col("path").alias("s_path"), *[F.col(c).alias(f"s_{c}") for c in facts])
    both = crawled.join(s, crawled["path"] == s["s_path"], "full_outer")
    same = (F.col("size") == F.col("s_size")) & (F.abs(F.col("mtime") - F.col("s_mtime")) <= TOLERANCE)
    known = both.where("path is not null and s_path is not null").select("path", F.when(same, "unchanged").otherwise("changed").alias("change"), F.lit(None).cast("string").alias("old_path"))
    new = both.where("s_path is null").select("path", "size", "mtime", "inode", "device")
    gone = both.where("path is null").select("s_path", "s_size", "s_mtime", "s_inode", "s_device")
    match = (new["inode"] == gone["s_inode"]) & (new["device"] == gone["s_device"]) & (new["size"] == gone["s_size"]) & (F.abs(new["mtime"] - gone["s_mtime"]) <= TOLERANCE)
    pairs = new.join(gone, match).select("path", "s_path")
    pairs = pairs.withColumn("a", F.row_number().over(Window.partitionBy("s_path").orderBy("path"))).where("a = 1")
    pairs = pairs.withColumn("b", F.row_number().over(Window.partitionBy("path").orderBy("s_path"))).where("b = 1")
    moved = pairs.select("path", F.lit("moved").alias("change"), F.col("s_path").alias("old_path"))
    added = new.join(pairs, "path", "left_anti").select("path", F.lit("added").alias("change"), F.lit(None).cast("string").alias("old_path"))
    removed = gone.join(pairs, "s_path", "left_anti")
    if present_roots is not None:
        removed = removed.where(_under(F.col("s_path"), present_roots))
    removed = removed.select(F.col("s_path").alias("path"), F.lit("removed").alias("change"), F.lit(None).cast("string").alias("old_path"))
    return known.unionByName(moved).unionByName(added).unionByName(removed)


def _under(path: Column, roots: list[str]) -> Column:
    found = F.lit(False)
    for root in roots:
        found = found | (path == root) | is_inside(path, F.lit(root))
    return found


def pruned(files: DataFrame, roots: list[str]) -> DataFrame:
    """Files under one of the roots; whole components, so /ab isn't under /a."""
    return files.where(_under(F.col("path"), roots))


def in_scope(path: Column, roots: list[str]) -> Column:
    """Path ranges as prefix tests, which reach the Parquet scan; no root, no row."""
    return _under(path, roots)


def requeued(files: DataFrame, segments: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changed files are pending again and keep only their name segments."""
    marks = changed.select("path").distinct().withColumn("again", F.lit(True))
    files = files.join(marks, "path", "left").withColumn("state", F.when(F.col("again"), "pending").otherwise(F.col("state"))).drop("again")
    again = files.where("state = 'pending'").select(F.col("id").alias("file"))
    kept = segments.where("kind = 'name'").unionByName(segments.where("kind <> 'name'").join(again, "file", "left_anti"))
    return files, kept


def stopped(state: Column, pages: Column) -> Column:
    """A file whose reading stopped: what has pages is done, the rest failed."""
    return F.when((state == "partial") | (pages > 0), "done").otherwise("failed")


def queue(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Pending files in the order of indexing: by kind, newest first."""
    rank = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(KIND_ORDER)], F.lit(len(KIND_ORDER)))
    pending = files.where("state = 'pending'").orderBy(rank, F.desc("mtime"), "id")
    return pending if limit is None else pending.limit(limit)


def batches(queued: DataFrame, order: str, size: int = 8) -> DataFrame:
    """Runs of one kind cut into batches, over a queue of any length.

    Ranges of `order` are numbered each on its own; from a row for each range follow the runs before it and the rows
    that its first run has in earlier ranges."""
    # Bounds by hash, the same each time that the plan runs: every BUCKET_ROWS-th row or so, about BUCKETS at most.
    n = queued.count()
    step = max(BUCKET_ROWS, -(-n // BUCKETS))
    bounds = sorted(r[0] for r in queued.where(F.pmod(F.xxhash64(order), F.lit(step)) == 0).select(order).dropna().distinct().collect()) if n > step else []
    before = F.filter(F.array(*map(F.lit, bounds)), lambda x: x <= F.col(order)) if bounds else F.array()
    w = Window.partitionBy("__range").orderBy(order)
    new = lambda earlier, kind: F.coalesce((earlier != kind).cast("int"), F.lit(0))
    rows = queued.withColumn("__range", F.size(before)).withColumn("__new", new(F.lag("kind").over(w), F.col("kind")))
    rows = rows.withColumn("__run", F.sum("__new").over(w)).drop("__new")
    ends = F.struct(F.col(order).alias("at"), F.col("kind").alias("kind"))
    runs = rows.groupBy("__range", "__run").agg(F.count(F.lit(1)).alias("rows"), F.min(ends).alias("first"), F.max(ends).alias("last"))
    ranges = runs.groupBy("__range").agg(F.max("__run").alias("changes"), F.max_by("rows", "__run").alias("tail"), F.min_by("first", "__run")["kind"].alias("first"), F.max_by("last", "__run")["kind"].alias("last"))
    # A row for each range.
    w = Window.orderBy("__range")
    ranges = ranges.withColumn("new", new(F.lag("last").over(w), F.col("first")))
    ranges = ranges.withColumn("since", F.sum(F.when((F.col("new") > 0) | (F.col("changes") > 0), 1).otherwise(0)).over(w))
    ranges = ranges.withColumn("trailing", F.sum("tail").over(Window.partitionBy("since").orderBy("__range")))
    carried = F.when(F.col("new") > 0, 0).otherwise(F.coalesce(F.lag("trailing").over(w), F.lit(0)))
    ranges = ranges.select("__range", (F.sum(F.col("new") + F.col("changes")).over(w) - F.col("changes")).alias("__before"), carried.alias("__carried"))
    place = F.row_number().over(Window.partitionBy("__range", "__run").orderBy(order)) + F.when(F.col("__run") == 0, F.col("__carried")).otherwise(0)
    out = rows.join(F.broadcast(ranges), "__range").withColumn("run", F.col("__before") + F.col("__run"))
    return out.withColumn("batch", F.floor((place - 1) / size)).drop("__range", "__run", "__before", "__carried")


def counts(files: DataFrame) -> DataFrame:
    return files.groupBy("kind", "state").agg(F.count(F.lit(1)).alias("n"))


def unfinished(files: DataFrame) -> DataFrame:
    """Partly read files and what is left of them, from the strings of their info map."""
    left = F.greatest(F.lit(0), F.col("info")["read_end"].cast("long") - F.col("info")["read_to"].cast("long"))
    return files.where("state = 'partial'").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(left), F.lit(0)).alias("left"))


def upserted(meta: DataFrame, changes: DataFrame) -> DataFrame:
    """key, value: the changes win."""
    both = meta.withColumn("rank", F.lit(1)).unionByName(changes.withColumn("rank", F.lit(0)))
    return both.groupBy("key").agg(F.min_by("value", "rank").alias("value"))
