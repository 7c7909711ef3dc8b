"""The index's upkeep: versions, fingerprints, resumable long files, summaries, records of trouble."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.passages import page_problem
from sievework.functions.text import has_words, normalized

from .sync import KIND_ORDER, in_scope

#: Kinds of segments that are pages, steps and caps of long files.
PAGE_KINDS = ["page", "page_image", "chunk"]
PDF_STEP, DOC_STEP, MOST_PAGES, MOST_CHUNKS = 30, 40, 5000, 5000
INDEXED = ["done", "partial"]


# --- fingerprints and vector sources ------------------------------------------------------------------------------


def fingerprint(source: str, photo: int = 140, screenshot: int = 280, page: int = 280, frame: int = 70, interval: float = 3.0, window: float = 30.0, hop: float = 25.0, code_stretch: int | None = None) -> str:
    """What an index's vectors depend on, besides the model."""
    settings = f"code1 lines{code_stretch}" if code_stretch else f"photo{photo} shot{screenshot} page{page} frame{frame}/{interval}s audio{window}/{hop}s"
    return f"{source} | {settings}"


class FingerprintError(ValueError):
    """The index was made with another model or other settings."""


def adopt(stored: str | None, now: str, reset: Callable[[], None] | None = None) -> bool:
    """Whether the index had to be emptied for a new fingerprint; without `reset` that is an error."""
    if stored is None or stored == now:
        return False
    if reset is None:
        raise FingerprintError(f"the index has {stored}, now it is {now}")
    reset()
    return True


def usable_vector(indexed: str | None, source: str) -> tuple[bool, str | None]:
    """Whether a query's vector may meet the index's, and a warning if not."""
    if indexed is None or indexed == source:
        return True, None
    return False, f"meaning search is off: the index was built with {indexed}, the encoder is {source}"


class QueryVectors:
    """A query's vector, kept for the last queries; code queries have their own."""

    def __init__(self, embed: Callable[[str, bool], list[float]], most: int = 256):
        self.embed, self.most, self.kept = embed, most, {}

    def of(self, text: str, code: bool = False) -> list[float]:
        key = (code, text)
        if key not in self.kept:
            vector = self.embed(text, code)
            if len(self.kept) > self.most:
                self.kept.clear()
            self.kept[key] = vector
        return self.kept[key]


# --- summaries -----------------------------------------------------------------------------------------------------


def status(files: DataFrame) -> DataFrame:
    """files, searchable, pending, unfinished."""
    n = lambda *states: F.coalesce(F.sum(F.when(F.col("state").isin(*states), 1).otherwise(0)), F.lit(0)).alias
    return files.agg(F.count(F.lit(1)).alias("files"), n(*INDEXED)("searchable"), n("pending")("pending"), n("partial")("unfinished"))


def root_summaries(files: DataFrame, roots: list[str]) -> DataFrame:
    """For each root its files by state, kinds and reasons why some were skipped once read."""
    held = files.withColumn("root", F.explode(F.filter(F.array(*map(F.lit, roots)), lambda r: (F.col("path") == r) | F.col("path").startswith(F.concat(r, F.lit("/"))))))
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    s = F.col("state")
    skipped = ~s.isin("done", "partial", "pending", "failed")
    counted = held.groupBy("root").agg(
        F.count(F.lit(1)).alias("files"), n(s.isin(*INDEXED)).alias("indexed"), n(s == "pending").alias("pending"), n(s == "failed").alias("failed"), n(skipped).alias("skipped"), n(s == "partial").alias("unfinished")
    )
    pairs = lambda of, name, rows: rows.groupBy("root", of.alias("key")).agg(F.count(F.lit(1)).alias("n")).groupBy("root").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n")))).alias(name))
    kinds, reasons = pairs(F.col("kind"), "kinds", held), pairs(F.coalesce("detail", F.lit("not read")), "skipped_reasons", held.where(skipped))
    return counted.join(kinds, "root").join(reasons, "root", "left")


def segment_counts(segments: DataFrame, files: DataFrame | None = None, roots: list[str] | None = None) -> DataFrame:
    """segments, vectors: all but names, within a scope."""
    rows = segments.where("kind <> 'name'")
    if roots is not None:
        rows = rows.join(files.where(in_scope(F.col("path"), roots)).select(F.col("id").alias("file")), "file", "left_semi")
    return rows.agg(F.count(F.lit(1)).alias("segments"), F.count("vec").alias("vectors"))


def pending_count(files: DataFrame) -> DataFrame:
    return files.where("state = 'pending'").agg(F.count(F.lit(1)).alias("n"))


def last_places(segments: DataFrame) -> DataFrame:
    """file, last: the last page or chunk stored."""
    return segments.where(F.col("kind").isin(PAGE_KINDS)).groupBy("file").agg(F.max("loc").cast("long").alias("last"))


def unfinished(files: DataFrame) -> DataFrame:
    """Partly read files in the order of indexing."""
    rank = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(KIND_ORDER)], F.lit(len(KIND_ORDER)))
    return files.where("state = 'partial'").orderBy(rank, F.desc("mtime"), "id")


def largest_subfolders(estimates: DataFrame, folder: str, most: int = 500) -> DataFrame:
    return estimates.where(F.col("folder") != folder).orderBy(F.desc("seconds"), "folder").limit(most)


def reasons_by_count(left_out: DataFrame) -> DataFrame:
    return left_out.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason")


# --- long files ----------------------------------------------------------------------------------------------------


def next_steps(files: DataFrame, segments: DataFrame) -> DataFrame:
    """id, start, end of the next step of each unfinished file: from where its info or its last place says that reading
    got to."""
    known = files.where("state = 'partial'").join(last_places(segments), F.col("id") == F.col("file"), "left")
    start = F.coalesce(F.col("info")["read_to"].cast("long"), F.col("last"), F.lit(0))
    end = F.coalesce(F.col("info")["read_end"].cast("long"), start)
    step = F.when(F.col("kind") == "pdf", PDF_STEP).otherwise(DOC_STEP)
    return known.select("id", start.alias("start"), F.least(start + step, end).alias("end"), (start + step >= end).alias("last_step"))


def stepped(files: DataFrame, done: DataFrame) -> DataFrame:
    """files after steps (id, end): read_to moves on, and a file at its end is done. A step that is given again changes
    nothing, so an interrupted run goes on where it stopped."""
    place = done.groupBy("id").agg(F.max("end").alias("reached"))
    f = files.join(place, "id", "left")
    now = F.greatest(F.coalesce(F.col("info")["read_to"].cast("long"), F.lit(0)), F.col("reached"))
    over = now >= F.coalesce(F.col("info")["read_end"].cast("long"), now)
    rest = F.map_filter("info", lambda k, _: ~k.isin("read_to", "read_end"))
    info = F.when(over, rest).otherwise(F.map_concat(F.map_filter("info", lambda k, _: k != "read_to"), F.create_map(F.lit("read_to"), now.cast("string"))))
    moved = F.col("reached").isNotNull() & (F.col("state") == "partial")
    return f.withColumns({"state": F.when(moved & over, "done").otherwise(F.col("state")), "info": F.when(moved, info).otherwise(F.col("info"))}).drop("reached")


def stop_reading(files: DataFrame, stopped: DataFrame) -> DataFrame:
    """Files whose reading ran away (path, why): a long one keeps what was read, others have failed."""
    f = files.join(stopped.groupBy("path").agg(F.first("why").alias("why")), "path", "left")
    hit, long = F.col("why").isNotNull(), F.col("state") == "partial"
    detail = F.when(long, F.concat(F.lit("The rest couldn't be read: it "), F.col("why"))).otherwise(F.concat(F.lit("It "), F.col("why")))
    return f.withColumns({"detail": F.when(hit, detail).otherwise(F.col("detail")), "state": F.when(hit, F.when(long, "done").otherwise("failed")).otherwise(F.col("state"))}).select(files.columns)


def over_limits(tasks: DataFrame, memory: int, seconds: float) -> DataFrame:
    """path, why of files whose reading took too much memory or time: what a watchdog stops and skips."""
    why = F.when(F.col("memory") > memory, "took too much memory").when(F.col("seconds") > seconds, "took too long")
    return tasks.select("path", why.alias("why")).where("why is not null")


def small_batches_first(batches: DataFrame, most: int = 50) -> DataFrame:
    """Batches (batch, n) with their turn: small ones before large ones, each in their order."""
    return batches.withColumn("turn", F.when(F.col("n") <= most, 0).otherwise(1)).orderBy("turn", "batch")


def backfill_allowed(now: float, last_sync_end: float, last_sync_seconds: float, sync_waiting: bool) -> bool:
    """Backfill yields to a sync that waits, and rests as long as the last one took."""
    return not sync_waiting and now - last_sync_end >= last_sync_seconds


def changed_roots(before: dict[str, str], now: dict[str, str]) -> dict[str, str]:
    """Roots whose state (present, missing, unreadable) is another than before: reported on change only."""
    return {root: state for root, state in now.items() if before.get(root, "present") != state}


# --- reading again, and versions -----------------------------------------------------------------------------------


def read_again(files: DataFrame, segments: DataFrame, meta: DataFrame, ocr: bool, drawn: bool, too_small: str = "too small") -> tuple[DataFrame, list[str]]:
    """Paths to read once more because they are read better now, and the flags to set, so that it happens once."""
    flags = {r["key"] for r in meta.where(F.col("key").isin("scans_ocr", "pictures_drawn")).select("key").collect()}
    found, new = files.where("false").select("path"), []
    if ocr and "scans_ocr" not in flags:
        scans = segments.where("kind = 'page_image'").select(F.col("file").alias("id")).distinct()
        found, new = found.union(files.join(scans, "id", "left_semi").select("path")), [*new, "scans_ocr"]
    if drawn and "pictures_drawn" not in flags:
        found, new = found.union(files.where((F.col("kind") == "image") & (F.col("state") == "skipped") & (F.col("detail") == too_small)).select("path")), [*new, "pictures_drawn"]
    return found.distinct(), new


def _keywords(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """1 to 2: keyword rows over normalised text, the text as written kept; PDFs with garbled pages are read again."""
    plain = normalized(F.col("body"))
    fts = t["fts"].withColumn("plain", plain).withColumns({"name": normalized(F.col("name")), "original": F.when(F.col("plain") != F.col("body"), F.col("body"))}).withColumn("body", F.col("plain")).drop("plain")
    pages = t["segments"].where("kind in ('page', 'page_image')").select(F.col("id").alias("rowid"), "file")
    bad = t["fts"].join(pages.select("rowid", F.col("file").alias("of")), "rowid").where(page_problem(F.col("body")).isNotNull()).select(F.col("of").alias("id")).distinct()
    pdfs = t["files"].where("kind = 'pdf'").join(bad, "id", "left_semi").select("id")
    files = t["files"].join(pdfs.withColumn("again", F.lit(True)), "id", "left").withColumn("state", F.when(F.col("again"), "pending").otherwise(F.col("state"))).drop("again").select(t["files"].columns)
    gone = t["segments"].where("kind <> 'name'").join(pdfs.select(F.col("id").alias("file")), "file", "left_semi").select("id")
    return t | {"files": files, "segments": t["segments"].join(gone, "id", "left_anti").select(t["segments"].columns), "fts": fts.join(gone.select(F.col("id").alias("rowid")), "rowid", "left_anti").select(t["fts"].columns)}


def _screenshots(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """2 to 3: text read off pictures has no vector."""
    ocr = F.col("kind") == "ocr"
    return t | {"segments": t["segments"].withColumns({"vec": F.when(~ocr, F.col("vec")), "modality": F.when(ocr, "none").otherwise(F.col("modality"))})}


def _names(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """3 to 4: vectors named by their version, not by the program that made them."""
    named = F.col("key").isin("fingerprint", "vector_source")
    return t | {"meta": t["meta"].withColumn("value", F.when(named, F.replace("value", F.lit(" llama.cpp-b11461-metal "), F.lit(" llama.cpp-vectors1 "))).otherwise(F.col("value")))}


def _long_files(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """4 to 5: long files know where reading stopped; text of mostly digits has no vector."""
    text = t["fts"].select(F.col("rowid").alias("id"), F.coalesce("original", "body").alias("text"))
    digits = t["segments"].where("kind in ('page', 'chunk') and vec is not null").join(text, "id").where(~has_words(F.coalesce("text", F.lit("")))).select("id", F.lit(True).alias("digits"))
    segments = t["segments"].join(digits, "id", "left").withColumns({"vec": F.when(F.col("digits").isNull(), F.col("vec")), "modality": F.when(F.col("digits"), "none").otherwise(F.col("modality"))}).select(t["segments"].columns)
    i, number = F.col("info"), lambda key: F.col("info")[key].cast("long")
    pdf = (F.col("kind") == "pdf") & (F.col("state") == "partial")
    doc = (F.col("kind") == "doc") & (F.col("state") == "done") & (i["chunks"] == "40")
    end = F.when(pdf, F.least(number("pages"), F.lit(MOST_PAGES))).otherwise(F.least(F.greatest(F.lit(41), F.floor((number("chars") + 1599) / 1600)), F.lit(MOST_CHUNKS)))
    start = F.when(pdf, "30").otherwise("40")
    info = F.map_concat(F.map_filter("info", lambda k, _: ~k.isin("read_to", "read_end")), F.create_map(F.lit("read_to"), start, F.lit("read_end"), end.cast("string")))
    files = t["files"].withColumns({"info": F.when(pdf | doc, info).otherwise(i), "detail": F.when(pdf, "read to page 30").when(doc, "read to chunk 40").otherwise(F.col("detail")), "state": F.when(doc, "partial").otherwise(F.col("state"))})
    return t | {"files": files, "segments": segments}


MIGRATIONS = {1: _keywords, 2: _screenshots, 3: _names, 4: _long_files}
VERSION = 5


def migrated(tables: dict[str, DataFrame], version: int) -> tuple[dict[str, DataFrame], int]:
    """Tables of an older version brought to the newest; a newer one is refused."""
    if version > VERSION:
        raise ValueError(f"the index has version {version}, this engine knows {VERSION}")
    while version < VERSION:
        tables, version = MIGRATIONS[version](tables), version + 1
    return tables, version


# --- events and costs ----------------------------------------------------------------------------------------------


def as_lines(events: DataFrame) -> DataFrame:
    """Events as JSON lines with sorted keys, for a sink."""
    return events.select(F.to_json(F.struct(*sorted(events.columns))).alias("value"))


def info_json(info: Column) -> Column:
    """A string map as JSON with sorted keys; null for none."""
    return F.when(F.size(info) > 0, F.to_json(F.map_from_entries(F.array_sort(F.map_entries(info)))))


def merged_costs(saved: DataFrame, new: DataFrame, enough: dict[str, float]) -> DataFrame:
    """name, units, seconds: what was measured anew added to what is saved, which is halved where it is plenty."""
    both = saved.select("name", F.col("units").alias("u"), F.col("seconds").alias("s")).join(new.select("name", F.col("units").alias("v"), F.col("seconds").alias("t")), "name", "full_outer")
    limit = F.coalesce(F.create_map(*[F.lit(x) for p in enough.items() for x in p])[F.col("name")], F.lit(20.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    fresh = (zero("v") > 0) & (zero("t") > 0)
    half = F.when(fresh & (zero("u") > 10 * limit), 0.5).otherwise(1.0)
    add = lambda old, more: zero(old) * half + F.when(fresh, zero(more)).otherwise(0.0)
    return both.select("name", add("u", "v").alias("units"), add("s", "t").alias("seconds"))


def progress(events: list[tuple[float, int]], every: float = 0.25) -> list[dict]:
    """A crawl's progress: cumulative counts at least `every` seconds apart, with the first and the last."""
    out: list[dict] = []
    for k, (at, checked) in enumerate(events):
        if not out or at - out[-1]["at"] >= every or k == len(events) - 1:
            out.append({"at": at, "checked": checked})
    return out


def emit(event: dict) -> str:
    return json.dumps(event, sort_keys=True, ensure_ascii=False)
