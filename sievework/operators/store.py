"""The index as tables that change together: files, segments, keyword rows, meta, and the keyword index's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.text import normalized
from sievework.plans.delta import KEPT, Change, DeltaStore

from . import keyword_index, rules, sync
from .keyword_index import KeywordIndex

__all__ = ["KEPT", "SCHEMAS", "VERSION", "Index"]

VERSION = 5
SCHEMAS = {
    "files": "id long, path string, kind string, size long, mtime double, inode long, device long, state string, detail string, info map<string,string>, indexed_at timestamp",
    "segments": "id long, file long, kind string, modality string, loc double, loc_end double, excerpt string, vec array<float>",
    "fts": "rowid long, file long, name string, body string, original string",
    "meta": "key string, value string",
}
KEYS = {"files": "id", "segments": "id", "fts": "rowid"}
WORDS = {name: f"keyword_{name}" for name in keyword_index.SCHEMAS}


class Index(DeltaStore):
    """Each method is one commit over all the tables that it changes. What it writes follows what it changes: rows of
    its own, and the keys of those that go."""

    def __init__(self, spark: SparkSession, folder: str):
        words = {WORDS[n]: s for n, s in keyword_index.SCHEMAS.items()}
        super().__init__(spark, folder, SCHEMAS | words, KEYS | {WORDS[n]: k for n, k in keyword_index.KEYS.items()})

    def keywords(self, state: dict | None = None) -> KeywordIndex:
        return KeywordIndex(self.spark, store=self, names=WORDS, state=state)

    def compact(self, name=None, merge=None) -> bool:
        """One table, or all of them."""
        if name is not None:
            return super().compact(name, merge)
        done = [super(Index, self).compact(n) for n in KEYS]
        self.keywords().compact()
        return any(done)

    def _new(self, change: Change, crawled: DataFrame) -> None:
        # A moved file keeps its id, so that a new file at its old path needs another one.
        new = crawled.withColumn("id", F.xxhash64("path", F.lit(change.number))).withColumns({"state": F.lit("pending"), "detail": F.lit(None).cast("string"), "info": F.create_map().cast("map<string,string>"), "indexed_at": F.lit(None).cast("timestamp")})
        name, none = rules.name_of(F.col("path")), F.lit(None)
        change.append("files", new)
        change.append("segments", new.select("id", F.col("id").alias("file"), F.lit("name").alias("kind"), F.lit("none").alias("modality"), none.alias("loc"), none.alias("loc_end"), none.alias("excerpt"), none.alias("vec")))
        rows = new.select(F.col("id").alias("rowid"), F.col("id").alias("file"), normalized(name).alias("name"), F.lit("").alias("body"), none.alias("original"))
        change.append("fts", rows)
        self.keywords(change.state).add(change, rows)

    def _without(self, change: Change, segments: DataFrame) -> None:
        """Segments (id) go, with their keyword rows."""
        change.delete("segments", segments.select("id"))
        rows = segments.select(F.col("id").alias("rowid"))
        change.delete("fts", rows)
        self.keywords(change.state).remove(change, rows)

    def insert(self, crawled: DataFrame) -> None:
        """New files, each with its name as a segment and as a keyword row."""
        change = self.begin()
        self._new(change, crawled.join(change.table("files").select("path"), "path", "left_anti"))
        change.commit()

    def _segments(self, change: Change, segments: DataFrame) -> None:
        s = segments.withColumn("id", F.xxhash64("file", "kind", "loc")).withColumn("plain", normalized(F.col("body"))).dropDuplicates(["id"])
        s = s.withColumn("modality", F.when(F.col("vec").isNull(), "none").otherwise(F.col("modality")))
        again = change.table("segments").join(s.select("id"), "id", "left_semi").select("id")
        if not again.isEmpty():
            self._without(change, again)
        change.append("segments", s)
        rows = s.select(F.col("id").alias("rowid"), "file", F.lit("").alias("name"), F.col("plain").alias("body"), F.when(F.col("plain") != F.col("body"), F.col("body")).alias("original"))
        change.append("fts", rows)
        self.keywords(change.state).add(change, rows)

    def _states(self, change: Change, done: DataFrame) -> None:
        new = done.select("id", *[F.col(c).alias(f"n_{c}") for c in ("state", "detail", "info")])
        files = change.table("files").join(new, "id")
        change.upsert("files", files.withColumns({c: F.col(f"n_{c}") for c in ("state", "detail", "info")} | {"indexed_at": F.current_timestamp()}))

    def add_segments(self, segments: DataFrame) -> None:
        """Segments (file, kind, modality, loc, loc_end, excerpt, body, vec): no vector, no modality; the text as written
        is kept where normalising changes it. A segment that is there already (same file, kind and place) is replaced;
        of several in one call one stays."""
        change = self.begin()
        self._segments(change, segments)
        change.commit()

    def finish(self, done: DataFrame) -> None:
        """States of files (id, state, detail, info) after reading."""
        change = self.begin()
        self._states(change, done)
        change.commit()

    def record(self, segments: DataFrame, done: DataFrame) -> None:
        """Segments and the states of their files in one commit: a crash leaves both or neither."""
        change = self.begin()
        self._segments(change, segments)
        self._states(change, done)
        change.commit()

    def apply(self, changes: DataFrame, crawled: DataFrame) -> None:
        """A reconcile's changes: moves keep their vectors, changed files are pending again, removed ones go with their
        segments and keyword rows."""
        change = self.begin()
        files, segments = change.table("files"), change.table("segments")
        marked = changes.where("change in ('moved', 'changed', 'removed')").select(F.coalesce("old_path", "path").alias("stored"), F.col("path").alias("now"), "change")
        touched = files.join(marked, files["path"] == F.col("stored"))
        again = touched.where("change in ('moved', 'changed')").withColumns({"path": F.col("now"), "state": F.when(F.col("change") == "changed", "pending").otherwise(F.col("state"))})
        # A changed file is compared with what it is now, the next time.
        facts = crawled.select(F.col("path").alias("now"), *[F.col(c).alias(f"n_{c}") for c in ("size", "mtime", "inode", "device")])
        again = again.join(facts, "now").withColumns({c: F.col(f"n_{c}") for c in ("size", "mtime", "inode", "device")})
        left = touched.where("change in ('changed', 'removed')").select(F.col("id").alias("file"), "change")
        going = segments.join(left, "file").where("change = 'removed' or kind <> 'name'").select("id")
        change.upsert("files", again)
        change.delete("files", touched.where("change = 'removed'").select("id"))
        self._without(change, going)
        self._new(change, crawled.join(changes.where("change = 'added'").select("path"), "path", "left_semi"))
        change.commit()

    def prune(self, roots: list[str]) -> None:
        """Files outside all roots go, with their segments and keyword rows."""
        change = self.begin()
        files = change.table("files")
        outside = files.join(sync.pruned(files, roots).select("id"), "id", "left_anti").select("id")
        going = change.table("segments").join(outside.select(F.col("id").alias("file")), "file", "left_semi").select("id")
        change.delete("files", outside)
        self._without(change, going)
        change.commit()

    def set_meta(self, **values: str) -> None:
        """The meta table has a few rows, and is written anew."""
        change = self.begin()
        change.overwrite("meta", sync.upserted(change.table("meta"), self.spark.createDataFrame(list(values.items()), SCHEMAS["meta"])).coalesce(1))
        change.commit()

    def reset(self) -> None:
        """Everything pending again; only names stay, and the fingerprint is forgotten."""
        change = self.begin()
        change.overwrite("files", change.table("files").withColumn("state", F.lit("pending")))
        self._without(change, change.table("segments").where("kind <> 'name'").select("id"))
        change.overwrite("meta", change.table("meta").where("key <> 'fingerprint'").coalesce(1))
        change.commit()
