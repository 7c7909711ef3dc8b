"""One facade over an index: estimate, index, search, status, evaluate."""

from __future__ import annotations

import re

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sievework.functions.embedding import CODE_QUERY, QUERY, Embedder, HashEmbedder, document_prompt, embedded
from sievework.functions.passages import snippet_of
from sievework.functions.text import excerpt, has_prose, query_terms
from sievework.operators import estimate, evaluate, folders, rules, segment, sync, upkeep
from sievework.operators.keyword_index import KeywordIndex
from sievework.operators.search import pointed, search, search_many, with_excerpts
from sievework.operators.store import Index
from sievework.sources import files as sources

#: Files that one commit reads; bytes of the largest file that is opened.
BATCH, LARGEST = 10_000, 1 << 30


class Engine:
    def __init__(self, spark: SparkSession, folder: str, make: type[Embedder] = HashEmbedder):
        self.spark, self.index_tables, self.make, self.warning = spark, Index(spark, folder), make, None
        #: Files and bytes that the last crawl has seen.
        self.crawled: dict[str, int] = {}
        self.vectors = upkeep.QueryVectors(lambda text, code: [float(x) for x in make().embed([(CODE_QUERY if code else QUERY).format(text)])[0]])

    def reset_on_change(self) -> None:
        """Another model: everything is read again."""
        self.index_tables.reset()

    def estimate(self, root: str) -> DataFrame:
        found = sources.crawl(self.spark, root).where("action = 'index'").withColumns({"pages": F.lit(0), "duration": F.lit(0.0)})
        return estimate.estimated(found.withColumn("folder", estimate.subfolder(F.col("path"), root)), "folder")

    def index(self, root: str) -> DataFrame:
        """Brings the index in step with a folder of text documents; returns the changes' counts."""
        upkeep.adopt(self._meta("fingerprint"), upkeep.fingerprint(self.make().name), self.reset_on_change)
        seen = Observation("crawl")
        # The folder is walked once, for all that follows.
        crawled = sources.crawl(self.spark, root, progress=seen).where("action = 'index'").select("path", "kind", "size", "mtime", "inode", "device").cache()
        changes = sync.reconcile(self.index_tables.table("files"), crawled, [root]).cache()
        counts = changes.groupBy("change").agg(F.count(F.lit(1)).alias("n")).toPandas()
        self.crawled = seen.get
        self.index_tables.apply(changes, crawled)
        changes.unpersist()
        crawled.unpersist()
        while self._read_some():
            pass
        self.index_tables.compact()
        name = self.make().name
        if self._meta("vector_source") != name:
            self.index_tables.set_meta(fingerprint=upkeep.fingerprint(name), vector_source=name)
        return self.spark.createDataFrame(counts)

    def _opened(self, paths: list[str]) -> DataFrame:
        """path, content of some files; those that have gone meanwhile are left out."""
        load = lambda some: self.spark.read.format("binaryFile").load([re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in some])
        try:
            return load(paths)
        except AnalysisException:
            there = [p for p in paths if self.index_tables._fs.exists(self.index_tables._path(p))]
            return load(there) if there else self.spark.createDataFrame([], "path string, content binary")

    def _read_some(self, most: int = BATCH) -> int:
        """Reads the next pending documents, opening no other file, and commits their segments and states together.
        Returns how many there were."""
        waiting = sync.queue(self.index_tables.table("files").where("kind = 'doc'"), most).select("id", "path", "size").cache()
        # At most `most` paths.
        paths = [r["path"] for r in waiting.where(F.col("size") <= LARGEST).select("path").collect()]
        count = waiting.count()
        if not count:
            return 0
        content = self.spark.createDataFrame([], "path string, content binary")
        if paths:
            opened = self._opened(paths)
            content = opened.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")
        # Each file is parsed once, for its segments and for its state; one that is gone or too large has failed.
        read = sources.texts(content)
        texts = waiting.select("id", "path").join(read, "path", "left").persist(StorageLevel.DISK_ONLY)
        pieces = segment.chunks(texts.where("text is not null"), "id", "text")
        title = F.lit(None).cast("string")
        vectors = embedded(pieces.withColumn("prompt", document_prompt(title, F.col("chunk"))), "prompt", self.make)
        rows = vectors.select(F.col("id").alias("file"), F.lit("chunk").alias("kind"), F.lit("text").alias("modality"), F.col("loc").cast("double").alias("loc"), F.lit(None).cast("double").alias("loc_end"), excerpt(F.col("chunk")).alias("excerpt"), F.col("chunk").alias("body"), F.when(has_prose(F.col("chunk")), F.col("vec")).alias("vec"))
        state = F.when(F.col("text").isNotNull(), "done").when(F.col("error") == "empty", "skipped").otherwise("failed")
        self.index_tables.record(rows, texts.select("id", state.alias("state"), F.coalesce("error", F.when(F.col("text").isNull(), F.lit("not read"))).alias("detail"), F.create_map().cast("map<string,string>").alias("info")))
        texts.unpersist()
        waiting.unpersist()
        return count

    def _meta(self, key: str) -> str | None:
        row = self.index_tables.table("meta").where(F.col("key") == key).first()
        return row["value"] if row else None

    def _keywords(self) -> KeywordIndex:
        return self.index_tables.keywords()

    def search(self, query: str, kinds: list[str] | None = None, limit: int = 20, typing: bool = False, choices: DataFrame | None = None, types: list[str] = (), excerpts: bool = False) -> DataFrame:
        """The best files of a query. typing: its last word may go on. choices (folder, choice) and types (extensions left out)
        are applied after the limit. excerpts: adds points_at and excerpt, for which only the hits' own texts are read."""
        files, segments = self.index_tables.table("files").select(F.col("id").alias("file"), "path"), self._segments()
        usable, self.warning = upkeep.usable_vector(self._meta("vector_source"), self.make().name)
        q = self.spark.createDataFrame([(self.vectors.of(query),)], "q array<float>") if usable else None
        hits = search(segments, q, self._keywords(), query, kinds, limit, typing=typing).join(files, "file")
        if types:
            hits = hits.where(~rules.extension_of(F.col("path")).isin(list(types)))
        if choices is not None:
            hits = folders.standing(hits, choices).where("searched").drop("searched", "searched_as")
        if excerpts:
            hits = pointed(hits)
            texts = self.index_tables.table("fts").join(hits.select(F.col("keyword_segment").alias("rowid")), "rowid", "left_semi")
            written = F.concat_ws(" ", F.nullif("name", F.lit("")), F.coalesce("original", "body"))
            snippets = texts.select(F.col("rowid").alias("id"), snippet_of(written, query_terms(query)).alias("snippet"))
            hits = with_excerpts(hits, self.index_tables.table("segments").select("id", "kind", "loc", "excerpt"), snippets)
        return hits.orderBy(F.desc("score"), "file")

    def status(self) -> DataFrame:
        return sync.counts(self.index_tables.table("files"))

    def evaluate(self, expected: DataFrame, limit: int = 10) -> DataFrame:
        """Metrics of expected answers (query, tag, path, first, last). All queries are searched in one plan."""
        queries = [r["query"] for r in expected.select("query").distinct().orderBy("query").collect()]
        usable, self.warning = upkeep.usable_vector(self._meta("vector_source"), self.make().name)
        files = self.index_tables.table("files").select(F.col("id").alias("file"), "path")
        hits = search_many(self._segments(), {q: self.vectors.of(q) if usable else None for q in queries}, self._keywords(), limit).join(files, "file")
        none = F.lit(None).cast("int")
        return evaluate.metrics(evaluate.first_ranks(hits.select("query", "path", none.alias("loc"), none.alias("loc_end"), "rank"), expected))

    def _segments(self) -> DataFrame:
        """Segments with vectors, with their files' kinds; later pages of long files don't set the scale."""
        kinds = self.index_tables.table("files").select(F.col("id").alias("file"), F.col("kind").alias("file_kind"))
        segments = self.index_tables.table("segments").where("vec is not null").drop("kind").join(kinds, "file")
        return segments.select("id", "file", F.col("file_kind").alias("kind"), "modality", (F.coalesce("loc", F.lit(0.0)) <= segment.DOC_STEP).alias("sets_scale"), "vec")
