"""Exact deduplication by skew-safe combining, in DataFrame operations only.

1. Local: each map task's partial aggregate holds one row for each distinct text that the task has read.
2. Salted: the survivors of (digest, content, salt) meet, where the salt is the map task's number modulo `salts`; a text
   that fills a third of the table is spread over `salts` reducers, and each gets one row for each of its map tasks.
3. Global: the salt winners of (digest, content) meet, `salts` rows for a text at most.

The grouping key always holds the whole normalised content beside its SHA-256, so content, not the digest alone,
decides equality in each stage. Members then look up their winner by digest and byte length in a sort-merge join of
narrow rows, which adaptive execution splits where one digest is hot.

Defined cases: a null text counts as empty, and all empty texts are one group; of equal code-point counts the
smallest id stays, a null id losing to any other; rows that repeat an id and a text are each reported, all with the
same `kept`, and `keep_documents` leaves one of them; an empty table gives an empty result; other columns of the
input, whatever their names, are not read.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE_CLASS, free_names, read, written

#: Reducers that share one hot text.
SALTS = 32
#: More than 2**63 - the smallest long, so that a rank is (code points) * SPAN + (2**63 - id).
SPAN = Decimal(20_000_000_000_000_000_000)
TOP = Decimal(2**63)


def normalised(text: Column) -> Column:
    """Text without white space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS, "")


def _digested(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("raw"))
    rows = rows.select("id", F.length(F.coalesce("raw", F.lit(""))).alias("points"), normalised(F.col("raw")).alias("content"))
    return rows.withColumn("digest", F.unhex(F.sha2("content", 256)))


def winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row for each distinct content: digest, bytes, keep_id, keep_points (the kept text's code points), group_size."""
    order = F.col("points").cast("decimal(10,0)") * F.lit(SPAN) + F.coalesce(F.lit(TOP) - F.col("id").cast("decimal(20,0)"), F.lit(Decimal(0)))
    rows = _digested(docs, id_col, text_col).select("digest", "content", F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"), order.cast("decimal(38,0)").alias("best"))
    salted = rows.groupBy("digest", "content", "salt").agg(F.max("best").alias("best"), F.count(F.lit(1)).alias("n"))
    whole = salted.groupBy("digest", "content").agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    rest = F.col("best") % F.lit(SPAN)
    keep = F.when(rest > 0, (F.lit(TOP) - rest).cast("long"))
    points = F.floor(F.col("best") / F.lit(SPAN)).cast("long")
    return whole.select("digest", F.octet_length("content").alias("bytes"), keep.alias("keep_id"), points.alias("keep_points"), F.col("n").cast("long").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """Every row's group: id, keep_id, group_size, kept, text_sha256."""
    best = winners(docs, id_col, text_col, salts)
    members = _digested(docs, id_col, text_col).select("id", "digest", F.octet_length("content").alias("bytes"))
    return members.join(best, ["digest", "bytes"]).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The documents that stay, with all their columns. An id alone doesn't name a row: null and repeated ids may come
    with several texts, so a row stays by its winner's id, length and content."""
    names = free_names(docs, "keep_id", "keep_points", "bytes", "digest")
    best = winners(docs, id_col, text_col, salts)
    keep = written(best.select(*[F.col(c).alias(n) for c, n in zip(("keep_id", "keep_points", "bytes", "digest"), names, strict=True)]), "dedup-keep")
    identifier, raw, content = docs[id_col].cast("long"), F.coalesce(docs[text_col], F.lit("")), normalised(docs[text_col])
    own = docs.withColumns(dict(zip(names, (identifier, F.length(raw).cast("long"), F.octet_length(content), F.unhex(F.sha2(content, 256))), strict=True)))
    same = [own[names[0]].eqNullSafe(keep[names[0]]), *(own[c] == keep[c] for c in names[1:])]
    kept = own.join(keep, same, "left_semi")
    # Rows that repeat an id and a text all match their winner.
    again = docs.groupBy(identifier.alias(names[0])).count().where("count > 1").limit(1).count()
    return (kept.dropDuplicates(names) if again else kept).drop(*names)


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content
  FROM documents
), r AS (
  SELECT *, row_number() OVER (PARTITION BY content ORDER BY points DESC, doc_id) AS place,
         count(*) OVER (PARTITION BY content) AS group_size FROM d
), k AS (SELECT content, doc_id AS keep_id FROM r WHERE place = 1)
SELECT r.doc_id, k.keep_id, r.group_size, r.doc_id = k.keep_id AS kept, sha256(r.content) AS text_sha256
FROM r JOIN k ON r.content = k.content
"""
