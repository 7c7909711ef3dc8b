"""Mixing sources to target weights as a time-varying curriculum.

A source's weight changes over training time t in [0, 1] as w(t) = target * (1 + tilt * (1 - 2t)), where `tilts` may give
a source's tilt, from -1 (from nothing to twice its share) to 1 (the reverse). Its integral, the source's cumulative
demand in words, is D(t) = target * (t + tilt * (t - t^2)); D(1) is the target. The documents of a
source stand in the order of a hash of their id, one pass after another (three at most); a copy whose middle word lies
at offset x below the target is taken and trained at the position t with D(t) = x, in closed form. The ranges of the
positions are drawn on narrow rows; the documents then go to their range once and are sorted within it.

A source's running offset is a sum in two levels: buckets of the hash range, `BUCKET_ROWS` rows or so each whatever
the source's share, then the buckets' totals. No task gets a whole source.

Targets: sources by code point, null last, weigh 1, 2, 3, repeating; they share all words by weight, stop at
`MAX_PASSES` times the source's size, and the excess is shared again by weight until none is above (the water level is
found from running sums over the sources ordered by the level at which they stop).

Defined cases: a null text has size 0; a null source is a source of its own; rows that repeat id, source and size
share one decision; with no words at all every target is 0; an empty table gives an empty result; other columns,
whatever their names, stay untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, free_names, read, small_side, written

MAX_PASSES = 3
BUCKET_ROWS = 20_000
#: Without tilts given: how much steeper than level a source's weight starts (even ranks) or ends (odd ranks).
TILT = 0.5


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, tilts: dict[str | None, float] | None = None) -> DataFrame:
    """For (source, size, rows): one row for each source with its size, target, tilt and number of buckets. It has as
    many rows as there are sources, and only they meet in one task."""
    by_source = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("n"))
    every = Window.partitionBy()
    named = by_source.withColumn("sid", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())))
    named = named.withColumn("weight", ((F.col("sid") - 1) % 3 + 1).cast("double")).withColumn("most", (F.col("source_size") * MAX_PASSES).cast("double"))
    level = every.orderBy(F.col("most") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    left = lambda of, sum_of: F.sum(of).over(every) - F.coalesce(F.sum(sum_of).over(level), F.lit(0.0))
    named = named.withColumn("words_left", left(F.col("source_size").cast("double"), "most")).withColumn("weight_left", left("weight", "weight"))
    named = named.withColumn("stops", F.col("most") * F.col("weight_left") <= F.col("words_left") * F.col("weight"))
    kept = lambda of: F.sum(F.when(F.col("stops"), F.col(of)).otherwise(0.0)).over(every)
    named = named.withColumn("rest", F.sum(F.col("source_size").cast("double")).over(every) - kept("most")).withColumn("rest_weight", F.sum("weight").over(every) - kept("weight"))
    share = F.when(F.col("stops"), F.col("most")).otherwise(F.col("weight") * F.col("rest") / F.col("rest_weight"))
    tilt = F.when(F.col("sid") % 2 == 0, F.lit(TILT)).otherwise(F.lit(-TILT))
    for source, own in (tilts or {}).items():
        tilt = F.when(F.col("source").eqNullSafe(F.lit(source)), F.lit(float(min(max(own, -1.0), 1.0)))).otherwise(tilt)
    return named.select(
        "source",
        "sid",
        "source_size",
        share.alias("target"),
        tilt.alias("tilt"),
        F.ceil(F.col("n") / BUCKET_ROWS).alias("buckets"),
    )


def position(offset: Column, target: Column, tilt: Column) -> Column:
    """The time at which the source's cumulative demand reaches `offset`."""
    u, b = offset / target, 1 + tilt
    return 2 * u / (b + F.sqrt(F.greatest(b * b - 4 * tilt * u, F.lit(0.0))))


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tilts: dict[str | None, float] | None = None) -> DataFrame:
    """For each (id, source, size): rows, source_size, target, offset, copies, and what `position` needs."""
    sizes = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    sizes = written(sizes.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("rows")), "mix-sizes")
    sources = targets(sizes, tilts)
    digest = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))
    part = F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * F.col("buckets") / 2**32)
    rows = sizes.join(sources, sizes["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    rows = rows.withColumn("digest", digest).withColumn("bucket", part)
    inside = Window.partitionBy("sid", "bucket").orderBy("digest", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum(F.col("size") * F.col("rows")).over(inside), F.lit(0)))
    totals = rows.groupBy("sid", "bucket").agg(F.sum(F.col("size") * F.col("rows")).alias("words"))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("sid", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
    rows = rows.join(totals, ["sid", "bucket"]).withColumn("offset", F.col("before") + F.col("inside"))
    copies = sum(
        (F.col("offset") + k * F.col("source_size") + F.col("size") * F.col("rows") / 2 < F.col("target")).cast("int")
        for k in range(MAX_PASSES)
    )
    return rows.select("id", "source", "size", "rows", "source_size", "target", "tilt", "offset", copies.alias("copies"))


def _position_of(copy: Column) -> Column:
    return position(F.col("offset") + copy * F.col("source_size") + F.col("size") * F.col("rows") / 2, F.col("target"), F.col("tilt"))


def training_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tilts: dict[str | None, float] | None = None) -> DataFrame:
    """The mix itself: the documents' columns, a row for each copy, sorted by range of training position."""
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = free_names(docs, "id", "source", "size", "position", "range")
    plan = decisions(docs, id_col, text_col, source_col, tilts).where("copies > 0")
    plan = plan.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    plan = plan.select("id", "source", "size", _position_of(F.col("copy")).alias("position")).repartitionByRange(ranges, "position", "id")
    plan = written(plan.withColumn("range", F.spark_partition_id()).toDF(*names), "mix-plan")
    one, source, size, position, place = names
    same = docs[id_col].eqNullSafe(plan[one]) & docs[source_col].eqNullSafe(plan[source]) & (word_count(docs[text_col]) == plan[size])
    joined = docs.join(small_side(plan), same)
    return joined.repartitionById(ranges, F.col(place)).sortWithinPartitions(position, one).select(*[docs[c] for c in docs.columns])


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """The decision on each document, in training order; documents that the mix leaves out come last."""
    found = decisions(read(spark, sf_dir)).withColumn("first_position", F.when(F.col("copies") > 0, _position_of(F.lit(0))))
    found = found.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken, "first_position").orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM d GROUP BY source
), w AS (
  SELECT *, CAST((sid - 1) % 3 + 1 AS DOUBLE) AS weight, CAST(source_size * 3 AS DOUBLE) AS most FROM s
), l AS (
  SELECT *, sum(CAST(source_size AS DOUBLE)) OVER () AS words, sum(weight) OVER () AS weights,
         coalesce(sum(most) OVER o, 0) AS most_before, coalesce(sum(weight) OVER o, 0) AS weight_before
  FROM w WINDOW o AS (ORDER BY most / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, most * (weights - weight_before) <= (words - most_before) * weight AS stops FROM l
), r AS (
  SELECT *, words - sum(CASE WHEN stops THEN most ELSE 0.0 END) OVER () AS rest,
         weights - sum(CASE WHEN stops THEN weight ELSE 0.0 END) OVER () AS rest_weight FROM f
), t AS (
  SELECT source, sid, source_size, CASE WHEN stops THEN most ELSE weight * rest / rest_weight END AS target,
         CASE WHEN sid % 2 = 0 THEN 0.5e0 ELSE -0.5e0 END AS tilt FROM r
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.tilt,
         coalesce(sum(d.size) OVER (PARTITION BY t.sid ORDER BY md5(CAST(d.doc_id AS VARCHAR)), d.doc_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, CAST(start + size / 2.0e0 < target AS INT) + CAST(start + source_size + size / 2.0e0 < target AS INT)
            + CAST(start + 2 * source_size + size / 2.0e0 < target AS INT) AS copies,
         (start + size / 2.0e0) / target AS u FROM p
)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken,
       CASE WHEN copies > 0 THEN 2 * u / (1 + tilt + sqrt(greatest((1 + tilt) * (1 + tilt) - 4 * tilt * u, 0))) END AS first_position
FROM c
"""
