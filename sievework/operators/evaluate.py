"""Evaluation: expected answers against ranked hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_ranks(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """query, tag, rank of the first expected hit (null if none). hits: query, path, loc, loc_end, rank; expected: query,
    tag, path, first, last (null: anywhere). A hit with an end overlaps the range, one without lies in it."""
    e = expected.select("query", "tag", F.col("path").alias("e_path"), "first", "last")
    fits = F.col("first").isNull() | ((F.col("loc") <= F.col("last")) & (F.coalesce("loc_end", "loc") >= F.col("first")))
    found = e.join(hits, "query", "left").withColumn("hit", F.when((F.col("path") == F.col("e_path")) & fits, F.col("rank")))
    return found.groupBy("query", "tag").agg(F.min("hit").alias("rank"))


def metrics(ranks: DataFrame) -> DataFrame:
    """tag (and ALL), n, r1, r5, r10, mrr: one roll-up."""
    within = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0))
    return ranks.rollup("tag").agg(
        F.count(F.lit(1)).alias("n"),
        within(1).alias("r1"),
        within(5).alias("r5"),
        within(10).alias("r10"),
        F.avg(F.when(F.col("rank") <= 10, 1.0 / F.col("rank")).otherwise(0.0)).alias("mrr"),
    ).select(F.coalesce("tag", F.lit("ALL")).alias("tag"), "n", "r1", "r5", "r10", "mrr")


def fold_metrics(hits: DataFrame) -> DataFrame:
    """Mean hits shown and listed for a query. hits: query, strong."""
    per = hits.groupBy("query").agg(F.count(F.lit(1)).alias("listed"), F.sum(F.col("strong").cast("int")).alias("shown"))
    return per.agg(F.avg("listed").alias("listed"), F.avg("shown").alias("shown"))
