"""Keyword candidates: BM25's constants, vocabulary, and the limits on rows and files. The index is `keyword_index`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: BM25 constants, column weights, numbers of rows and files.
K1, B, LEAST_IDF, NAME_WEIGHT, BODY_WEIGHT, ROWS, FILES = 1.2, 0.75, 1e-6, 3.0, 1.0, 1000, 100


def vocabulary(postings: DataFrame) -> DataFrame:
    """Each token with its uses and rows, from one aggregate over postings."""
    found = postings.where("token <> ''").groupBy(F.col("token").alias("term"))
    return found.agg(F.sum(F.col("names") + F.col("bodies")).cast("long").alias("uses"), F.count(F.lit(1)).alias("docs"))


def keyword_files(ranked: DataFrame, rows: int = ROWS, files: int = FILES) -> DataFrame:
    """The first files among the best rows: the limit on rows comes before anything else."""
    best = ranked.orderBy("bm25", "rowid").limit(rows)
    first = best.groupBy("file").agg(F.min(F.struct("bm25", "rowid")).alias("b"))
    return first.select("file", "b.bm25", "b.rowid").orderBy("bm25", "rowid").limit(files)
