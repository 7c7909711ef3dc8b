"""Code search: names as phrases, the stretch that defines a name, the line to open at."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.code import definition, first_line
from sievework.functions.text import query_terms

from .keyword_index import KeywordIndex

#: Stretches of a file that are looked through, and results for which a definition is looked for.
STRETCHES, LOOKED_UP = 300, 10
DEFINED, LINED = "line int, strength int", "line int"


def definitions(stretches: DataFrame, name: str) -> DataFrame:
    """file, id, line, strength: the best place of each file's stretches (file, id, loc, text) that defines a name: a
    definition before a declaration, then the first."""
    place = Window.partitionBy("file").orderBy("loc", "id")
    some = stretches.withColumn("place", F.row_number().over(place)).where(F.col("place") <= STRETCHES)

    @F.pandas_udf(DEFINED)
    def found(text: pd.Series, first: pd.Series) -> pd.DataFrame:
        hits = [(definition(name, t, int(f)) if t is not None else None) or (None, None) for t, f in zip(text, first, strict=True)]
        return pd.DataFrame({"line": pd.array([h[0] for h in hits], "Int32"), "strength": pd.array([h[1] for h in hits], "Int32")})

    marked = some.withColumn("d", found(F.col("text"), F.coalesce("loc", F.lit(1.0)))).where("d.strength > 0")
    best = F.max_by(F.struct("id", "d.line", "d.strength"), F.struct(F.col("d.strength"), -F.col("place"))).alias("b")
    return marked.groupBy("file").agg(best).select("file", "b.id", "b.line", "b.strength")


def focus_lines(stretches: DataFrame, words: list[str]) -> DataFrame:
    """id, line: where each stretch (id, loc, text) has one of the words, best in a line that defines something."""

    @F.pandas_udf(LINED)
    def found(text: pd.Series, first: pd.Series) -> pd.DataFrame:
        lines = [first_line(words, t, int(f)) if t is not None else None for t, f in zip(text, first, strict=True)]
        return pd.DataFrame({"line": pd.array(lines, dtype="Int32")})

    return stretches.select("id", found(F.col("text"), F.coalesce("loc", F.lit(1.0))).alias("f")).select("id", "f.line")


def code_places(hits: DataFrame, stretches: DataFrame, index: KeywordIndex, query: str, identifier: list[str] | None) -> DataFrame:
    """hits (file, points_at, keyword_segment, place) with the stretch to point at and `focus`, the line to open at.

    A name is looked for where it is defined, in the first results; else the line is the first with the query's words,
    where they were found in that stretch. stretches: file, id, loc, text."""
    name = query.strip().replace("()", "")
    looked = hits.where(F.col("place") <= LOOKED_UP) if identifier else hits.where("false")
    rows = index.phrase(identifier, looked.select("file")) if identifier else None
    chosen = stretches.join(F.broadcast(looked.select("file")), "file", "left_semi")
    chosen = chosen.join(F.broadcast(rows.select(F.col("rowid").alias("id"))), "id", "left_semi") if identifier else chosen
    defined = definitions(chosen, name).select("file", F.col("id").alias("defines"), F.col("line").alias("defined_at"))
    placed = hits.join(F.broadcast(defined), "file", "left").withColumn("points_at", F.coalesce("defines", "points_at"))
    worded = placed.where(F.col("defines").isNull() & (F.lit(bool(identifier)) | (F.col("keyword_segment") == F.col("points_at"))))
    own = stretches.join(F.broadcast(worded.select(F.col("points_at").alias("id"))), "id", "left_semi")
    lines = focus_lines(own, [name.lower()] if identifier else query_terms(query)).select(F.col("id").alias("points_at"), "line")
    usable = F.lit(bool(identifier)) | (F.col("keyword_segment") == F.col("points_at"))
    out = placed.join(F.broadcast(lines), "points_at", "left")
    return out.withColumn("focus", F.coalesce("defined_at", F.when(usable, F.col("line")))).drop("defines", "defined_at", "line")
