"""Chat formatting with collapse of cumulative snapshots, in DataFrame operations only.

A chat log often holds a conversation again and again, each time a few turns longer. Each turn gets the hash of its
conversation up to it: a running XOR of two 64-bit hashes of (place, role, text), which a window keeps turn by turn
without holding a conversation. A conversation that ends where another one's prefix with the same hash and length goes on is
a snapshot of it; an anti-join against the distinct prefixes drops it. Of conversations with the same turns the one
with the smallest id stays. Those that remain are rendered by the template.

Defined cases: turns stand in the order of their number, equal numbers by role and text; rows that repeat a turn word
for word count once; null numbers come first; a null role or text is its own value in a hash, and is rendered as empty;
a row with a null conversation id belongs to the conversation of null id; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import read

BEGIN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def _turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Each turn once, with its place and the two running hashes of its conversation up to it."""
    named = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).distinct()
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    placed = named.withColumn("place", F.row_number().over(order))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shown = [F.col("place"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    hashed = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), *shown)).over(so_far)
    return placed.withColumn("hash1", hashed(1)).withColumn("hash2", hashed(2)).withColumn("later", F.lead("place").over(order))


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(BEGIN), F.coalesce(role, F.lit("")), F.lit(MIDDLE), F.coalesce(text, F.lit("")), F.lit(CLOSE))


def maximal(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, n_turns of the conversations that stay."""
    turns = _turns(rows, conv, turn, role, text)
    key = ["place", "hash1", "hash2"]
    whole = turns.where("later is null").groupBy(*key).agg(F.min("conv").alias("conv"))
    prefixes = turns.where("later is not null").select(*key).distinct()
    return whole.join(prefixes, key, "left_anti").select("conv", F.col("place").alias("n_turns"))


def formatted(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, n_turns, rendered: a row for each conversation that stays."""
    keep = maximal(rows, conv, turn, role, text)
    named = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    kept = named.join(keep, named["conv"].eqNullSafe(keep["conv"])).select(named["*"], "n_turns").distinct()
    parts = F.sort_array(F.collect_list(F.struct("turn", "role", "text", _rendered(F.col("role"), F.col("text")).alias("shown"))))
    whole = kept.groupBy("conv", "n_turns").agg(parts.alias("parts"))
    return whole.select(F.col("conv").alias(conv), "n_turns", F.array_join(F.col("parts.shown"), "").alias("rendered"))


def op8_chat(spark, sf_dir: str) -> DataFrame:
    return formatted(read(spark, sf_dir, "conversations"))


SQL = r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, role, text FROM conversations
), p AS (
  SELECT *, row_number() OVER w AS place, lead(1) OVER w AS later,
         sha256(string_agg(sha256(coalesce('r' || role, 'n') || chr(1) || coalesce('t' || text, 'n')), '') OVER (
           PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)) AS prefix
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)
), k AS (
  SELECT min(conv_id) AS conv_id, place FROM p WHERE later IS NULL
    AND (place, prefix) NOT IN (SELECT (place, prefix) FROM p WHERE later IS NOT NULL) GROUP BY place, prefix
)
SELECT k.conv_id, CAST(k.place AS INT) AS n_turns,
       string_agg('<|im_start|>' || coalesce(p.role, '') || chr(10) || coalesce(p.text, '') || '<|im_end|>' || chr(10), '' ORDER BY p.place) AS rendered
FROM k JOIN p ON k.conv_id = p.conv_id GROUP BY k.conv_id, k.place
"""
