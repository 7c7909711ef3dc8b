"""Filter interaction audit: what each filter removes in every order of the filters, and its Shapley value.

1. One pass over the texts gives each document a mask, a bit for each filter that it fails. The filter for repeated
   texts compares digests of whole texts: the least id of each digest that occurs again is joined back to narrow rows,
   by a join that adaptive execution splits where one text is hot.
2. Documents are counted by part and mask: 2**filters cells a part, whatever the number of documents.
3. Each part's orders are visited by single swaps of neighbours. A swap changes what two filters meet, so only these
   two steps are counted anew from the cells; the others stay. A filter's removals are added to its Shapley value in
   every order on the way. Parts are rows, so tasks share them.

Defined cases: a null text counts as empty, a null source as the empty string (one part with that of empty sources);
a null id has no smaller one and is none; rows that repeat an id and a text are not each other's copies; a document
has a label if any of its rows in `labels` has; labels of other documents and null labels do nothing; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE_CLASS, discard, read, written

#: The filter that compares texts with those of other documents.
REPEATED = "E"
#: What is counted in a cell: documents, those of good quality, toxic ones.
COUNTS = ("n", "good", "toxic")
#: Parts that a task walks at once.
ABREAST = 512


def text_filters(text: Column) -> dict[str, Column]:
    """The failure conditions that a text alone decides. text is not null."""
    words = F.array_remove(F.split(text, f"{SPACE_CLASS}+"), "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        "C": capitals * 100 > F.length(text) * 2,
        "D": text.rlike(r"[#$%&*|]"),
    }


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", filters=text_filters) -> tuple[DataFrame, DataFrame]:
    """id, part, mask: filters in the order of their names, the first in the lowest bit, repeated texts in the highest;
    and the written table that it reads."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = filters(text)
    low = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(own.values())), F.lit(0))
    facts = written(docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), low.cast("int").alias("low"), F.unhex(F.sha2(text, 256)).alias("digest")), "audit-facts")
    least = facts.groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows")
    copy = F.coalesce(F.col("id") > F.col("least"), F.lit(False)).cast("int") * (1 << len(own))
    return facts.join(least, "digest", "left").select("id", "part", (F.col("low") + copy).alias("mask")), facts


def cells(masked: DataFrame, labels: DataFrame, filters: int, label_id: str = "doc_id") -> DataFrame:
    """A row for each part: part, and arrays n, good, toxic with a count for each mask."""
    marked = lambda name: F.max(F.coalesce(F.col(name) == 1, F.lit(False)).cast("int"))
    known = labels.groupBy(F.col(label_id).cast("long").alias("id")).agg(marked("quality").alias("good"), marked("toxic").alias("toxic"))
    counted = masked.join(known, "id", "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    found = F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*COUNTS))))
    every = counted.groupBy("part").agg(found.alias("found"))
    # Looked up mask by mask: a part has 2**filters of them at most.
    looked = lambda c: F.array(*[F.coalesce(F.col("found")[m][c], F.lit(0)) for m in range(1 << filters)])
    return every.select("part", *[looked(c).alias(c) for c in COUNTS])


def swaps(n: int) -> Iterator[int]:
    """The places i whose swaps with i + 1 lead through all orders of n, each once."""
    order, direction = list(range(n)), [-1] * n
    while True:
        moving = [x for x in range(n) if 0 <= (to := order.index(x) + direction[x]) < n and order[to] < x]
        if not moving:
            return
        x = max(moving)
        at = order.index(x)
        to = at + direction[x]
        order[at], order[to] = order[to], order[at]
        yield min(at, to)
        direction[x + 1 :] = [-d for d in direction[x + 1 :]]


def walk(counts: dict[str, np.ndarray], filters: int) -> Iterator[tuple[tuple[int, ...], list[dict[str, np.ndarray]]]]:
    """Every order with its steps. counts: (parts, masks) for each name. A step: kept, removed, good_lost, toxic_lost,
    an array over parts each. The list of steps is the same one all along; only the two swapped steps change."""
    mask = np.arange(1 << filters)

    def met(before: int, f: int) -> dict[str, np.ndarray]:
        """The step of filter f after the filters in the bits of `before`."""
        goes = ((mask & before) == 0) & (mask >> f & 1 == 1)
        stays = (mask & (before | 1 << f)) == 0
        return {"kept": counts["n"] @ stays, "removed": counts["n"] @ goes, "good_lost": counts["good"] @ goes, "toxic_lost": counts["toxic"] @ goes}

    order = list(range(filters))
    before = [(1 << i) - 1 for i in range(filters)]
    steps = [met(b, f) for b, f in zip(before, order, strict=True)]
    yield tuple(order), steps
    for i in swaps(filters):
        order[i], order[i + 1] = order[i + 1], order[i]
        before[i + 1] = before[i] | 1 << order[i]
        steps[i], steps[i + 1] = met(before[i], order[i]), met(before[i + 1], order[i + 1])
        yield tuple(order), steps


def _orders(names: str):
    filters = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.arange(1 << filters)
        for batch in (b.slice(low, ABREAST) for b in batches for low in range(0, b.num_rows, ABREAST)):
            counts = {c: np.stack(batch.column(c).to_numpy(zero_copy_only=False)).astype(np.int64) for c in COUNTS}
            fails = np.stack([counts["n"] @ (bits >> f & 1) for f in range(filters)])
            only = np.stack([counts["n"][:, 1 << f] for f in range(filters)])
            shapley, rows = np.zeros((filters, batch.num_rows), np.int64), []
            for order, steps in walk(counts, filters):
                for place, f in enumerate(order):
                    shapley[f] += steps[place]["removed"]
                    rows.append(("".join(names[x] for x in order), place + 1, f, steps[place]))
            for name, place, f, step in rows:
                figures = [step["kept"], step["removed"], fails[f] - step["removed"], only[f], step["good_lost"], step["toxic_lost"], shapley[f]]
                head = [batch.column("part"), pa.array([name] * batch.num_rows), pa.array([place] * batch.num_rows, pa.int32())]
                yield pa.RecordBatch.from_arrays([*head, *map(pa.array, figures)], OUT)

    return run


OUT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in OUT[3:])


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", label_id: str = "doc_id", filters=text_filters) -> DataFrame:
    """A row for each part, order and step."""
    names = "".join(filters(F.lit(""))) + REPEATED
    masked, facts = masks(docs, id_col, text_col, part_col, filters)
    counted = written(cells(masked, labels, len(names), label_id), "audit-cells")
    discard(facts)
    return counted.mapInArrow(_orders(names), SCHEMA)


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir), read(spark, sf_dir, "labels"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), l AS (
  SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INT)) AS good, max(CAST(coalesce(toxic = 1, false) AS INT)) AS toxic
  FROM labels GROUP BY doc_id
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d
), m AS (
  SELECT part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
         CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN coalesce(w.doc_id > least, false) THEN 16 ELSE 0 END AS mask
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id
), c AS MATERIALIZED (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask
), o AS (
  SELECT '' AS filter_order, 0 AS step, 0 AS before, 0 AS bit
  UNION ALL
  SELECT filter_order || f.name, step + 1, o.before | o.bit, f.bit
  FROM o, (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS f(name, bit) WHERE (o.before | o.bit) & f.bit = 0
), t AS (
  SELECT q.filter_order, o.step, o.before, o.bit FROM o q JOIN o ON q.step = 5 AND o.step > 0 AND q.filter_order[1:o.step] = o.filter_order
), r AS (
  SELECT part, before, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, (SELECT DISTINCT before, bit FROM t) GROUP BY part, before, bit
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM t JOIN r USING (before, bit)
"""
