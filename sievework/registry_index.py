"""Queries over the stored indexes: changes, best rows by bounds, vocabulary, vectors, folder choices; and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework import registry_sql as Q
from sievework.operators import folders as D
from sievework.operators import hours, media, sync, vectors
from sievework.operators.keyword_index import KeywordIndex
from sievework.plans.delta import DeltaStore
from sievework.plans.stored import index_folder, stored
from sievework.registry import _MATCHED, _PATHS, _ROWS_SQL, _SCORED, SIX, TERMS, _index, _query_vector, _rows, _two_crawls, _vectors, query, table

# --- keywords ------------------------------------------------------------------------------------------------------

_CHANGED_SQL = "rows_of AS (SELECT doc_id AS rowid, doc_id // 2 AS file, source AS name, CASE WHEN doc_id % 10 = 2 THEN 'erst ' || text ELSE text END AS body FROM documents WHERE doc_id % 10 <> 1)"


def _changed(spark, sf_dir) -> KeywordIndex:
    """The index of nine tenths of the documents, after a tenth has gone, a tenth was rewritten and a tenth has come."""
    rows, tenth = _rows(spark, sf_dir), F.col("rowid") % 10

    def make(folder: str) -> None:
        index = KeywordIndex(spark, folder)
        index.update(rows.where(tenth != 3))
        new = rows.where(tenth.isin(2, 3)).withColumn("body", F.when(tenth == 2, F.concat(F.lit("erst "), "body")).otherwise(F.col("body")))
        index.update(new, rows.where(tenth.isin(1, 2)).select("rowid"))

    return KeywordIndex(spark, stored(spark, "keywords-changed", f"{sf_dir}/documents.parquet", make))


@query(f"WITH {_MATCHED.replace(_ROWS_SQL, _CHANGED_SQL)} SELECT rowid, round(bm25, 6) AS bm25 FROM bm ORDER BY bm.bm25, rowid LIMIT 1000")
def changed_index_topk(spark, sf_dir):
    return _changed(spark, sf_dir).top(TERMS, 1000).select("rowid", SIX("bm25").alias("bm25"))


@query(f"WITH {_CHANGED_SQL}, {Q.postings('rows_of')} SELECT token, count(*) AS docs, CAST(sum(un + ub) AS BIGINT) AS uses FROM uses GROUP BY token")
def changed_index_words(spark, sf_dir):
    return _changed(spark, sf_dir).words


@query(f"WITH {_MATCHED} SELECT rowid, file, round(bm25, 6) AS bm25 FROM bm ORDER BY bm.bm25, rowid LIMIT 100")
def bounded_topk(spark, sf_dir):
    return _index(spark, sf_dir).top(TERMS, 100, small=0).withColumn("bm25", SIX("bm25"))


@query(f"WITH {_ROWS_SQL}, {Q.postings('rows_of')} SELECT token, count(*) AS docs, CAST(sum(un + ub) AS BIGINT) AS uses FROM uses WHERE starts_with(token, 'er') GROUP BY token")
def words_begun(spark, sf_dir):
    return _index(spark, sf_dir).begun("er")


# --- tables that change --------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS id, o_orderstatus AS status, CAST(round(o_totalprice * 100) AS BIGINT) + CASE WHEN o_orderkey % 10 IN (2, 3) THEN 1 ELSE 0 END AS cents FROM orders WHERE o_orderkey % 10 <> 1")
def changed_tables(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    tenth = F.col("id") % 10
    store = DeltaStore(spark, f"{index_folder(spark)}/changed-{uuid.uuid4().hex}", {"orders": "id long, status string, cents long"}, {"orders": "id"})
    change = store.begin()
    change.append("orders", o.where(tenth != 3))
    change.commit()
    change = store.begin()
    change.delete("orders", o.where(tenth == 1))
    change.upsert("orders", o.where(tenth.isin(2, 3)).withColumn("cents", F.col("cents") + 1))
    change.commit()
    store.compact("orders")
    return store.table("orders")


@query(f"""WITH {_PATHS}, s AS (SELECT path, min(id) AS id, arg_min(size, id) AS size FROM paths WHERE id % 10 <> 1 GROUP BY path),
c AS (SELECT path, min(id) AS id, arg_min(size, id) AS size, arg_min(mt, id) AS mt FROM (SELECT CASE WHEN id % 10 = 3 THEN '/new' || path ELSE path END AS path, id, CASE WHEN id % 10 = 4 THEN size + 1 ELSE size END AS size, size AS mt
  FROM paths WHERE id % 10 <> 2) GROUP BY path),
f AS (SELECT c.path AS cp, s.path AS sp, c.id AS ci, s.id AS si, c.size AS cs, s.size AS ss, c.mt AS cm FROM c FULL JOIN s ON c.path = s.path),
m AS (SELECT n.cp, g.sp FROM f n JOIN f g ON n.sp IS NULL AND g.cp IS NULL AND n.ci = g.si AND n.cs = g.ss AND n.cm = g.ss)
SELECT cp AS path, CASE WHEN cs = ss AND cm = ss THEN 'unchanged' ELSE 'changed' END AS change, NULL AS old_path FROM f WHERE cp IS NOT NULL AND sp IS NOT NULL
UNION ALL SELECT cp, 'moved', sp FROM m UNION ALL SELECT cp, 'added', NULL FROM f WHERE sp IS NULL AND cp NOT IN (SELECT cp FROM m)
UNION ALL SELECT sp, 'removed', NULL FROM f WHERE cp IS NULL AND sp NOT IN (SELECT sp FROM m)""")
def repeated_paths_sync(spark, sf_dir):
    """Two crawls in which paths repeat, all rows of them."""
    return sync.reconcile(*_two_crawls(spark, sf_dir))


# --- vectors -------------------------------------------------------------------------------------------------------


@query(f"WITH {_SCORED} SELECT file, segment, round(z, 6) AS z, kind FROM b ORDER BY b.z DESC, file LIMIT 50")
def nearest_files(spark, sf_dir):
    index, q = _vectors(spark, sf_dir), list(_query_vector(spark, sf_dir).first()["q"])
    found = spark.createDataFrame(index.best_files(q, index.scale(q), 50, small=0), vectors.FOUND)
    return found.select("file", "segment", SIX("z").alias("z"), "kind")


@query(f"WITH {_SCORED} SELECT CAST(modality AS VARCHAR) AS modality, round(mean, 6) AS mean, round(mu, 6) AS mu, round(sigma, 6) AS sigma FROM m, g")
def query_scale(spark, sf_dir):
    q = list(_query_vector(spark, sf_dir).first()["q"])
    scale = _vectors(spark, sf_dir).scale(q)
    rows = [(m, float(mean), float(scale.mu), float(scale.sigma)) for m, mean in scale.means.items()]
    return spark.createDataFrame(rows, "modality string, mean double, mu double, sigma double").select("modality", *[SIX(c).alias(c) for c in ("mean", "mu", "sigma")])


_STEP = "pow(2, greatest(floor(log2(abs(x))), -14) - 10)"


@query(f"SELECT vec_id, [CASE WHEN x = 0 THEN CAST(0 AS DOUBLE) ELSE round_even(x / {_STEP}, 0) * {_STEP} END FOR x IN CAST(embedding AS DOUBLE[])] AS half FROM embeddings")
def half_rounding(spark, sf_dir):
    """What a vector is after it was stored as 16-bit floats: 11 bits, half to even."""
    back = media.from_half(media.half_bytes(F.col("embedding"))).cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", back.alias("half"))


# --- folders -------------------------------------------------------------------------------------------------------

_HOME = "'/home/' || CAST({0} % 100 AS VARCHAR) || '/' || CAST({0} AS VARCHAR)"
_CHOICES_SQL = f"""p AS (SELECT o_orderkey AS id, {_HOME.format('o_custkey')} || '/' || CASE o_orderkey % 11 WHEN 0 THEN '.cache' WHEN 1 THEN 'node_modules' ELSE 'd' || CAST(o_orderkey % 5 AS VARCHAR) END
  || '/' || CAST(o_orderkey AS VARCHAR) || '.txt' AS path FROM orders),
k AS (SELECT c_custkey AS k, {_HOME.format('c_custkey')} AS home FROM customer),
c AS (SELECT home AS folder, 'chosen' AS choice FROM k WHERE k % 3 = 0 UNION ALL SELECT home || '/d2', 'chosen' FROM k WHERE k % 4 = 0 UNION ALL SELECT '/home/' || CAST(k % 100 AS VARCHAR), 'chosen' FROM k WHERE k % 100 < 10
  UNION ALL SELECT home || '/d2', 'skipped' FROM k WHERE k % 5 = 0 UNION ALL SELECT home, 'skipped' FROM k WHERE k % 6 = 0 UNION ALL SELECT home || '/.cache', 'kept' FROM k WHERE k % 7 = 0)"""
#: What a walk doesn't enter, of the folders that occur here.
_CLOSED = r"'/(\.[^/]*|[^/]*\.noindex|node_modules)(/|$)'"


def _choices(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    home = lambda k: F.concat(F.lit("/home/"), (k % 100).cast("string"), F.lit("/"), k.cast("string"))
    o, n = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    below = F.when(n % 11 == 0, ".cache").when(n % 11 == 1, "node_modules").otherwise(F.concat(F.lit("d"), (n % 5).cast("string")))
    paths = o.select(n.alias("id"), F.concat(home(F.col("o_custkey")), F.lit("/"), below, F.lit("/"), n.cast("string"), F.lit(".txt")).alias("path"))
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    ways = [(k % 3 == 0, home(k), D.CHOSEN), (k % 4 == 0, F.concat(home(k), F.lit("/d2")), D.CHOSEN), (k % 100 < 10, F.concat(F.lit("/home/"), (k % 100).cast("string")), D.CHOSEN), (k % 5 == 0, F.concat(home(k), F.lit("/d2")), D.SKIPPED), (k % 6 == 0, home(k), D.SKIPPED), (k % 7 == 0, F.concat(home(k), F.lit("/.cache")), D.KEPT)]
    said = F.array_compact(F.array(*[F.when(test, F.struct(folder.alias("folder"), F.lit(choice).alias("choice"))) for test, folder, choice in ways]))
    return paths, c.select(F.explode(said).alias("x")).select("x.*")


@query(rf"""WITH {_CHOICES_SQL},
a AS (SELECT id, path, array_to_string(string_split(path, '/')[1:i], '/') AS f FROM (SELECT id, path, unnest(range(2, len(string_split(path, '/')) + 1)) AS i FROM p)),
t AS (SELECT a.id, a.f FROM a JOIN (SELECT DISTINCT folder FROM c WHERE choice <> 'skipped') k ON k.folder = a.f
  WHERE NOT regexp_matches(substr(a.path, length(a.f) + 1), {_CLOSED})),
s AS (SELECT DISTINCT a.id, a.f FROM a JOIN c ON c.folder = a.f AND c.choice = 'skipped'),
u AS (SELECT t.id, t.f FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.id = t.id AND length(s.f) > length(t.f)))
SELECT p.id, count(u.f) > 0 AS searched, arg_max(u.f, length(u.f)) AS searched_as FROM p LEFT JOIN u ON u.id = p.id GROUP BY p.id""")
def folder_standing(spark, sf_dir):
    return D.standing(*_choices(spark, sf_dir)).select("id", "searched", "searched_as")


@query(rf"""WITH {_CHOICES_SQL}, d AS (SELECT DISTINCT folder, choice FROM c),
t AS (SELECT d.folder, d.choice, x.folder AS top FROM d JOIN (SELECT DISTINCT folder FROM d WHERE choice <> 'skipped') x ON starts_with(d.folder, x.folder || '/')),
u AS (SELECT t.* FROM t WHERE NOT regexp_matches(substr(t.folder, length(t.top) + 1), {_CLOSED})
  AND NOT EXISTS (SELECT 1 FROM d s WHERE s.choice = 'skipped' AND starts_with(s.folder, t.top || '/') AND (s.folder = t.folder OR starts_with(t.folder, s.folder || '/'))))
SELECT folder, choice FROM d WHERE CASE WHEN choice = 'skipped' THEN EXISTS (SELECT 1 FROM t WHERE t.folder = d.folder) ELSE NOT EXISTS (SELECT 1 FROM u WHERE u.folder = d.folder AND u.choice = d.choice) END""")
def folder_choices(spark, sf_dir):
    return D.effective(_choices(spark, sf_dir)[1])


# --- hours ---------------------------------------------------------------------------------------------------------

_LOCAL = "extract(hour FROM {0} + o * INTERVAL 1 HOUR) * 60 + extract(minute FROM {0} + o * INTERVAL 1 HOUR) BETWEEN 150 AND 1319"


@query(f"""WITH e AS (SELECT event_id, date_trunc('second', ts) + CAST(event_id % 366 AS INT) * INTERVAL 1 DAY AS ts FROM events),
p(f, t, o) AS (VALUES (TIMESTAMP '2023-10-29 01:00:00', TIMESTAMP '2024-03-31 01:00:00', 1), (TIMESTAMP '2024-03-31 01:00:00', TIMESTAMP '2024-10-27 01:00:00', 2), (TIMESTAMP '2024-10-27 01:00:00', TIMESTAMP '2025-03-30 01:00:00', 1)),
d AS (SELECT unnest(range(TIMESTAMP '2023-12-28', TIMESTAMP '2025-02-08', INTERVAL 1 MINUTE)) AS u),
m AS (SELECT u, {_LOCAL.format('u')} AS is_open FROM d JOIN p ON u >= f AND u < t),
x AS (SELECT u FROM (SELECT u, is_open, lag(is_open) OVER (ORDER BY u) AS was FROM m) WHERE is_open <> was),
n AS (SELECT e.event_id, e.ts, x.u FROM e ASOF JOIN x ON e.ts < x.u)
SELECT event_id, {_LOCAL.format('ts')} AS open, epoch(u)::BIGINT AS next_change FROM n JOIN p ON ts >= f AND ts < t""")
def hours_by_zone(spark, sf_dir):
    """From 02:30 to 22:00 in Berlin: on the night that clocks go forward 02:30 doesn't exist, in autumn it comes twice."""
    at = F.unix_timestamp(F.date_trunc("second", F.col("ts")).cast("timestamp")) + (F.col("event_id") % 366) * hours.DAY
    events = table(spark, sf_dir, "events").select("event_id", at.alias("at"))
    first, last = events.agg(F.min("at"), F.max("at")).first()
    return hours.with_hours(events, "at", 150, 1320, "Europe/Berlin", first, last).select("event_id", "open", "next_change")
