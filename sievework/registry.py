"""Queries over the provided tables, one or more for each operator, and their SQL for DuckDB.

Tables stand in for the index: documents for files with text, embeddings for vectors (label as modality), orders for a
crawl's metadata, events for changes. Sums of doubles are rounded, since their order differs between engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.functions import embedding, passages
from sievework.functions import text as T
from sievework.operators import estimate as E
from sievework.operators import evaluate as V
from sievework.operators import postings as P
from sievework.operators import ranking as R
from sievework import registry_sql as Q
from sievework.operators import rules, segment, sync
from sievework.operators.search import search, word_files
from sievework.plans.stored import keyword_index, vector_index
from sievework.streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TERMS = ["erst", "schpf", "ouche", "thation"]
SIX = lambda c: F.round(c, 6)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- vectors -------------------------------------------------------------------------------------------------------


def _segments(spark, sf_dir) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ["image", "pdf", "doc"])), (F.col("vec_id") % 3 + 1).cast("int"))
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), (F.floor(F.col("vec_id") / 4)).alias("file"), kind.alias("kind"), F.col("label").alias("modality"), (F.col("vec_id") % 10 != 9).alias("sets_scale"), F.col("embedding").alias("vec"))


def _query_vector(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))


def _scored(spark, sf_dir) -> DataFrame:
    return R.cosines(_segments(spark, sf_dir), _query_vector(spark, sf_dir))


def _vectors(spark, sf_dir):
    """The stored vector index of embeddings."""
    return vector_index(spark, f"{sf_dir}/embeddings.parquet", _segments(spark, sf_dir))


_SCORED = """
q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id AS id, vec_id // 4 AS file, (['image','pdf','doc'])[CAST(vec_id % 3 AS INT) + 1] AS kind, label AS modality,
      vec_id % 10 <> 9 AS sets_scale,
      list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(q[i] AS DOUBLE))) AS cosine
      FROM embeddings, q),
o AS (SELECT avg(cosine) AS overall FROM s WHERE sets_scale),
m AS (SELECT modality, count(*) AS n, CASE WHEN count(*) >= 20 THEN avg(cosine) ELSE any_value(overall) END AS mean
      FROM s, o WHERE sets_scale GROUP BY modality),
c AS (SELECT s.*, cosine - coalesce(mean, overall) AS d FROM s LEFT JOIN m USING (modality), o),
g AS (SELECT avg(d) AS mu, greatest(stddev_pop(d), 0.02) AS sigma FROM c WHERE sets_scale),
z AS (SELECT c.*, (d - mu) / sigma AS z FROM c, g),
b AS (SELECT file, arg_max(id, (z, -id)) AS segment, max(z) AS z, arg_max(kind, (z, -id)) AS kind FROM z GROUP BY file)
"""


@query(f"WITH {_SCORED} SELECT id, round(cosine, 6) AS cosine FROM s ORDER BY s.cosine DESC, id LIMIT 20")
def cosine_topk(spark, sf_dir):
    return _scored(spark, sf_dir).orderBy(F.desc("cosine"), "id").limit(20).select("id", SIX("cosine").alias("cosine"))


@query(f"WITH {_SCORED} SELECT modality, n, round(mean, 6) AS mean FROM m")
def modality_means(spark, sf_dir):
    return R.modality_means(_scored(spark, sf_dir)).select("modality", "n", SIX("mean").alias("mean"))


@query(f"WITH {_SCORED} SELECT id, round(z, 6) AS z FROM z")
def meaning_zscore(spark, sf_dir):
    return R.with_meaning(_scored(spark, sf_dir)).select("id", SIX("z").alias("z"))


@query(f"WITH {_SCORED} SELECT file, segment, round(z, 6) AS z, kind FROM b")
def best_segment_per_group(spark, sf_dir):
    return R.best_per_file(R.with_meaning(_scored(spark, sf_dir))).select("file", "segment", SIX("z").alias("z"), "kind")


@query(f"WITH {_SCORED} SELECT file, arg_max(id, (z, -id)) AS segment, round(max(z), 6) AS z FROM z WHERE kind IN ('pdf', 'doc') GROUP BY file")
def kind_filter_after_scale(spark, sf_dir):
    return R.best_per_file(R.with_meaning(_scored(spark, sf_dir)), ["pdf", "doc"]).select("file", "segment", SIX("z").alias("z"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 5) AS norm FROM embeddings")
def vector_norms(spark, sf_dir):
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(R.dot(v, v)), 5).alias("norm"))


# --- keywords ------------------------------------------------------------------------------------------------------


def _rows(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("rowid"), (F.floor(F.col("doc_id") / 2)).alias("file"), F.col("source").alias("name"), F.col("text").alias("body"))


def _index(spark, sf_dir):
    """The stored keyword index of documents: built by the first search, read by all."""
    return keyword_index(spark, f"{sf_dir}/documents.parquet", _rows(spark, sf_dir))


_ROWS_SQL = "rows_of AS (SELECT doc_id AS rowid, doc_id // 2 AS file, source AS name, text AS body FROM documents)"
_MATCHED = f"""{_ROWS_SQL}, {Q.postings('rows_of')},
asked AS (SELECT unnest({TERMS!r}) AS w), {Q.stems('asked', 'wanted', 'a')},
st AS (SELECT count(*) AS total, avg(length) AS mean FROM sizes),
hit AS (SELECT wanted.w AS term, uses.rowid, uses.file, un, ub FROM wanted JOIN uses USING (token)),
df AS (SELECT term, count(*) AS df FROM hit GROUP BY term),
bm AS (SELECT hit.rowid, any_value(hit.file) AS file, -sum(greatest(ln((total - df + 0.5) / (df + 0.5)), 1e-6) * (3.0 * un + ub) * 2.2 / ((3.0 * un + ub) + 1.2 * (0.25 + 0.75 * length / mean))) AS bm25
       FROM hit JOIN df USING (term) JOIN sizes ON sizes.rowid = hit.rowid, st GROUP BY hit.rowid),
best AS (SELECT * FROM bm ORDER BY bm25, rowid LIMIT 1000),
kf AS (SELECT file, min(bm25) AS bm25, arg_min(rowid, (bm25, rowid)) AS rowid FROM best GROUP BY file ORDER BY 2, 3 LIMIT 100),
cov AS (SELECT hit.file, count(DISTINCT term) / 4.0 AS coverage FROM hit JOIN kf ON hit.file = kf.file GROUP BY hit.file)"""


@query(f"WITH {_ROWS_SQL}, {Q.postings('(SELECT rowid, file, NULL AS name, body FROM rows_of)')} SELECT token AS term, CAST(sum(ub) AS BIGINT) AS uses, count(*) AS docs FROM uses GROUP BY token")
def terms_vocab(spark, sf_dir):
    return P.vocabulary(_index(spark, sf_dir).postings.withColumn("names", F.lit(0)).where("bodies > 0"))


@query(f"WITH {_ROWS_SQL}, {Q.postings('rows_of')} SELECT token AS term, rowid, CAST(ub AS BIGINT) AS tf FROM uses WHERE ub > 0")
def postings_body(spark, sf_dir):
    return _index(spark, sf_dir).postings.where("bodies > 0").select(F.col("token").alias("term"), "rowid", F.col("bodies").cast("long").alias("tf"))


@query(f"WITH {_MATCHED} SELECT rowid, round(bm25, 6) AS bm25 FROM bm ORDER BY bm.bm25, rowid LIMIT 50")
def bm25_topk(spark, sf_dir):
    return _index(spark, sf_dir).top(TERMS, 50).select("rowid", SIX("bm25").alias("bm25"))


@query(f"WITH {_MATCHED} SELECT file, round(bm25, 6) AS bm25, rowid FROM kf")
def keyword_files(spark, sf_dir):
    return P.keyword_files(_index(spark, sf_dir).top(TERMS, P.ROWS)).select("file", SIX("bm25").alias("bm25"), "rowid")


@query(f"WITH {_MATCHED} SELECT file, CAST(coverage AS DOUBLE) AS coverage FROM cov")
def coverage(spark, sf_dir):
    return word_files(_index(spark, sf_dir), TERMS, widen=False).select("file", "coverage")


@query(f"""WITH {_ROWS_SQL}, {Q.postings('rows_of')}, asked AS (SELECT unnest(['erst', 'schp', 'zzzz', 'ouch', 'er']) AS w),
{Q.stems('asked', 'wanted', 'a')}
SELECT w AS term, length(w) >= 3 AND NOT EXISTS (SELECT 1 FROM uses WHERE uses.token = wanted.token) AS is_prefix FROM wanted""")
def prefix_widen(spark, sf_dir):
    terms = ["erst", "schp", "zzzz", "ouch", "er"]
    return spark.createDataFrame(list(zip(terms, _index(spark, sf_dir).prefixes(terms), strict=True)), "term string, is_prefix boolean")


@query(f"""WITH {_ROWS_SQL}, {Q.postings('rows_of')}, placed AS (SELECT rowid, unnest(range(1, len(b) + 1)) AS i, unnest(b) AS w FROM cuts),
t AS (SELECT rowid, i, token FROM placed JOIN stemmed USING (w)) SELECT DISTINCT x.rowid FROM t x JOIN t y ON x.rowid = y.rowid AND y.i = x.i + 1 WHERE x.token = 'the' AND y.token = 'by'""")
def phrase_rows(spark, sf_dir):
    return _index(spark, sf_dir).phrase(["the", "by"]).select("rowid")


_FUSED = f"""{_SCORED}, {_MATCHED.strip()},
f AS (SELECT coalesce(b.file, cov.file) AS file, coalesce(z, 0) AS z, coalesce(coverage, 0) AS coverage FROM b FULL JOIN cov ON b.file = cov.file),
h AS (SELECT file, greatest(z, 0) + 2.0 * pow(coverage, 1.5) AS score FROM f WHERE z >= 2.0 OR coverage >= 0.5),
top AS (SELECT * FROM h ORDER BY score DESC, file LIMIT 20)"""


def _hits(spark, sf_dir, limit=20):
    return search(_segments(spark, sf_dir), _query_vector(spark, sf_dir), _index(spark, sf_dir), " ".join(TERMS), limit=limit, widen=False, vectors=_vectors(spark, sf_dir))


@query(f"WITH {_FUSED} SELECT file, round(score, 6) AS score FROM top")
def hybrid_fuse(spark, sf_dir):
    return _hits(spark, sf_dir).select("file", SIX("score").alias("score"))


def flagship(spark, sf_dir):
    return hybrid_fuse(spark, sf_dir)


@query(f"WITH {_FUSED} SELECT file, max(score) OVER () <= 0 OR score >= 0.5 * max(score) OVER () AS strong FROM top")
def strong_fold(spark, sf_dir):
    return _hits(spark, sf_dir).select("file", "strong")


@query("""WITH h AS (SELECT o_orderkey AS file, o_orderpriority AS kind, o_totalprice AS score FROM orders),
p AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, file) AS place, count(*) OVER (PARTITION BY kind) AS total FROM h)
SELECT kind, file, place, total FROM p WHERE place <= 3""")
def group_topk_by_kind(spark, sf_dir):
    hits = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), F.col("o_orderpriority").alias("kind"), F.col("o_totalprice").alias("score"))
    return R.grouped(hits, "kind", 3).select("kind", "file", F.col("place").cast("long").alias("place"), "total")


# --- text ----------------------------------------------------------------------------------------------------------


@query(r"""WITH t AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda w: length(w) >= 2))) AS term FROM benchmark)
SELECT item_id, term FROM t WHERE term NOT IN ('""" + "','".join(T.STOPWORDS) + """')""")
def query_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.terms(F.col("text"))).alias("term"))


@query(r"""SELECT event_id, regexp_matches(t, '\p{N}') AND (regexp_matches(t, '\p{L}') OR length(t) >= 4) AS lookup
FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'k' ELSE '' END || CAST(event_id AS VARCHAR) AS t FROM events)""")
def lookup_terms(spark, sf_dir):
    t = F.concat(F.when(F.col("event_id") % 3 == 0, "k").otherwise(""), F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", T.is_lookup(F.array(t)).alias("lookup"))


_LETTERS = r"length(regexp_replace(text, '[^\p{L}\p{M}]', '', 'g'))"
_HAS_WORDS = rf"{_LETTERS} > 0 AND {_LETTERS} * 4 >= length(regexp_replace(text, '\s', '', 'g')) - {_LETTERS}"


@query(f"SELECT doc_id, {_HAS_WORDS} AS has_words FROM documents")
def has_words_flag(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.has_words(F.col("text")).alias("has_words"))


@query(rf"SELECT doc_id, {_HAS_WORDS} AND len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: regexp_matches(w, '[\p{{L}}\p{{M}}]'))) >= 4 AS has_prose FROM documents")
def has_prose_flag(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.has_prose(F.col("text")).alias("has_prose"))


def _html_sql() -> str:
    """Cut at brackets: what stands before the first is text; each later part is a tag up to its own bracket, then text."""
    bare = r"regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>', ' ', 'g')"
    tag = r"CASE WHEN regexp_matches(p, '(?i)^(br|/p|/div|/li|/h[1-6]|/tr|/section|/article)\b') THEN chr(10) ELSE ' ' END"
    part = f"CASE WHEN strpos(p, '>') > 1 THEN {tag} || substr(p, strpos(p, '>') + 1) ELSE '<' || p END"
    letters = "".join(f" WHEN '{n[1:]}' THEN '{x.replace(chr(39), chr(39) * 2)}'" for n, x in T.ENTITIES.items())
    number = r"CASE WHEN regexp_matches(e, '^#[0-9]{1,7};') THEN chr(CAST(regexp_extract(e, '^#([0-9]+);', 1) AS INT)) || regexp_replace(e, '^#[0-9]+;', '') ELSE '&' || e END"
    entity = f"CASE regexp_extract(e, '^#?\\w+;'){letters} END || regexp_replace(e, '^#?\\w+;', '')"
    out = f"""WITH s AS (SELECT page_id, string_split({bare}, '<') AS a FROM pages), t AS (SELECT page_id, a[1] || array_to_string(list_transform(a[2:], lambda p: {part}), '') AS x FROM s),
u AS (SELECT page_id, string_split(x, '&') AS b FROM t), v AS (SELECT page_id, b[1] || array_to_string(list_transform(b[2:], lambda e: coalesce({entity}, {number})), '') AS x FROM u)"""
    return out + r" SELECT page_id, regexp_replace(regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS body FROM v"


@query(_html_sql())
def html_plaintext(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.plain_text(F.col("html")).alias("body"))


@query(r"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) > 240 THEN substr(t, 1, 240) || '…' ELSE t END AS excerpt FROM f""")
def excerpt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


@query(r"SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + CASE WHEN length(text) > 0 AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END AS lines FROM documents")
def line_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.line_count(F.col("text")).cast("long").alias("lines"))


@query(r"""WITH RECURSIVE t AS (SELECT doc_id AS id, regexp_replace(regexp_replace(regexp_replace(text, '[ \t\x{00A0}]+', ' ', 'g'), '\n\s*\n\s*\n+', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS x FROM documents),
e AS (SELECT id, x, 0 AS b, least(1800, length(x)) AS top FROM t WHERE length(x) > 0),
c AS (SELECT id, x, b, CASE WHEN top < length(x) AND regexp_matches(substr(x, b + 902, top - b - 901), '\s') THEN b + 901 + length(regexp_extract(substr(x, b + 902, top - b - 901), '(?s)^(.*)\s', 1)) ELSE top END AS z FROM e
UNION ALL SELECT id, x, b, CASE WHEN top < length(x) AND regexp_matches(substr(x, b + 902, top - b - 901), '\s') THEN b + 901 + length(regexp_extract(substr(x, b + 902, top - b - 901), '(?s)^(.*)\s', 1)) ELSE top END
FROM (SELECT id, x, n AS b, least(n + 1800, length(x)) AS top FROM (SELECT id, x, z, CASE WHEN regexp_matches(substr(x, a + 1, z - a), '\s') THEN a + length(regexp_extract(substr(x, a + 1, z - a), '^(\S*)', 1)) ELSE z END AS n
  FROM (SELECT id, x, z, CASE WHEN z - 200 > b THEN z - 200 ELSE z END AS a FROM c WHERE z < length(x))))),
p AS (SELECT id, b, regexp_replace(substr(x, b + 1, z - b), '^\s+|\s+$', '', 'g') AS chunk FROM c)
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY b) AS INT) AS loc, chunk FROM p WHERE chunk <> ''""")
def chunks_doc(spark, sf_dir):
    return segment.chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def code_stretches(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("/code/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), "text")
    return segment.code_stretches(files)


# These documents hold no compatibility letters, so that NFC is all that normalising does.
@query("SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def normalized_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalized(F.col("text")).alias("text"))


# --- media ---------------------------------------------------------------------------------------------------------

_WINDOWS = "least(k * 25e0 + 30e0, d)"


@query(f"""WITH m AS (SELECT event_id, value * 4 AS d FROM events),
w AS (SELECT event_id, d, unnest(range(0, CAST(greatest(floor((d - 7.0) / 25.0), 0) AS BIGINT) + 1)) AS k FROM m WHERE d > 0)
SELECT event_id, round(k * 25e0, 6) AS start, round({_WINDOWS}, 6) AS "end" FROM w""")
def audio_windows(spark, sf_dir):
    m = table(spark, sf_dir, "events").select("event_id", (F.col("value") * 4).alias("d"))
    return m.select("event_id", F.explode(segment.audio_windows(F.col("d"))).alias("w")).select("event_id", SIX("w.start").alias("start"), SIX("w.end").alias("end"))


@query("SELECT user_id, event_id, coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id), 1000000) AS until FROM events")
def keyframe_lead(spark, sf_dir):
    f = table(spark, sf_dir, "events").withColumn("duration", F.lit(1000000).cast("long"))
    return segment.shown_until(f, "user_id", "event_id", "duration").select("user_id", "event_id", "until")


@query("""WITH RECURSIVE f AS (SELECT user_id AS file, event_id AS start, (event_id * 40503) % 65536 AS hash FROM events),
k AS (SELECT file, min(start) AS start, arg_min(hash, start) AS hash FROM f GROUP BY file
UNION ALL SELECT k.file, min(f.start), arg_min(f.hash, f.start) FROM k JOIN f ON f.file = k.file AND f.start > k.start AND bit_count(xor(f.hash, k.hash)) > 4 GROUP BY k.file)
SELECT file, start, hash FROM k""")
def keyframes_kept(spark, sf_dir):
    f = table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("start"), ((F.col("event_id") * 40503) % 65536).alias("hash"))
    return segment.kept_frames(f).select("file", "start", "hash")


@query("""WITH p AS (SELECT o_orderkey AS file, CAST(o_orderkey % 400 + 1 AS INT) AS total FROM orders),
s AS (SELECT file, total, unnest(list_concat([0], range(40, CASE WHEN total > 40 THEN total ELSE 40 END, 40))) AS start FROM p)
SELECT file, start, CASE WHEN start = 0 THEN least(40, total) ELSE least(start + 40, total) END AS "end" FROM s""")
def long_file_steps(spark, sf_dir):
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), (F.col("o_orderkey") % 400 + 1).cast("int").alias("total"))
    return p.select("file", F.explode(segment.steps(40, 40, F.col("total"))).alias("s")).select("file", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


# --- rules and folders -------------------------------------------------------------------------------------------

_EXTENSIONS = ["jpg", "wav", "mp4", "txt", "pdf", "py", "m4p", "zip", "md", "png", "ts"]


def _paths(spark, sf_dir) -> DataFrame:
    """A crawl made of orders: path, kind-neutral metadata."""
    o = table(spark, sf_dir, "orders")
    ext = F.element_at(F.array(*map(F.lit, _EXTENSIONS)), (F.col("o_orderkey") % len(_EXTENSIONS) + 1).cast("int"))
    stem = F.when(F.col("o_custkey") % 10 < 8, F.concat(F.lit("clip_"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0"))).otherwise(F.concat(F.lit("Screenshot of "), F.col("o_custkey").cast("string")))
    path = F.concat(F.lit("/data/c"), (F.col("o_custkey") % 7).cast("string"), F.lit("/"), stem, F.lit("."), ext)
    return o.select(F.col("o_orderkey").alias("id"), path.alias("path"), F.floor("o_totalprice").cast("long").alias("size"), F.col("o_custkey").alias("inode"))


_PATHS = f"""paths AS (SELECT o_orderkey AS id, '/data/c' || CAST(o_custkey % 7 AS VARCHAR) || '/' ||
  CASE WHEN o_custkey % 10 < 8 THEN 'clip_' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') ELSE 'Screenshot of ' || CAST(o_custkey AS VARCHAR) END
  || '.' || ({_EXTENSIONS!r})[CAST(o_orderkey % {len(_EXTENSIONS)} AS INT) + 1] AS path, CAST(floor(o_totalprice) AS BIGINT) AS size, o_custkey AS inode,
  o_custkey % 10 >= 8 AS shot, ({_EXTENSIONS!r})[CAST(o_orderkey % {len(_EXTENSIONS)} AS INT) + 1] AS ext FROM orders),
classed AS (SELECT *, CASE WHEN ext IN ('m4p', 'py', 'ts') THEN 'skip' WHEN ext = 'zip' THEN 'ignore' ELSE 'index' END AS action,
  CASE WHEN ext IN ('jpg', 'png') THEN CASE WHEN shot THEN 'screenshot' ELSE 'image' END WHEN ext = 'wav' THEN 'audio' WHEN ext = 'mp4' THEN 'video'
       WHEN ext IN ('txt', 'md') THEN 'doc' WHEN ext = 'pdf' THEN 'pdf' END AS kind,
  CASE WHEN ext = 'm4p' THEN 'copy-protected' WHEN ext IN ('py', 'ts') THEN 'code' END AS reason FROM paths)"""


def _classed(spark, sf_dir) -> DataFrame:
    return _paths(spark, sf_dir).withColumn("c", rules.classify(F.col("path"))).select("id", "path", "size", "inode", "c.action", "c.kind", "c.reason")


@query(f"WITH {_PATHS} SELECT id, action, kind, reason FROM classed")
def classify_by_extension(spark, sf_dir):
    return _classed(spark, sf_dir).select("id", "action", "kind", "reason")


@query(f"""WITH {_PATHS} SELECT id, CASE WHEN ext IN ('py', 'txt', 'md', 'ts') THEN 'index' ELSE 'ignore' END AS action FROM paths""")
def classify_code_files(spark, sf_dir):
    return _paths(spark, sf_dir).select("id", rules.classify_code(F.col("path"))["action"].alias("action"))


@query(f"""WITH {_PATHS}, g AS (SELECT regexp_extract(path, '^(.*)/', 1) AS folder, kind, count(*) AS n, avg(CASE WHEN shot THEN 0 ELSE 1 END) AS machine
FROM classed WHERE kind IN ('image', 'audio', 'video') GROUP BY 1, 2) SELECT folder, CAST(sum(n) AS BIGINT) AS n FROM g WHERE n >= 60 AND machine >= 0.7 GROUP BY folder""")
def machine_named_datasets(spark, sf_dir):
    return rules.dataset_folders(_classed(spark, sf_dir), least=60)


@query(f"WITH {_PATHS} SELECT coalesce(reason, action) AS reason, count(*) AS n FROM classed WHERE action <> 'index' GROUP BY 1")
def left_out_by_reason(spark, sf_dir):
    out = _classed(spark, sf_dir).where("action <> 'index'")
    return out.groupBy(F.coalesce("reason", "action").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_PATHS} SELECT id FROM paths WHERE starts_with(path, '/data/c1/') OR starts_with(path, '/data/c3/')")
def prune_prefix(spark, sf_dir):
    return sync.pruned(_paths(spark, sf_dir), ["/data/c1", "/data/c3"]).select("id")


@query(f"WITH {_PATHS} SELECT id, CASE WHEN starts_with(path, '/data/c1/') THEN '/data/c1' ELSE '/data' END AS folder FROM paths")
def searched_as(spark, sf_dir):
    folders = F.array(F.lit("/data"), F.lit("/data/c1"), F.lit("/dat"))
    return _paths(spark, sf_dir).select("id", rules.searched_as(F.col("path"), folders).alias("folder"))


# --- index state and sync ----------------------------------------------------------------------------------------


def _files(spark, sf_dir) -> DataFrame:
    state = F.element_at(F.array(*map(F.lit, ["pending", "done", "partial", "failed"])), (F.col("id") % 4 + 1).cast("int"))
    info = F.create_map(F.lit("read_to"), (F.col("id") % 30).cast("string"), F.lit("read_end"), (F.col("size") % 100).cast("string"))
    return _classed(spark, sf_dir).where("action = 'index'").withColumn("state", state).withColumn("info", info).withColumn("mtime", F.col("size").cast("double"))


_FILES = f"""{_PATHS}, files AS (SELECT *, (['pending','done','partial','failed'])[CAST(id % 4 AS INT) + 1] AS state, id % 30 AS read_to, size % 100 AS read_end
FROM classed WHERE action = 'index')"""


@query(f"WITH {_FILES} SELECT kind, state, count(*) AS n FROM files GROUP BY 1, 2")
def files_by_kind_state(spark, sf_dir):
    return sync.counts(_files(spark, sf_dir))


@query(f"WITH {_FILES} SELECT count(*) AS files, CAST(coalesce(sum(greatest(0, read_end - read_to)), 0) AS BIGINT) AS \"left\" FROM files WHERE state = 'partial'")
def unfinished_sum(spark, sf_dir):
    return sync.unfinished(_files(spark, sf_dir))


@query(f"""WITH {_FILES} SELECT id FROM files WHERE state = 'pending'
ORDER BY list_position(['screenshot','image','pdf','doc','audio','video','code'], kind), size DESC, id LIMIT 100""")
def pending_order(spark, sf_dir):
    return sync.queue(_files(spark, sf_dir), 100).select("id")


@query(f"""WITH {_FILES}, q AS (SELECT id, kind FROM files WHERE state = 'pending'),
n AS (SELECT *, CASE WHEN lag(kind) OVER (ORDER BY id) <> kind THEN 1 ELSE 0 END AS new FROM q), r AS (SELECT *, sum(new) OVER (ORDER BY id) AS run FROM n)
SELECT id, CAST(run AS BIGINT) AS run, (row_number() OVER (PARTITION BY run ORDER BY id) - 1) // 8 AS batch FROM r""")
def kind_batches(spark, sf_dir):
    return sync.batches(_files(spark, sf_dir).where("state = 'pending'"), "id").select("id", "run", "batch")


def _two_crawls(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    p = _paths(spark, sf_dir).withColumn("device", F.lit(1)).withColumn("inode", F.col("id")).withColumn("mtime", F.col("size").cast("double"))
    stored = p.where("id % 10 <> 1")
    moved = F.when(F.col("id") % 10 == 3, F.concat(F.lit("/new"), F.col("path"))).otherwise(F.col("path"))
    crawled = p.where("id % 10 <> 2").withColumn("path", moved).withColumn("size", F.when(F.col("id") % 10 == 4, F.col("size") + 1).otherwise(F.col("size")))
    return stored, crawled


# Paths of screenshots repeat between orders; the fixture takes those that don't.
_TWO = f"""{_PATHS}, one AS (SELECT min(id) AS id, path FROM paths GROUP BY path)
SELECT CASE WHEN id % 10 = 3 THEN '/new' || path ELSE path END AS path,
  CASE id % 10 WHEN 1 THEN 'added' WHEN 2 THEN 'removed' WHEN 3 THEN 'moved' WHEN 4 THEN 'changed' ELSE 'unchanged' END AS change,
  CASE WHEN id % 10 = 3 THEN path END AS old_path FROM one"""


def _unique_crawls(spark, sf_dir):
    keep = _paths(spark, sf_dir).groupBy("path").agg(F.min("id").alias("id")).select("id")
    return tuple(x.join(keep, "id", "left_semi") for x in _two_crawls(spark, sf_dir))


@query(f"WITH {_TWO}")
def sync_full_outer(spark, sf_dir):
    return sync.reconcile(*_unique_crawls(spark, sf_dir))


@query(f"SELECT path, old_path FROM (WITH {_TWO}) WHERE change = 'moved'")
def move_match(spark, sf_dir):
    return sync.reconcile(*_unique_crawls(spark, sf_dir)).where("change = 'moved'").select("path", "old_path")


@query("""SELECT key, coalesce(any_value(b), any_value(a)) AS value FROM (SELECT event_type AS key, 'old' AS a, NULL AS b FROM events
UNION ALL SELECT event_type, NULL, 'new' FROM events WHERE event_type IN ('click', 'view')) GROUP BY key""")
def upsert_meta(spark, sf_dir):
    kinds = table(spark, sf_dir, "events").select(F.col("event_type").alias("key")).distinct()
    meta, new = kinds.withColumn("value", F.lit("old")), kinds.where("key in ('click', 'view')").withColumn("value", F.lit("new"))
    return sync.upserted(meta, new)


# --- evaluation and estimates --------------------------------------------------------------------------------------


def _ranks(spark, sf_dir) -> DataFrame:
    """Orders as queries, their lines as hits by price; the expected line is the first."""
    l = table(spark, sf_dir, "lineitem")
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber"))
    hits = l.select(F.col("l_orderkey").alias("query"), F.col("l_partkey").cast("string").alias("path"), F.col("l_linenumber").alias("loc"), F.lit(None).cast("int").alias("loc_end"), rank.alias("rank"))
    e = l.where("l_linenumber = 1").select(F.col("l_orderkey").alias("query"), F.col("l_returnflag").alias("tag"), F.col("l_partkey").cast("string").alias("path"), F.lit(1).alias("first"), F.lit(1).alias("last"))
    return V.first_ranks(hits, e)


@query("""WITH h AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem),
r AS (SELECT e.l_orderkey, e.l_returnflag AS tag, min(h.rank) AS rank FROM lineitem e JOIN h ON h.l_orderkey = e.l_orderkey AND h.l_partkey = e.l_partkey AND h.l_linenumber = 1 WHERE e.l_linenumber = 1 GROUP BY 1, 2)
SELECT coalesce(tag, 'ALL') AS tag, count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS r1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS r5,
round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS r10, round(avg(CASE WHEN rank <= 10 THEN 1e0 / rank ELSE 0e0 END), 6) AS mrr FROM r GROUP BY ROLLUP (tag)""")
def eval_recall_mrr(spark, sf_dir):
    m = V.metrics(_ranks(spark, sf_dir))
    return m.select("tag", "n", *[SIX(c).alias(c) for c in ("r1", "r5", "r10", "mrr")])


@query("""WITH g AS (SELECT l_orderkey AS query, l_extendedprice >= 0.5 * max(l_extendedprice) OVER (PARTITION BY l_orderkey) AS strong FROM lineitem),
p AS (SELECT query, count(*) AS listed, sum(CASE WHEN strong THEN 1 ELSE 0 END) AS shown FROM g GROUP BY query) SELECT round(avg(listed), 6) AS listed, round(avg(shown), 6) AS shown FROM p""")
def fold_statistics(spark, sf_dir):
    best = F.max("l_extendedprice").over(Window.partitionBy("l_orderkey"))
    hits = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query"), (F.col("l_extendedprice") >= 0.5 * best).alias("strong"))
    return V.fold_metrics(hits).select(SIX("listed").alias("listed"), SIX("shown").alias("shown"))


def _estimated(spark, sf_dir) -> DataFrame:
    return _classed(spark, sf_dir).where("action = 'index'").withColumn("pages", (F.col("id") % 120).cast("long")).withColumn("duration", F.col("size") / 100.0)


@query(f"""WITH {_PATHS}, f AS (SELECT *, id % 120 AS pages, size / 100.0 AS duration FROM classed WHERE action = 'index'),
u AS (SELECT regexp_extract(path, '^(/data/[^/]+)/', 1) AS folder, CASE kind WHEN 'pdf' THEN CASE WHEN pages > 50 THEN 30 ELSE pages END
  WHEN 'doc' THEN least(greatest(1, least(5000, size // 2000)), 40) WHEN 'audio' THEN duration WHEN 'video' THEN duration ELSE 1 END AS first,
  CASE kind WHEN 'pdf' THEN CASE WHEN pages > 50 THEN pages - 30 ELSE 0 END WHEN 'doc' THEN greatest(1, least(5000, size // 2000)) - least(greatest(1, least(5000, size // 2000)), 40) ELSE 0 END AS later,
  CASE kind WHEN 'pdf' THEN 0.09 WHEN 'doc' THEN 0.045 WHEN 'audio' THEN 0.0089 WHEN 'video' THEN 0.019 WHEN 'image' THEN 0.12 ELSE 0.32 END AS cost FROM f)
SELECT folder, count(*) AS files, round(sum(CAST(first AS DOUBLE) * CAST(cost AS DOUBLE)), 4) AS seconds, round(sum(CAST(later AS DOUBLE) * CAST(cost AS DOUBLE)), 4) AS later_seconds,
CAST(sum(CASE WHEN later > 0 THEN 1 ELSE 0 END) AS BIGINT) AS long_files FROM u GROUP BY folder""")
def estimate_by_subfolder(spark, sf_dir):
    files = _estimated(spark, sf_dir).withColumn("folder", E.subfolder(F.col("path"), "/data"))
    e = E.estimated(files, "folder")
    return e.select("folder", "files", F.round("seconds", 4).alias("seconds"), F.round("later_seconds", 4).alias("later_seconds"), "long_files")


def _jobs(spark, sf_dir) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, ["image", "pdfPage", "docChunk"])), (F.col("user_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), name.alias("name"), (F.col("event_id") % 9 + 1).cast("double").alias("units"), F.col("value").alias("seconds"))


@query("""WITH j AS (SELECT (['image','pdfPage','docChunk'])[CAST(user_id % 3 AS INT) + 1] AS name, CAST(event_id % 9 + 1 AS DOUBLE) AS units, value AS seconds FROM events),
t AS (SELECT name, sum(units) AS units, sum(seconds) AS seconds FROM j WHERE seconds > 0 GROUP BY name),
e AS (SELECT seconds, ln(seconds / units / CASE name WHEN 'image' THEN 0.12e0 WHEN 'pdfPage' THEN 0.09e0 ELSE 0.045e0 END) AS r FROM t WHERE units >= 30)
SELECT round(exp(sum(seconds * r) / sum(seconds)), 6) AS pace FROM e""")
def pace_geomean(spark, sf_dir):
    totals = _jobs(spark, sf_dir).where("seconds > 0").groupBy("name").agg(F.sum("units").alias("units"), F.sum("seconds").alias("seconds"))
    return E.pace(totals).select(SIX("pace").alias("pace"))


@query("""WITH RECURSIVE j AS (SELECT (['image','pdfPage','docChunk'])[CAST(user_id % 3 AS INT) + 1] AS name, event_id, CAST(event_id % 9 + 1 AS DOUBLE) AS units, value AS seconds FROM events WHERE value > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY event_id) AS rn FROM j),
f AS (SELECT name, rn, seconds AS s, units AS u FROM o WHERE rn = 1
UNION ALL SELECT o.name, o.rn, CASE WHEN f.u > 10 * lim THEN f.s / 2 ELSE f.s END + o.seconds, CASE WHEN f.u > 10 * lim THEN f.u / 2 ELSE f.u END + o.units
FROM (SELECT *, CASE name WHEN 'image' THEN 20 ELSE 30 END AS lim FROM f) f JOIN o ON o.name = f.name AND o.rn = f.rn + 1)
SELECT name, round(arg_max(s, rn), 4) AS seconds, round(arg_max(u, rn), 4) AS units FROM f GROUP BY name""")
def decayed_tally(spark, sf_dir):
    return E.tallies(_jobs(spark, sf_dir)).select("name", F.round("seconds", 4).alias("seconds"), F.round("units", 4).alias("units"))


# --- time and streams ----------------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT event_id, extract(hour FROM ts) * 60 + extract(minute FROM ts) AS minute FROM events)
SELECT event_id FROM m WHERE minute >= 1320 OR minute < 360""")
def index_hours_filter(spark, sf_dir):
    minute = F.hour("ts") * 60 + F.minute("ts")
    return table(spark, sf_dir, "events").where((minute >= 1320) | (minute < 360)).select("event_id")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT user_id, count(*) AS n, epoch_us(min(ts)) AS start FROM s GROUP BY user_id, run""")
def debounce_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return changes.sessions(e, "user_id", "ts", "10 minutes").select("user_id", "n", F.unix_micros("start").alias("start"))


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return changes.tumbling(e, "ts", "1 hour", "event_type").select(F.unix_micros("start").alias("start"), "event_type", "n")


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def props_json(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long").alias("k")
    return table(spark, sf_dir, "events").groupBy(k).agg(F.count(F.lit(1)).alias("n"))


# --- relational extensions -----------------------------------------------------------------------------------------


@query("""SELECT o_custkey AS key, 'both' AS side FROM orders INTERSECT SELECT c_custkey, 'both' FROM customer
UNION ALL (SELECT c_custkey, 'customers' FROM customer EXCEPT SELECT o_custkey, 'customers' FROM orders)""")
def exact_set_ops(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    return o.intersect(c).withColumn("side", F.lit("both")).union(c.subtract(o).withColumn("side", F.lit("customers")))


@query("""SELECT l_orderkey, l_linenumber, row_number() OVER w AS rn, rank() OVER w AS rk, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 2) AS running
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber)""")
def window_ranks(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    run = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    l = table(spark, sf_dir, "lineitem")
    return l.select("l_orderkey", "l_linenumber", F.row_number().over(w).cast("long").alias("rn"), F.rank().over(w).cast("long").alias("rk"), F.round(F.sum("l_quantity").over(run), 2).alias("running"))


@query("""SELECT n_name, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (n_name, c_mktsegment)""")
def cube_balances(spark, sf_dir):
    j = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.cube("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("""SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""")
def semi_join_counts(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    n = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    finished = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(finished, "c_custkey", "left_semi").join(n, "c_custkey").select("c_custkey", "n")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 40)")
def anti_join_parts(spark, sf_dir):
    big = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").join(big, "p_partkey", "left_anti").select("p_partkey")


@query(r"""WITH d AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents WHERE contains(lower(text), 'erst')),
m AS (SELECT doc_id, w, list_position(list_transform(w, lambda t: regexp_matches(t, '(?i)(^|[^\p{L}\p{M}\p{N}])erst($|[^\p{L}\p{M}\p{N}])')), true) AS pos FROM d),
c AS (SELECT doc_id, w, greatest(0, pos - 1 - 4) AS lo, pos FROM m),
t AS (SELECT doc_id, w, lo, pos, array_to_string(list_transform(w[lo + 1 : lo + 13], lambda t: regexp_replace(t, '(?i)(^|[^\p{L}\p{M}\p{N}])(erst)($|[^\p{L}\p{M}\p{N}])', '\1«\2»\3')), ' ') AS x FROM c)
SELECT doc_id, CASE WHEN pos > 0 THEN CASE WHEN lo > 0 THEN '…' ELSE '' END || x || CASE WHEN lo + 13 < len(w) THEN '…' ELSE '' END END AS snippet FROM t""")
def snippets(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.lower("text").contains("erst"))
    return d.select("doc_id", passages.snippet_of(F.col("text"), ["erst"]).alias("snippet"))


@query("""WITH p AS (SELECT doc_id, doc_id % 4 AS k FROM documents) SELECT doc_id, CASE k WHEN 1 THEN 'glyphOrder' WHEN 3 THEN 'lostLetters' END AS problem FROM p""")
def page_problems(spark, sf_dir):
    """Pages made of documents: with Bengali signs before or after their letters, with Arabic letters lost, and as they are."""
    sign, letter = chr(0x9BF), chr(0x995)
    k = F.col("doc_id") % 4
    more = F.when(k == 1, (sign + letter) * 12).when(k == 2, (letter + sign) * 12).when(k == 3, "\u0627?\u0631 \u0627.\u0628").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", passages.page_problem(F.concat("text", F.lit(" "), more)).alias("problem"))


@query()
def embedded_texts(spark, sf_dir):
    return embedding.embedded(table(spark, sf_dir, "benchmark"), "text").select("item_id", "vec", "error")


@query("SELECT sha256(text) AS digest, count(*) AS n FROM documents GROUP BY 1")
def content_digests(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT event_id, CAST(bit_count(xor(event_id, user_id)) AS INT) AS distance FROM events")
def hamming_distances(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.bit_count(F.col("event_id").bitwiseXOR(F.col("user_id"))).cast("int").alias("distance"))


from sievework import registry_index, registry_more  # noqa: E402, F401  their queries register themselves
