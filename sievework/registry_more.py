"""Further queries over the provided tables: results, folders, media, upkeep, code search, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import results as S
from sievework.functions import text as T
from sievework.operators import folders as D
from sievework.operators import lookup, media, upkeep
from sievework.registry import _FILES, _PATHS, SIX, _files, _paths, query, table

# --- results -------------------------------------------------------------------------------------------------------

_SEGMENTS = ["page", "frame", "audio", "lines", "cells", "chunk", "image", "ocr"]
_KINDS = ["pdf", "video", "audio", "code", "code", "doc", "image", "screenshot"]


def _hits(spark, sf_dir) -> DataFrame:
    """Hits made of lineitem: a segment's kind, place and z by its numbers."""
    l, pick = table(spark, sf_dir, "lineitem"), lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("l_partkey") % 8 + 1).cast("int"))
    loc = F.when(F.col("l_suppkey") % 5 != 0, F.col("l_quantity"))
    end = F.when(F.col("l_suppkey") % 3 != 0, F.col("l_quantity") + F.col("l_linenumber") % 3)
    return l.select("l_orderkey", "l_linenumber", pick(_SEGMENTS).alias("segment"), pick(_KINDS).alias("kind"), loc.cast("double").alias("loc"), end.cast("double").alias("loc_end"), (F.col("l_discount") * 40).cast("double").alias("z"), F.when(F.col("l_tax") > 0.04, F.col("l_linenumber")).alias("keyword_rank"), F.when(F.col("l_quantity") < 0, F.col("l_quantity")).cast("double").alias("focus"))


_HITS = f"""h AS (SELECT l_orderkey, l_linenumber, ({_SEGMENTS!r})[CAST(l_partkey % 8 AS INT) + 1] AS segment, ({_KINDS!r})[CAST(l_partkey % 8 AS INT) + 1] AS kind,
CASE WHEN l_suppkey % 5 <> 0 THEN CAST(l_quantity AS BIGINT) END AS a, CASE WHEN l_suppkey % 3 <> 0 THEN CAST(l_quantity AS BIGINT) + l_linenumber % 3 END AS z0,
l_discount * 40 AS z, CASE WHEN l_tax > 0.04 THEN l_linenumber END AS rank FROM lineitem),
c AS (SELECT *, coalesce(z0, a) AS b, CAST(a // 60 AS VARCHAR) || ':' || lpad(CAST(a % 60 AS VARCHAR), 2, '0') AS clock FROM h),
k AS (SELECT *, CASE segment WHEN 'cells' THEN 'cell' ELSE 'line' END || CASE WHEN a = b THEN ' ' || a ELSE 's ' || a || '–' || b END AS span FROM c)"""


@query(f"""WITH {_HITS} SELECT l_orderkey, l_linenumber, CASE segment WHEN 'page' THEN 'p. ' || a WHEN 'frame' THEN clock WHEN 'audio' THEN clock
WHEN 'lines' THEN 'L' || CASE WHEN a = b THEN '' || a ELSE a || '–' || b END WHEN 'cells' THEN span END AS place FROM k""")
def place_badges(spark, sf_dir):
    return _hits(spark, sf_dir).select("l_orderkey", "l_linenumber", S.place(*map(F.col, ("kind", "segment", "loc", "loc_end"))).alias("place"))


@query(f"""WITH {_HITS} SELECT l_orderkey, l_linenumber, CASE WHEN segment = 'ocr' THEN 'text in image' ELSE coalesce(CASE segment WHEN 'page' THEN 'p. ' || a
WHEN 'frame' THEN 'at ' || clock WHEN 'audio' THEN 'at ' || clock || ' (sound)' WHEN 'chunk' THEN 'part ' || a WHEN 'lines' THEN 'lines ' || a || '–' || b
WHEN 'cells' THEN CASE WHEN a = z0 THEN 'cell ' || a ELSE 'cells ' || a || '–' || b END END, '') END AS location FROM k""")
def hit_locations(spark, sf_dir):
    return _hits(spark, sf_dir).select("l_orderkey", "l_linenumber", S.location(*map(F.col, ("segment", "loc", "loc_end", "focus"))).alias("location"))


@query(f"""WITH {_HITS} SELECT l_orderkey, l_linenumber, CASE WHEN z < 2 THEN CASE WHEN rank IS NULL THEN 'Matches its name' ELSE 'Has your words' END ELSE
CASE segment WHEN 'image' THEN 'Matches the picture' WHEN 'ocr' THEN 'Matches the text in it' WHEN 'frame' THEN 'Matches the frame at ' || coalesce(clock, '')
WHEN 'audio' THEN 'Matches what''s heard at ' || coalesce(clock, '') WHEN 'page' THEN 'Matches the text on ' || coalesce('page ' || a, 'a page')
WHEN 'chunk' THEN 'Matches its text' ELSE 'Matches ' || coalesce(span, 'the code') END END AS reason FROM k""")
def hit_reasons(spark, sf_dir):
    return _hits(spark, sf_dir).select("l_orderkey", "l_linenumber", S.reason(*map(F.col, ("kind", "segment", "loc", "loc_end", "z", "keyword_rank"))).alias("reason"))


@query(f"""WITH {_HITS} SELECT l_orderkey, l_linenumber, CASE WHEN kind = 'pdf' AND a > 1 THEN a END AS page,
CASE WHEN kind IN ('video', 'audio') AND a >= 1 THEN CAST(a AS DOUBLE) END AS seconds,
CASE WHEN kind = 'code' THEN CASE WHEN segment = 'lines' THEN greatest(1, coalesce(a, 1)) ELSE 1 END END AS line FROM k""")
def opening_places(spark, sf_dir):
    at = S.opens_at(*map(F.col, ("kind", "segment", "loc", "focus"))).alias("o")
    return _hits(spark, sf_dir).select("l_orderkey", "l_linenumber", at).select("l_orderkey", "l_linenumber", "o.page", "o.seconds", "o.line")


@query(f"""WITH {_HITS}, g AS (SELECT CASE WHEN kind IN ('pdf', 'doc') THEN 'Documents' WHEN kind = 'image' THEN 'Images' WHEN kind = 'screenshot' THEN 'Screenshots'
WHEN kind = 'video' THEN 'Video' WHEN kind = 'audio' THEN 'Audio' ELSE 'Code' END AS title, count(*) AS n FROM k GROUP BY 1) SELECT title, n FROM g""")
def kind_groups(spark, sf_dir):
    return _hits(spark, sf_dir).groupBy(S.group_of(F.col("kind")).alias("title")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH v AS (SELECT o_orderkey AS id, CAST(floor(o_totalprice * o_totalprice / 7) AS BIGINT) * CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 0 END + o_custkey % 1500 AS n FROM orders)
SELECT id, CASE WHEN n < 1000 THEN n || ' bytes' WHEN n < 1000000 THEN CAST(floor(n / 1e3 + 0.5) AS BIGINT) || ' KB'
WHEN n < 1000000000 THEN CASE WHEN n / 1e6 >= 10 THEN '' || CAST(floor(n / 1e6 + 0.5) AS BIGINT) ELSE printf('%.1f', n / 1e6) END || ' MB'
WHEN n < 1000000000000 THEN CASE WHEN n / 1e9 >= 10 THEN '' || CAST(floor(n / 1e9 + 0.5) AS BIGINT) ELSE printf('%.1f', n / 1e9) END || ' GB'
ELSE CASE WHEN n / 1e12 >= 10 THEN '' || CAST(floor(n / 1e12 + 0.5) AS BIGINT) ELSE printf('%.1f', n / 1e12) END || ' TB' END AS size FROM v""")
def byte_sizes(spark, sf_dir):
    factor = F.when(F.col("o_orderkey") % 3 == 0, 1).when(F.col("o_orderkey") % 3 == 1, 1000).otherwise(0)
    n = F.floor(F.col("o_totalprice") * F.col("o_totalprice") / 7).cast("long") * factor + F.col("o_custkey") % 1500
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), S.byte_size(n).alias("size"))


@query("""SELECT event_id, CASE WHEN v < 90 THEN CAST(floor(v + 0.5) AS BIGINT) || ' s' WHEN v < 5400 THEN CAST(floor(v / 60 + 0.5) AS BIGINT) || ' min' ELSE printf('%.1f h', floor(v / 360 + 0.5) / 10) END AS shown
FROM (SELECT event_id, value * (event_id % 200) AS v FROM events)""")
def durations(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.duration(F.col("value") * (F.col("event_id") % 200)).alias("shown"))


_SLICE = "substr(text, s + 1, 900)"


@query(f"""WITH f AS (SELECT doc_id, text, least(nullif(instr(lower(text), 'erst'), 0), nullif(instr(lower(text), 'ouche'), 0)) AS e, greatest(instr(lower(text), 'erst'), instr(lower(text), 'ouche')) AS g FROM documents),
p AS (SELECT doc_id, text, coalesce(e, CASE WHEN g > 0 THEN g END) - 1 AS first FROM f),
q AS (SELECT doc_id, text, CASE WHEN first > 200 THEN first - 160 + length(regexp_extract(substr(text, first - 159, 160), '^(\\S*)', 1)) ELSE 0 END AS s FROM p)
SELECT doc_id, CASE WHEN s > 0 THEN '…' ELSE '' END || {_SLICE} || CASE WHEN length(text) - s > 900 THEN '…' ELSE '' END AS passage FROM q""")
def passages_around(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", S.passage_around(F.col("text"), F.array(F.lit("erst"), F.lit("ouche"))).alias("passage"))


@query(f"WITH {_PATHS} SELECT id, CASE ext WHEN 'py' THEN 'Python' WHEN 'md' THEN 'Markdown' WHEN 'txt' THEN 'Text' WHEN 'ts' THEN 'TypeScript' ELSE upper(ext) END AS language FROM paths")
def languages(spark, sf_dir):
    return _paths(spark, sf_dir).select("id", S.language_of(F.col("path")).alias("language"))


@query(r"""WITH w AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda w: length(w) > 1)) AS w FROM benchmark)
SELECT item_id, unnest(list_filter(w, lambda x: NOT list_contains(['""" + "','".join(T.STOPWORDS) + """'], x))) AS word FROM w""")
def marked_query_words(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(S.marked_words(F.col("text"))).alias("word"))


# --- folders -------------------------------------------------------------------------------------------------------


@query(f"""WITH {_PATHS}, x AS (SELECT id, replace(replace(path, '/data/c2/', '/data/c2/old/'), '/data/c3/', '/data/c3/.git/') AS path FROM paths)
SELECT id, starts_with(path, '/data/c1/') OR starts_with(path, '/data/c4/') AS searched FROM x""")
def searched_paths(spark, sf_dir):
    path = F.replace(F.replace("path", F.lit("/data/c2/"), F.lit("/data/c2/old/")), F.lit("/data/c3/"), F.lit("/data/c3/.git/"))
    return _paths(spark, sf_dir).select("id", D.is_searched(path, ["/data/c1", "/data/c2", "/data/c3", "/data/c4"], ["/data/c2/old", "/data/c4/cli"]).alias("searched"))


@query(f"WITH {_PATHS}, t AS (SELECT * FROM paths ORDER BY size DESC, id LIMIT 200) SELECT id FROM t WHERE (starts_with(path, '/data/c1/') OR starts_with(path, '/data/c3/')) AND ext NOT IN ('pdf', 'zip') AND path IN (SELECT path FROM paths WHERE id % 10 <> 3)")
def hits_after_limit(spark, sf_dir):
    p = _paths(spark, sf_dir)
    return D.post_filter(p.orderBy(F.desc("size"), "id").limit(200), ["/data/c1", "/data/c3"], types=["pdf", "zip"], present=p.where("id % 10 <> 3").select("path")).select("id")


@query(f"WITH {_PATHS}, classed2 AS (SELECT * FROM classed) SELECT id, action = 'index' AS matters FROM classed2")
def changes_that_matter(spark, sf_dir):
    return _paths(spark, sf_dir).select("id", D.change_may_matter(F.col("path"), F.lit(False)).alias("matters"))


@query(f"""WITH {_PATHS}, r AS (SELECT unnest(['/data/c1', '/data/c2', '/data']) AS folder),
o AS (SELECT id, path, arg_max(folder, length(folder)) AS repo FROM paths LEFT JOIN r ON starts_with(path, folder || '/') GROUP BY id, path)
SELECT id, repo FROM o""")
def nearest_repos(spark, sf_dir):
    repos = spark.createDataFrame([("/data/c1",), ("/data/c2",), ("/data",)], "folder string")
    return D.nearest_repo(_paths(spark, sf_dir).select("id", "path").dropDuplicates(["id"]), repos).select("id", "repo").distinct()


@query(f"WITH {_PATHS} SELECT DISTINCT id FROM paths WHERE NOT starts_with(path, '/data/c1/') OR path IN (SELECT path FROM paths WHERE id % 2 = 0 AND starts_with(path, '/data/c1/'))")
def git_kept_files(spark, sf_dir):
    p = _paths(spark, sf_dir).select("id", "path")
    repos = spark.createDataFrame([("/data/c1",), ("/data/c2",)], "folder string")
    listed = p.where("id % 2 = 0 and path like '/data/c1/%'").select(F.lit("/data/c1").alias("repo"), F.substring("path", 10, 1000).alias("relative"))
    return D.git_kept(p, repos, listed).select("id").distinct()


@query(f"""WITH {_PATHS} SELECT path, max(CASE WHEN starts_with(path, '/data/c1/') THEN '/data/c1' END) AS repo, max(substr(path, 7)) AS title FROM paths GROUP BY path""")
def code_titles(spark, sf_dir):
    return D.code_place(_paths(spark, sf_dir).select("path").distinct(), spark.createDataFrame([("/data/c1",)], "folder string")).select("path", "repo", "title")


@query(f"WITH {_PATHS} SELECT id, CASE WHEN size > CASE WHEN ext = 'py' THEN 150000 ELSE 150000 END THEN 'big' END AS reason FROM paths")
def size_gates(spark, sf_dir):
    gate = D.code_size_gate(F.col("path"), F.col("size") * F.lit(D.CODE_BYTES / 150000.0))
    return _paths(spark, sf_dir).select("id", F.when(gate.isNotNull(), "big").alias("reason"))


@query("""WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '// DO NOT EDIT' || chr(10) ELSE '' END || CASE doc_id % 5 WHEN 0 THEN '-----BEGIN PRIVATE KEY-----' ELSE '' END || text AS x FROM documents),
m AS (SELECT doc_id, x, greatest(1, length(x) - length(replace(x, chr(10), '')) + CASE WHEN NOT ends_with(x, chr(10)) THEN 1 ELSE 0 END) AS lines FROM t)
SELECT doc_id, CASE WHEN contains(x, 'PRIVATE KEY-----') THEN 'holds a private key' WHEN contains(substr(x, 1, 1000), 'DO NOT EDIT') THEN 'made by a program (“DO NOT EDIT”)'
WHEN length(x) // lines > 300 AND len(list_filter(string_split(x, chr(10)), lambda l: length(l) > 3000)) > 0 THEN 'minified (' || length(x) // lines || ' characters a line)' END AS reason FROM m""")
def code_text_gates(spark, sf_dir):
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    text = F.concat(F.when(i % 4 == 0, "// DO NOT EDIT\n").otherwise(""), F.when(i % 5 == 0, "-----BEGIN PRIVATE KEY-----").otherwise(""), F.col("text"))
    return d.select("doc_id", D.code_text_gate(text, F.lit(True)).alias("reason"))


# --- media ---------------------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(round(x * 3000) AS BIGINT)) AS v FROM embeddings)
SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: (x / 32768e0) * (x / 32768e0))) / len(v)), 6) AS rms,
sqrt(list_sum(list_transform(v, lambda x: (x / 32768e0) * (x / 32768e0))) / len(v)) > 0.003 AS audible FROM s""")
def sound_levels(spark, sf_dir):
    samples = F.transform("embedding", lambda x: F.round(x.cast("double") * 3000).cast("long"))
    return table(spark, sf_dir, "embeddings").select("vec_id", SIX(media.rms(samples)).alias("rms"), media.audible(samples).alias("audible"))


@query("""WITH d AS (SELECT o_orderkey AS id, o_custkey % 4000 AS h, o_orderkey % 5000 AS w FROM orders), s AS (SELECT *, sqrt(140 * 2304e0 / (h * w)) AS f FROM d WHERE h > 0 AND w > 0),
t AS (SELECT *, CAST(floor(f * h / 48) AS BIGINT) * 48 AS th, CAST(floor(f * w / 48) AS BIGINT) * 48 AS tw FROM s)
SELECT d.id, CASE WHEN th = 0 AND tw = 0 THEN NULL WHEN th = 0 THEN 48 WHEN tw = 0 THEN least(t.h // t.w * 48, 140 * 48) ELSE th END AS height,
CASE WHEN th = 0 AND tw = 0 THEN NULL WHEN th = 0 THEN least(t.w // t.h * 48, 140 * 48) WHEN tw = 0 THEN 48 ELSE tw END AS width FROM d LEFT JOIN t ON t.id = d.id""")
def picture_sizes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 4000).alias("h"), (F.col("o_orderkey") % 5000).alias("w"))
    return o.select("id", media.target_size(F.col("h"), F.col("w"), F.lit(140)).alias("t")).select("id", "t.height", "t.width")


@query("""WITH p AS (SELECT doc_id, regexp_replace(CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 150) ELSE text END, '^\\s+|\\s+$', '', 'g') AS body FROM documents)
SELECT doc_id, CASE WHEN length(body) >= 200 THEN 'page' ELSE 'page_image' END AS "as", body FROM p""")
def page_readings(spark, sf_dir):
    text = F.when(F.col("doc_id") % 3 == 0, F.substring("text", 1, 150)).otherwise(F.col("text"))
    return media.page_parts(table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))).select("doc_id", "as", "body")


@query("""WITH s AS (SELECT user_id, event_id, avg(value) OVER w AS average, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT event_id, round(CASE WHEN n = 3 THEN average END, 6) AS average, coalesce(n = 3 AND average < 40.5, false) AS quiet FROM s""")
def quiet_samples(spark, sf_dir):
    load = media.quiet_at(table(spark, sf_dir, "events"), "user_id", "event_id", "value", 800)
    return load.select("event_id", SIX("average").alias("average"), "quiet")


@query("""WITH b AS (SELECT user_id, min(value) AS best FROM events WHERE value > 0 GROUP BY user_id)
SELECT user_id, round(best, 6) AS best, sum(CASE WHEN value <= best * 1.15 THEN 1 ELSE 0 END) >= 2 AS steady FROM events JOIN b USING (user_id) WHERE value > 0 GROUP BY user_id, best""")
def best_of_tries(spark, sf_dir):
    return media.best_tries(table(spark, sf_dir, "events").where("value > 0"), "user_id", "value").select("user_id", SIX("best").alias("best"), "steady")


@query("""WITH p AS (SELECT a.vec_id % 3 AS i, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) AS c
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id IN (0, 10, 20)) SELECT round(min(c), 5) AS least FROM p""")
def vector_agreement(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    one = e.where("vec_id in (0, 10, 20)").select(F.col("vec_id").cast("string").alias("input"), F.col("embedding").alias("vec"))
    other = e.where("vec_id in (1, 11, 21)").select((F.col("vec_id") - 1).cast("string").alias("input"), F.col("embedding").alias("vec"))
    return media.agreement(one, other, ["0", "10", "20"]).select(F.round("least", 5).alias("least"))


@query("SELECT vec_id, list_bool_and(list_transform(embedding, lambda x: abs(x) < 2)) AS close FROM embeddings")
def half_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("back", media.from_half(media.half_bytes(F.col("embedding"))))
    near = F.forall(F.zip_with("embedding", "back", lambda a, b: F.abs(a - b) <= 0.001), lambda x: x)
    return e.select("vec_id", near.alias("close"))


@query("SELECT event_id, CAST(sum(event_id % 9) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS read_to FROM events")
def cumulative_pages(spark, sf_dir):
    jobs = table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), "event_id", (F.col("event_id") % 9).alias("pages"))
    return media.cumulative_pages(jobs, "event_id", "pages").select("event_id", "read_to")


@query("SELECT event_id, CAST(max(event_id % 50 + user_id % 30) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS total FROM events")
def pass_totals(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") % 50).alias("done"), (F.col("user_id") % 30).alias("pending"))
    return media.pass_progress(e, "user_id", "event_id").select("event_id", F.col("total").cast("long").alias("total"))


# --- upkeep --------------------------------------------------------------------------------------------------------


@query(f"""WITH {_FILES} SELECT count(*) AS files, CAST(sum(CASE WHEN state IN ('done', 'partial') THEN 1 ELSE 0 END) AS BIGINT) AS searchable,
CAST(sum(CASE WHEN state = 'pending' THEN 1 ELSE 0 END) AS BIGINT) AS pending, CAST(sum(CASE WHEN state = 'partial' THEN 1 ELSE 0 END) AS BIGINT) AS unfinished FROM files""")
def status_totals(spark, sf_dir):
    return upkeep.status(_files(spark, sf_dir))


@query(f"""WITH {_FILES}, r AS (SELECT unnest(['/data/c1', '/data/c2', '/data']) AS root)
SELECT root, count(*) AS files, CAST(sum(CASE WHEN state IN ('done', 'partial') THEN 1 ELSE 0 END) AS BIGINT) AS indexed, CAST(sum(CASE WHEN state = 'failed' THEN 1 ELSE 0 END) AS BIGINT) AS failed,
CAST(sum(CASE WHEN kind = 'pdf' THEN 1 ELSE 0 END) AS BIGINT) AS pdfs FROM files JOIN r ON starts_with(path, root || '/') GROUP BY root""")
def root_summaries(spark, sf_dir):
    files = _files(spark, sf_dir).withColumn("detail", F.lit(None).cast("string"))
    s = upkeep.root_summaries(files, ["/data/c1", "/data/c2", "/data"])
    return s.select("root", "files", "indexed", "failed", F.col("kinds")["pdf"].alias("pdfs"))


@query(f"""WITH {_FILES} SELECT id FROM files WHERE state = 'partial' ORDER BY list_position(['screenshot','image','pdf','doc','audio','video','code'], kind), size DESC, id LIMIT 60""")
def unfinished_order(spark, sf_dir):
    return upkeep.unfinished(_files(spark, sf_dir)).limit(60).select("id")


@query("SELECT l_orderkey AS file, CAST(max(CAST(l_quantity AS BIGINT)) AS BIGINT) AS last FROM lineitem WHERE l_partkey % 8 IN (0, 5) GROUP BY 1")
def last_places(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_quantity").cast("double").alias("loc"), F.element_at(F.array(*map(F.lit, _SEGMENTS)), (F.col("l_partkey") % 8 + 1).cast("int")).alias("kind"))
    return upkeep.last_places(rows)


@query(f"""WITH {_FILES} SELECT id, CAST(read_to AS BIGINT) AS start, CAST(least(read_to + CASE kind WHEN 'pdf' THEN 30 ELSE 40 END, read_end) AS BIGINT) AS "end",
read_to + CASE kind WHEN 'pdf' THEN 30 ELSE 40 END >= read_end AS last_step FROM files WHERE state = 'partial'""")
def next_steps(spark, sf_dir):
    none = spark.createDataFrame([], "file long, kind string, loc double")
    return upkeep.next_steps(_files(spark, sf_dir), none)


@query(f"""WITH {_FILES} SELECT id, CASE WHEN state = 'partial' AND greatest(read_to, least(read_to + 50, read_end)) >= read_end THEN 'done' ELSE state END AS state FROM files""")
def resumed_steps(spark, sf_dir):
    files = _files(spark, sf_dir)
    read_to, read_end = F.col("info")["read_to"].cast("long"), F.col("info")["read_end"].cast("long")
    done = files.where("state = 'partial'").select("id", F.least(read_to + 50, read_end).alias("end"))
    # The same steps twice, as after an interrupted run.
    return upkeep.stepped(upkeep.stepped(files, done), done).select("id", "state")


@query(f"""WITH {_FILES}, w AS (SELECT DISTINCT path FROM files WHERE id % 100 = 7) SELECT id, CASE WHEN w.path IS NULL THEN state WHEN state = 'partial' THEN 'done' ELSE 'failed' END AS state,
CASE WHEN w.path IS NULL THEN NULL WHEN state = 'partial' THEN 'The rest couldn''t be read: it took too long' ELSE 'It took too long' END AS detail FROM files LEFT JOIN w ON w.path = files.path""")
def stopped_files(spark, sf_dir):
    files = _files(spark, sf_dir).withColumn("detail", F.lit(None).cast("string"))
    tasks = files.where("id % 100 = 7").select("path", F.lit(1).alias("memory"), F.lit(99.0).alias("seconds"))
    return upkeep.stop_reading(files, upkeep.over_limits(tasks, 10, 60.0)).select("id", "state", "detail")


@query("""SELECT name, round(CASE WHEN u > 200 THEN u / 2 ELSE u END + 5, 4) AS units, round(CASE WHEN u > 200 THEN s / 2 ELSE s END + 2.5, 4) AS seconds
FROM (SELECT event_type AS name, CAST(count(*) AS DOUBLE) AS u, sum(value) AS s FROM events GROUP BY 1)""")
def merged_costs(spark, sf_dir):
    saved = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("units"), F.sum("value").alias("seconds"))
    new = saved.select("name", F.lit(5.0).alias("units"), F.lit(2.5).alias("seconds"))
    m = upkeep.merged_costs(saved, new, {"none": 20.0})
    return m.select("name", F.round("units", 4).alias("units"), F.round("seconds", 4).alias("seconds"))


@query("""SELECT to_json({'event': event_type, 'id': event_id}) AS value FROM events""")
def event_lines(spark, sf_dir):
    return upkeep.as_lines(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("event")))


@query("""SELECT folder, round(seconds, 2) AS seconds FROM (SELECT '/c/' || o_custkey AS folder, sum(o_totalprice) AS seconds FROM orders GROUP BY 1) ORDER BY seconds DESC, folder LIMIT 500""")
def largest_subfolders(spark, sf_dir):
    e = table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("/c/"), F.col("o_custkey").cast("string")).alias("folder")).agg(F.sum("o_totalprice").alias("seconds"))
    return upkeep.largest_subfolders(e, "/c").select("folder", F.round("seconds", 2).alias("seconds"))


@query("SELECT count(*) AS segments, CAST(sum(CASE WHEN vec_id % 4 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS vectors FROM embeddings WHERE vec_id % 5 <> 0")
def segment_counts(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(F.when(F.col("vec_id") % 5 == 0, "name").otherwise("chunk").alias("kind"), F.when(F.col("vec_id") % 4 != 0, F.col("embedding")).alias("vec"))
    return upkeep.segment_counts(rows)


# --- code search ---------------------------------------------------------------------------------------------------


@query(r"""WITH s AS (SELECT doc_id // 4 AS file, doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'x = read_all(1)' || chr(10) WHEN 1 THEN 'def read_all(path):' || chr(10) ELSE 'int read_all(char *p);' || chr(10) END AS line FROM documents),
r AS (SELECT *, CASE WHEN starts_with(line, 'def') THEN 2 WHEN starts_with(line, 'int') THEN 1 ELSE 0 END AS strength FROM s),
b AS (SELECT file, max(strength) AS strength FROM r GROUP BY file HAVING max(strength) > 0)
SELECT b.file, min(r.id) AS id, b.strength FROM b JOIN r ON r.file = b.file AND r.strength = b.strength GROUP BY b.file, b.strength""")
def code_definitions(spark, sf_dir):
    i = F.col("doc_id")
    line = F.when(i % 3 == 0, "x = read_all(1)\n").when(i % 3 == 1, "def read_all(path):\n").otherwise("int read_all(char *p);\n")
    rows = table(spark, sf_dir, "documents").select(F.floor(i / 4).alias("file"), i.alias("id"), i.cast("double").alias("loc"), line.alias("text"))
    return lookup.definitions(rows, "read_all").select("file", "id", "strength")


# --- relational forms ----------------------------------------------------------------------------------------------


@query("""SELECT e.event_id, (SELECT max(o.event_id) FROM events o WHERE o.user_id = e.user_id AND o.event_type = 'purchase' AND o.ts <= e.ts) AS last_purchase FROM events e WHERE e.event_type = 'error'""")
def as_of_purchase(spark, sf_dir):
    """As-of: the last purchase of the user at each error, by a union and a window."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max(F.when(F.col("event_type") == "purchase", F.col("event_id"))).over(w)
    return e.withColumn("last_purchase", last).where("event_type = 'error'").select("event_id", "last_purchase")

