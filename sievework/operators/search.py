"""The fused search over files, segments and the keyword index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.text import KIND_WORDS, query_terms

from . import postings as P
from . import ranking as R
from .keyword_index import KeywordIndex, idf
from .keyword_index import score as word_score
from .vectors import FOUND, VectorIndex

MARKED = 400


def hinted_kinds(query: str) -> list[str]:
    """Kinds that a query's words ask for; a Bengali or Arabic kind word also at the start of a longer word."""
    asked = set(query.lower().split())
    longer = lambda name: ord(name[0]) > 0x5FF and len(name) >= 3 and any(w.startswith(name) for w in asked)
    return [kind for kind, names in KIND_WORDS.items() if asked & set(names.split()) or any(map(longer, names.split()))]


def lookup(terms: list[str]) -> bool:
    code = lambda t: any(c.isdigit() for c in t) and (any(c.isalpha() for c in t) or len(t) >= 4)
    return bool(terms) and all(map(code, terms))


def word_files(index: KeywordIndex, terms: list[str], kinds: DataFrame | None = None, typing: bool = False, widen: bool = True, phrase: list[str] | None = None) -> DataFrame:
    """file, coverage, keyword_rank, keyword_segment. The limit on rows comes before the kinds (file), the files last."""
    prefixes = index.prefixes(terms, typing, widen)
    found = index.matched(terms, prefixes)
    if phrase:
        found = found.join(index.phrase(phrase).select("rowid"), "rowid", "left_semi")
        best = index.bm25(found).orderBy("bm25", "rowid").limit(P.ROWS)
    else:
        best = index.top(terms, P.ROWS, prefixes)
    if kinds is not None:
        best = best.join(kinds.select("file"), "file", "left_semi")
    files = P.keyword_files(best)
    # At most FILES rows.
    ranked = files.withColumn("keyword_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("bm25", "rowid")))
    cover = index.coverage(found, files, len(terms))
    return cover.join(F.broadcast(ranked.select("file", "keyword_rank", F.col("rowid").alias("keyword_segment"))), "file")


def search(segments: DataFrame | None, query_vector: DataFrame | None, index: KeywordIndex | None, query: str, kinds: list[str] | None = None, limit: int = 20, word_weight: float = R.WORD_WEIGHT, widen: bool = True, typing: bool = False, phrase: list[str] | None = None, vectors: VectorIndex | None = None) -> DataFrame:
    """file, score, z, cosine, segment, coverage, keyword_rank, keyword_segment of the best files.

    segments: id, file, kind, modality, sets_scale, vec. Without a vector it is keyword search, without terms or index
    vector search. phrase: words that must stand side by side (a name in code). With a vector index its blocks are read in
    place of the segments' vectors, and only those that can hold an answer."""
    spark = segments.sparkSession if segments is not None else index.spark
    terms = query_terms(query)
    best = spark.createDataFrame([], "file long, segment long, z double, cosine double, kind string")
    if query_vector is not None and vectors is None:
        best = R.best_per_file(R.with_meaning(R.cosines(segments, query_vector)), kinds)
    cover = spark.createDataFrame([], "file long, coverage double, keyword_rank int, keyword_segment long")
    if terms and index is not None:
        allowed = segments.where(F.col("kind").isin(kinds)).select("file").distinct() if kinds is not None and segments is not None else None
        cover = word_files(index, terms, allowed, typing, widen, phrase)
    if query_vector is not None and vectors is not None:
        row = query_vector.select("q").first()
        # At most FILES rows.
        found = cover.collect()
        cover = spark.createDataFrame(found, cover.schema)
        best = spark.createDataFrame(_meant(vectors, list(row["q"]), [r["file"] for r in found], kinds, hinted_kinds(query), 0.5 if lookup(terms) else 1.0, limit) if row else [], FOUND)
    return R.with_strength(R.top(R.fused(best, cover, lookup(terms), hinted_kinds(query), word_weight), limit))


def _meant(vectors: VectorIndex, q: list[float], files: list[int], kinds: list[str] | None, hinted: list[str], weight: float, limit: int) -> list[tuple]:
    """The files that meaning alone brings among the first, and what it says of those that words have found."""
    scale = vectors.scale(q)
    if scale is None:
        return []
    found = vectors.best_files(q, scale, limit, kinds, hinted, weight, R.Z_GATE)
    found += [r for r in vectors.of_files(files, q, scale, kinds) if r[0] not in {f[0] for f in found}]
    return found


def pointed(hits: DataFrame) -> DataFrame:
    """hits with `points_at`: the meaning's segment where it stands out or no word was found, else the words' segment."""
    meant = F.col("segment").isNotNull() & ((F.coalesce("z", F.lit(0.0)) >= R.Z_GATE) | F.col("keyword_rank").isNull())
    return hits.withColumn("points_at", F.when(meant, F.col("segment")).otherwise(F.col("keyword_segment")))


def with_excerpts(hits: DataFrame, segments: DataFrame, snippets: DataFrame) -> DataFrame:
    """`pointed` hits with `excerpt`. segments: id, kind, loc, excerpt; snippets: id, snippet (words between « »).

    Marked words are quoted only from the segment that is pointed at. A segment with no place and no text of its own may
    borrow them from its file's other segment, unless that is the name; else its stored excerpt stands."""
    at = segments.select(F.col("id").alias("points_at"), F.col("kind").alias("segment_kind"), "loc", F.col("excerpt").alias("stored"))
    words = segments.select(F.col("id").alias("keyword_segment"), F.col("kind").alias("word_kind")).join(snippets.select(F.col("id").alias("keyword_segment"), "snippet"), "keyword_segment")
    rows = hits.join(at, "points_at", "left").join(words, "keyword_segment", "left")
    quoted = F.when(F.col("snippet").contains("«"), F.substring("snippet", 1, MARKED))
    own = F.when(F.col("keyword_segment") == F.col("points_at"), quoted)
    borrowed = F.when(F.col("stored").isNull() & F.col("loc").isNull() & (F.col("word_kind") != "name"), quoted)
    return rows.withColumn("excerpt", F.coalesce(own, borrowed, F.col("stored"))).drop("stored", "snippet", "word_kind")


ASKED = "query string, term int, token string, prefix boolean, terms int"


def _asked(index: KeywordIndex, queries: list[str], widen: bool) -> list[tuple[str, int, str, bool, int]]:
    out = []
    for query in queries:
        terms = query_terms(query)
        flags = index.prefixes(terms, widen=widen) if terms else []
        out += [(query, i, token, flag, len(terms)) for i, (token, flag) in enumerate(zip(index.tokens(terms), flags, strict=True)) if token]
    return out


def _words_of_many(index: KeywordIndex, queries: list[str], widen: bool) -> DataFrame:
    """query, file, coverage, keyword_rank of all queries, from one pass over their tokens' postings."""
    asked = _asked(index, queries, widen)
    kind = "query string, file long, coverage double, keyword_rank int"
    if not asked:
        return index.spark.createDataFrame([], kind)
    exact, prefixes = sorted({a[2] for a in asked if not a[3]}), sorted({a[2] for a in asked if a[3]})
    wanted = F.col("token").isin(exact)
    for p in prefixes:
        wanted = wanted | F.col("token").startswith(p)
    rows, words = index.postings.where(wanted).withColumnRenamed("token", "own"), F.broadcast(index.spark.createDataFrame(asked, ASKED))
    whole = rows.join(words.where("not prefix"), F.col("own") == F.col("token"))
    begun = rows.join(words.where("prefix"), F.col("own").startswith(F.col("token")))
    found = whole.unionByName(begun).groupBy("query", "term", "terms", "rowid", "file").agg(F.sum("names").alias("names"), F.sum("bodies").alias("bodies"), F.first("length").alias("length"))
    df = found.groupBy("query", "term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    both, (total, mean) = found.join(df, ["query", "term"]), index.figures
    score = word_score(P.NAME_WEIGHT * F.col("names") + P.BODY_WEIGHT * F.col("bodies"), F.col("length"), idf(F.col("df"), total), mean)
    order = Window.partitionBy("query").orderBy("bm25", "rowid")
    best = both.groupBy("query", "rowid", "file").agg((-F.sum(score)).alias("bm25")).withColumn("at", F.row_number().over(order)).where(F.col("at") <= P.ROWS)
    files = best.groupBy("query", "file").agg(F.min(F.struct("bm25", "rowid")).alias("b")).select("query", "file", "b.bm25", "b.rowid")
    files = files.withColumn("keyword_rank", F.row_number().over(order)).where(F.col("keyword_rank") <= P.FILES)
    held = found.join(files.select("query", "file", "keyword_rank"), ["query", "file"])
    return held.groupBy("query", "file", "keyword_rank").agg((F.countDistinct("term") / F.first("terms").cast("double")).alias("coverage")).select("query", "file", "coverage", "keyword_rank")


def search_many(segments: DataFrame, vectors: dict[str, list[float] | None], index: KeywordIndex, limit: int = 10, word_weight: float = R.WORD_WEIGHT, widen: bool = True) -> DataFrame:
    """query, file, score, z, coverage, rank of the best files of many queries (query to its vector, or none), each on a
    scale of its own, in one plan: an evaluation's queries are a small table."""
    spark, queries = segments.sparkSession, list(vectors)
    asked = [(q, v) for q, v in vectors.items() if v is not None]
    q = F.broadcast(spark.createDataFrame(asked, "query string, q array<float>"))
    scored = segments.crossJoin(q).withColumn("cosine", R.dot(F.col("vec"), F.col("q"))).drop("q", "vec")
    setting = scored.where("sets_scale")
    overall = setting.groupBy("query").agg(F.avg("cosine").alias("overall"))
    own = setting.groupBy("query", "modality").agg(F.avg("cosine").alias("own"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= R.MODALITY_LEAST)
    centred = scored.join(F.broadcast(own.drop("n")), ["query", "modality"], "left").join(F.broadcast(overall), "query").withColumn("d", F.col("cosine") - F.coalesce("own", "overall"))
    scale = centred.where("sets_scale").groupBy("query").agg(F.avg("d").alias("mu"), F.greatest(F.stddev_pop("d"), F.lit(R.LEAST_SPREAD)).alias("sigma"))
    meant = centred.join(F.broadcast(scale), "query").withColumn("z", (F.col("d") - F.col("mu")) / F.col("sigma"))
    best = meant.groupBy("query", "file").agg(F.max(F.struct("z", (-F.col("id")).alias("minus"), "kind")).alias("b")).select("query", "file", "b.z", "b.kind")

    ways = [(text, *((0.5, 2 * word_weight) if lookup(query_terms(text)) else (1.0, word_weight)), hinted_kinds(text)) for text in queries]
    weights = F.broadcast(spark.createDataFrame(ways, "query string, mw double, ww double, hinted array<string>"))
    both = best.join(_words_of_many(index, queries, widen), ["query", "file"], "full_outer").join(weights, "query")
    z, c = F.coalesce("z", F.lit(0.0)), F.coalesce("coverage", F.lit(0.0))
    bonus = F.when(F.array_contains("hinted", F.coalesce("kind", F.lit(""))), R.KIND_BONUS).otherwise(0.0)
    score = F.col("mw") * F.greatest(z, F.lit(0.0)) + F.col("ww") * F.pow(c, F.lit(R.COVERAGE_POWER)) + bonus
    hits = both.where((z >= R.Z_GATE) | (c >= R.COVERAGE_GATE)).withColumn("score", score)
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "file")))
    return ranked.where(F.col("rank") <= limit).select("query", "file", "score", "z", "coverage", "rank")
