"""Ranking: vector scores on a per-query scale, keyword coverage, fusion, folding, grouping.

A query's vector is one row; vectors stay where they are, and every step is a partial aggregate or a top-k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The gates and weights of the ranking.
Z_GATE, COVERAGE_GATE, LEAST_SPREAD, MODALITY_LEAST = 2.0, 0.5, 0.02, 20
WORD_WEIGHT, CODE_WORD_WEIGHT, COVERAGE_POWER, KIND_BONUS, FOLD = 2.0, 1.0, 1.5, 1.0, 0.5


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, added in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalised(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x / norm)


def cosines(segments: DataFrame, query: DataFrame, vector: str = "vec") -> DataFrame:
    """Each segment with its cosine to the query, a DataFrame of one row with the column q."""
    return segments.crossJoin(F.broadcast(query.select("q").limit(1))).withColumn("cosine", dot(F.col(vector), F.col("q"))).drop("q")


def modality_means(scored: DataFrame) -> DataFrame:
    """Mean cosine of each modality over the rows that set the scale; small ones take the overall mean."""
    setting = scored.where("sets_scale")
    overall = setting.agg(F.avg("cosine").alias("overall"))
    own = setting.groupBy("modality").agg(F.avg("cosine").alias("own"), F.count(F.lit(1)).alias("n"))
    return own.crossJoin(F.broadcast(overall)).select("modality", "n", F.when(F.col("n") >= MODALITY_LEAST, F.col("own")).otherwise(F.col("overall")).alias("mean"))


def with_meaning(scored: DataFrame) -> DataFrame:
    """z: cosine less its modality's mean, over one pooled deviation. All rows are scored before any filter."""
    means = F.broadcast(modality_means(scored).select("modality", "mean"))
    overall = F.broadcast(scored.where("sets_scale").agg(F.avg("cosine").alias("overall")))
    centred = scored.join(means, "modality", "left").crossJoin(overall).withColumn("d", F.col("cosine") - F.coalesce("mean", "overall"))
    scale = centred.where("sets_scale").agg(F.avg("d").alias("mu"), F.greatest(F.stddev_pop("d"), F.lit(LEAST_SPREAD)).alias("sigma"))
    return centred.crossJoin(F.broadcast(scale)).withColumn("z", (F.col("d") - F.col("mu")) / F.col("sigma")).drop("mean", "overall", "d", "mu", "sigma")


def best_per_file(meant: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Each file's best segment: highest z, then lowest id. A partial aggregate, so a file may hold any share."""
    rows = meant if kinds is None else meant.where(F.col("kind").isin(kinds))
    best = F.max(F.struct("z", (-F.col("id")).alias("minus"), "cosine", "kind")).alias("b")
    return rows.groupBy("file").agg(best).select("file", (-F.col("b.minus")).alias("segment"), "b.z", "b.cosine", "b.kind")


def fused(best: DataFrame, coverage: DataFrame, lookup: bool, hinted: list[str], word_weight: float = WORD_WEIGHT) -> DataFrame:
    """Score of each file that passes a gate. best: file, z, kind; coverage: file, coverage."""
    meaning_weight, words = (0.5, 2 * word_weight) if lookup else (1.0, word_weight)
    both = best.join(coverage, "file", "full_outer")
    z, c = F.coalesce("z", F.lit(0.0)), F.coalesce("coverage", F.lit(0.0))
    bonus = F.when(F.col("kind").isin(hinted), KIND_BONUS).otherwise(0.0) if hinted else F.lit(0.0)
    score = meaning_weight * F.greatest(z, F.lit(0.0)) + words * F.pow(c, F.lit(COVERAGE_POWER)) + bonus
    return both.where((z >= Z_GATE) | (c >= COVERAGE_GATE)).withColumn("score", score)


def top(scored: DataFrame, k: int = 20) -> DataFrame:
    return scored.orderBy(F.desc("score"), "file").limit(k)


def with_strength(hits: DataFrame) -> DataFrame:
    """strong: within the fold of the best score. hits is a top-k, so one window over all of it is small."""
    best = F.max("score").over(Window.partitionBy())
    return hits.withColumn("strong", (best <= 0) | (F.col("score") >= FOLD * best))


def grouped(hits: DataFrame, group: str, k: int) -> DataFrame:
    """The first k hits of each group with the group's total; groups in the order of their best hit."""
    own = Window.partitionBy(group)
    order = own.orderBy(F.desc("score"), "file")
    placed = hits.withColumn("place", F.row_number().over(order)).withColumn("total", F.count(F.lit(1)).over(own)).withColumn("best", F.max("score").over(own))
    return placed.where(F.col("place") <= k)
