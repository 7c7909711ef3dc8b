"""Rules over pictures, sound, pages and measurements, as expressions over what decoders give."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, LongType

from sievework.functions.passages import page_problem

#: Least side of a picture, silence, soft-token budgets, a patch's pixels and pooling, a page's least text.
LEAST_SIDE, SILENCE, BUDGETS, SIDE, PATCHES, PAGE_TEXT = 256, 0.003, (70, 140, 280, 560, 1120), 48, 9, 200
AGREE, BUSY, BUSY_CORE = 1.15, 0.5, 0.05


def large_enough(width: Column, height: Column) -> Column:
    return F.greatest(width, height) >= LEAST_SIDE


def rms(samples: Column) -> Column:
    """Root mean square of 16-bit samples on a scale to 1; 0 of none."""
    squares = F.aggregate(samples, F.lit(0.0), lambda s, x: s + (x / 32768.0) * (x / 32768.0))
    return F.when(F.size(samples) > 0, F.sqrt(squares / F.size(samples))).otherwise(0.0)


def audible(samples: Column) -> Column:
    return rms(samples) > SILENCE


@F.pandas_udf(LongType())
def average_hash(pixels: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """64 bits of packed RGB pixels: an 8 x 8 cell is 1 where its mean grey is above the cells' mean."""

    def one(data: bytes, w: int, h: int) -> int:
        rgb = np.frombuffer(data, np.uint8)[: w * h * 3].reshape(h, w, 3).astype(np.int64)
        grey = rgb @ np.array([299, 587, 114]) // 1000
        rows, columns = ([(k * n // 8, min(n, max(k * n // 8 + 1, (k + 1) * n // 8))) for k in range(8)] for n in (h, w))
        cells = np.array([[int(grey[a:b, c:d].sum()) // max((b - a) * (d - c), 1) for c, d in columns] for a, b in rows]).ravel()
        bits = sum(1 << i for i, cell in enumerate(cells) if cell > int(cells.sum()) // 64)
        return bits - (1 << 64) if bits >> 63 else bits

    return pd.Series([one(bytes(p), int(w), int(h)) if p is not None and w and h else None for p, w, h in zip(pixels, width, height, strict=True)], dtype="Int64")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def valid_budget(budget: Column) -> Column:
    return budget.isin(*BUDGETS)


def target_size(height: Column, width: Column, budget: Column) -> Column:
    """struct(height, width) that fills a budget of soft tokens, each side a multiple of 48; null for no picture."""
    scale = F.sqrt(F.try_divide(budget * F.lit(float(PATCHES * (SIDE // 3) ** 2)), height * width))
    floor = lambda n: F.floor(scale * n / SIDE).cast("long") * SIDE
    strip = lambda n, m: F.least(F.floor(F.try_divide(n, m)).cast("long") * SIDE, budget * SIDE)
    h, w = floor(height), floor(width)
    tall = F.when((h == 0), SIDE).when(w == 0, strip(height, width)).otherwise(h)
    wide = F.when((h == 0), strip(width, height)).when(w == 0, SIDE).otherwise(w)
    return F.when((height > 0) & (width > 0) & ((h > 0) | (w > 0)), F.struct(tall.cast("long").alias("height"), wide.cast("long").alias("width")))


def page_parts(pages: DataFrame, least: int = PAGE_TEXT) -> DataFrame:
    """pages (page, text) with what each is read as: its text, or its picture with the text kept for words, or lost where
    the text layer is in glyph order."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    problem = page_problem(text)
    read = (F.coalesce(problem, F.lit("")) != "glyphOrder") & (F.length(text) >= least)
    garbled = F.when(problem == "glyphOrder", text)
    return pages.withColumns({"as": F.when(read, "page").otherwise("page_image"), "body": F.when(problem == "glyphOrder", "").otherwise(text), "garbled": garbled})


@F.pandas_udf(BinaryType())
def half_bytes(vectors: pd.Series) -> pd.Series:
    """Vectors as packed 16-bit floats."""
    return vectors.map(lambda v: np.asarray(v, np.float32).astype("<f2").tobytes(), na_action="ignore")


@F.pandas_udf(ArrayType(FloatType()))
def from_half(stored: pd.Series) -> pd.Series:
    return stored.map(lambda b: np.frombuffer(bytes(b), "<f2").astype(np.float32), na_action="ignore")


def agreement(one: DataFrame, other: DataFrame, inputs: list[str]) -> DataFrame:
    """least: the least cosine of two runs' vectors (input, vec) over the inputs; 0 where one is missing or differs in
    length."""
    from .ranking import dot

    both = one.select("input", F.col("vec").alias("a")).join(other.select("input", F.col("vec").alias("b")), "input")
    both = both.where((F.size("a") == F.size("b")) & (F.size("a") > 0))
    norms = F.sqrt(dot(F.col("a"), F.col("a"))) * F.sqrt(dot(F.col("b"), F.col("b")))
    cosine = F.when(norms > 0, dot(F.col("a"), F.col("b")) / norms).otherwise(0.0)
    found = both.where(F.col("input").isin(inputs)).agg(F.min(cosine).alias("least"), F.countDistinct("input").alias("n"))
    return found.select(F.when(F.col("n") == len(inputs), F.col("least")).otherwise(0.0).alias("least"))


def best_tries(tries: DataFrame, by: str, seconds: str) -> DataFrame:
    """by, best, steady: the fastest of some tries, and whether another came close to it."""
    best = tries.groupBy(by).agg(F.min(seconds).alias("best"))
    near = tries.join(best, by).groupBy(by, "best").agg(F.sum((F.col(seconds) <= F.col("best") * AGREE).cast("int")).alias("near"))
    return near.select(by, "best", (F.col("near") >= 2).alias("steady"))


def quiet_at(load: DataFrame, by: str, order: str, others: str, cores: int) -> DataFrame:
    """Where the mean of the last three samples of other programs' work is small enough to measure by."""
    last = Window.partitionBy(by).orderBy(order).rowsBetween(-2, 0)
    mean = F.when(F.count(F.lit(1)).over(last) == 3, F.avg(others).over(last))
    return load.withColumn("average", mean).withColumn("quiet", F.coalesce(F.col("average") < BUSY + BUSY_CORE * cores, F.lit(False)))


def scaled_cost(cost: Column, model: Column, here: Column) -> Column:
    """A cost's factor on this machine: the model's share as it ran here, the rest as it was."""
    part = F.least(cost, model)
    return (cost - part + part * here / model) / cost


def video_factor(frames: Column, sound: Column, frame_base: Column, frame_here: Column, sound_factor: Column) -> Column:
    """A second of video is its frames' share and its soundtrack's."""
    return (frames * frame_here / frame_base + sound * sound_factor) / (frames + sound)


def cumulative_pages(jobs: DataFrame, order: str, pages: str) -> DataFrame:
    """Pages read up to each job of a file's steps."""
    return jobs.withColumn("read_to", F.sum(pages).over(Window.partitionBy("file").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def pass_progress(events: DataFrame, by: str, order: str) -> DataFrame:
    """total: the most that done and pending files have come to so far in a pass."""
    whole = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("total", F.max(F.col("done") + F.col("pending")).over(whole))
