"""Cost estimates of indexing, and costs measured while it runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Seconds a unit, units that are enough to trust a measured cost, clamps.
COSTS = {"image": 0.12, "screenshot": 0.32, "pdfPage": 0.09, "docChunk": 0.045, "audioSecond": 0.0089, "videoSecond": 0.019, "codeStretch": 0.037}
ENOUGH = {"image": 20, "screenshot": 20, "pdfPage": 30, "docChunk": 30, "audioSecond": 600, "videoSecond": 600, "codeStretch": 100}
UNIT = {"image": "image", "screenshot": "screenshot", "pdf": "pdfPage", "doc": "docChunk", "audio": "audioSecond", "video": "videoSecond", "code": "codeStretch"}
PACE = (0.02, 50.0)
CHARS_PER_STRETCH, BYTES_PER_CHAR, BYTES_PER_STRETCH = 1400, 2.4, 1600.0
BIG_PDF, PDF_STEP, MAX_PAGES, DOC_STEP, MAX_CHUNKS = 50, 30, 5000, 40, 5000


def units(files: DataFrame) -> DataFrame:
    """Files (path, kind, size, pages, duration) with first and later units."""
    pages = F.least("pages", F.lit(MAX_PAGES))
    first_pages = F.when(F.col("pages") > BIG_PDF, F.least(pages, F.lit(PDF_STEP))).otherwise(pages)
    parts = F.greatest(F.lit(1), F.least(F.lit(MAX_CHUNKS), F.floor(F.col("size") / 2000)))
    chars = F.when(F.lower("path").endswith(".ipynb"), F.floor(F.col("size") / 8)).otherwise(F.col("size"))
    code = F.greatest(F.lit(1), F.floor((chars + CHARS_PER_STRETCH - 1) / CHARS_PER_STRETCH))
    by = lambda **k: F.coalesce(*[F.when(F.col("kind") == kind, v.cast("double")) for kind, v in k.items()], F.lit(0.0))
    first = by(image=F.lit(1), screenshot=F.lit(1), pdf=first_pages, doc=F.least(parts, F.lit(DOC_STEP)), audio=F.col("duration"), video=F.col("duration"), code=code)
    later = by(pdf=pages - first_pages, doc=parts - F.least(parts, F.lit(DOC_STEP)))
    size = F.when(F.col("kind") == "code", chars * BYTES_PER_CHAR + code * BYTES_PER_STRETCH).otherwise(0.0)
    return files.withColumns({"first_units": first, "later_units": later, "index_bytes": size})


def cost(kind: Column, costs: dict[str, float] | None = None) -> Column:
    own = costs or COSTS
    return F.coalesce(*[F.when(kind == k, F.lit(own[u])) for k, u in UNIT.items()], F.lit(0.0))


def estimated(files: DataFrame, *by: str, costs: dict[str, float] | None = None) -> DataFrame:
    """Files, seconds, later seconds, long files, index bytes, by group: partial sums, so estimates add up."""
    counted = units(files).withColumn("cost", cost(F.col("kind"), costs))
    return counted.groupBy(*by).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum(F.col("first_units") * F.col("cost")).alias("seconds"),
        F.sum(F.col("later_units") * F.col("cost")).alias("later_seconds"),
        F.sum((F.col("later_units") > 0).cast("int")).alias("long_files"),
        F.sum("index_bytes").alias("index_bytes"),
    )


def subfolder(path: Column, folder: str) -> Column:
    """The folder one level down that holds a path, or the folder itself for loose files."""
    below = F.regexp_extract(F.substring(path, len(folder) + 2, 1 << 30), r"^([^/]+)/", 1)
    return F.when(below != "", F.concat(F.lit(folder + "/"), below)).otherwise(F.lit(folder))


MAPS = "name string, first long, since array<double>, scale array<double>, units array<double>, seconds array<double>"


def _composed(units: np.ndarray, seconds: np.ndarray, most: float, top: float) -> list[np.ndarray]:
    """What a run of jobs makes of any tally of `top` units at most before it: from `since[k]` units on, scale[k] times that tally, plus units[k]
    and seconds[k]. One job halves what is above `most`, so each may cut one of the pieces in two."""
    since, scale, u, s = (np.array([x]) for x in (0.0, 1.0, 0.0, 0.0))
    for more, took in zip(units.tolist(), seconds.tolist(), strict=True):
        # A tally of so long ago that nothing is left of it (a scale of zero) decides nothing any more.
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            cut = (most - u) / scale
        inner = np.flatnonzero((cut >= since) & (np.nextafter(cut, np.inf) < np.append(since[1:], top)))
        if len(inner):
            # Above the cut a piece of its own begins; exactly at it nothing is halved yet.
            at = inner + 1
            since, scale, u, s = np.insert(since, at, np.nextafter(cut[inner], np.inf)), np.insert(scale, at, scale[inner]), np.insert(u, at, u[inner]), np.insert(s, at, s[inner])
            cut = np.insert(cut, at, cut[inner])
        half = np.where(since > cut, 0.5, 1.0)
        scale, u, s = scale * half, u * half + more, s * half + took
    return [since, scale, u, s]


def tallies(jobs: DataFrame) -> DataFrame:
    """name, seconds, units after jobs (seq, name, units, seconds) in order: past ten times what is enough, what came
    before is halved.

    An ordered fold, in parallel: jobs lie in ranges of (name, seq), and each range composes its jobs to one map from a tally
    before it to the one after it, piece by piece linear. Then each name's maps are applied in order, one for each range,
    however many jobs it has. Null names are a name; jobs of equal number come in the order of their units and seconds."""

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Ranges hold one task's jobs; of them only the columns stay until the name ends.
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        names = table["name"].to_pylist()
        cuts = [k for k in range(len(names)) if not k or names[k] != names[k - 1]] + [len(names)]
        out = []
        for low, high in zip(cuts, cuts[1:], strict=False):
            most = 10.0 * ENOUGH.get(names[low], 20)
            own = [table[c].slice(low, high - low).to_numpy() for c in ("seq", "units", "seconds")]
            out.append((names[low], int(own[0][0]), *(x.tolist() for x in _composed(own[1], own[2], most, max(most, 2 * largest) + largest))))
        if out:
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1]), *(pa.array(c, pa.list_(pa.float64())) for c in columns[2:])], [c.split()[0] for c in MAPS.split(", ")])

    rows = jobs.where("units > 0 and seconds > 0").select("name", F.col("seq").cast("long").alias("seq"), F.col("units").cast("double").alias("units"), F.col("seconds").cast("double").alias("seconds"))
    # No tally is above what the largest job can make of one.
    largest = rows.agg(F.max("units")).first()[0] or 0.0
    maps = rows.repartitionByRange("name", "seq").sortWithinPartitions("name", "seq", "units", "seconds").mapInArrow(composed, MAPS)
    # A map for each range that holds the name.
    ordered = maps.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("first", "since", "scale", "units", "seconds"))).alias("maps"))
    state = "struct<s:double,u:double>"

    def step(acc, m):
        piece = F.size(F.filter(m["since"], lambda x: x <= acc["u"]))
        of = lambda c: F.element_at(m[c], piece)
        return F.struct((acc["s"] * of("scale") + of("seconds")).alias("s"), (acc["u"] * of("scale") + of("units")).alias("u")).cast(state)

    folded = ordered.withColumn("t", F.aggregate("maps", F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("u")), step))
    return folded.select("name", F.col("t.s").alias("seconds"), F.col("t.u").alias("units"))


def pace(measured: DataFrame) -> DataFrame:
    """Measured over expected cost, a geometric mean by seconds over the names with enough units."""
    enough = F.coalesce(*[F.when(F.col("name") == k, F.lit(float(v))) for k, v in ENOUGH.items()])
    expected = F.coalesce(*[F.when(F.col("name") == k, F.lit(v)) for k, v in COSTS.items()])
    own = measured.where((F.col("units") >= enough) & (F.col("seconds") > 0))
    ratio = F.log(F.col("seconds") / F.col("units") / expected)
    return own.agg(F.exp(F.sum(F.col("seconds") * ratio) / F.sum("seconds")).alias("pace"))


def trusted(measured: DataFrame) -> DataFrame:
    """name, cost: measured where there is enough, else fixed at the pace."""
    spark = measured.sparkSession
    fixed = spark.createDataFrame([(k, v, float(ENOUGH[k])) for k, v in COSTS.items()], "name string, fixed double, enough double")
    here = F.least(F.greatest(F.coalesce("pace", F.lit(1.0)), F.lit(PACE[0])), F.lit(PACE[1]))
    both = F.broadcast(fixed).join(measured, "name", "left").crossJoin(F.broadcast(pace(measured)))
    return both.select("name", F.when(F.col("units") >= F.col("enough"), F.col("seconds") / F.col("units")).otherwise(F.col("fixed") * here).alias("cost"))
