"""Helpers that several corpus operators use: the shared folder, lineage cuts, and contract text rules."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract: space, tab, LF, VT, FF, CR; and a word.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch: few, since one text may be long.
ARROW_ROWS = 512


def read(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of this machine,
    in local mode only (tests): on a cluster, executors wouldn't see each other's files."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    own = set_by_cluster or spark.sparkContext.getCheckpointDir()
    if not own:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sievework-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: a lineage cut that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes `written` tables that nothing reads any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_side(table: DataFrame, most: int = 16 << 20) -> DataFrame:
    """A `written` table of narrow rows as the side of a join: broadcast while its rows take `most` bytes at most, by
    their columns' width and by four times its files' size; beyond that both sides are shuffled."""
    path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_to)
    stored = path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return F.broadcast(table) if max(table.count() * 8 * (len(table.columns) + 2), 4 * stored) <= most else table


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names close to `names` that `df` doesn't have in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of whole texts small enough for a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives the memory it has freed back to the machine at the task's end: the worker
    stays, and others need the memory."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:
            # Not every C library has it.
            return

    return tidied


def fold(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo `modulus`: the folds that contracts fix. A null key is in fold 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus, F.lit(0))
