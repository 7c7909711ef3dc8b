"""Stored keyword and vector indexes of the provided tables: built once for a table's state, then read by every search."""

from __future__ import annotations

import hashlib
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievework.operators import vectors
from sievework.operators.keyword_index import KeywordIndex, build
from sievework.operators.vectors import VectorIndex

#: Changes with what an index holds.
FORMAT = 3
_lock = threading.Lock()


def index_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which executors share; where it is unset, a folder of this machine in local mode only."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not own:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sievework-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def _state(spark: SparkSession, path: str) -> str:
    """What names a table's state: its files with their sizes and times."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}" for s in fs.listStatus(at))
    return hashlib.sha256("\n".join(files).encode()).hexdigest()[:24]


def stored(spark: SparkSession, name: str, path: str, make: Callable[[str], None]) -> str:
    """The folder of an index of the table at `path`. It is built aside and renamed into place, so that nobody reads half
    of it; the first of several builders wins."""
    with _lock:
        folder = f"{index_folder(spark)}/{name}-{FORMAT}-{_state(spark, path)}"
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = at(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at(folder)):
            aside = f"{folder}-{uuid.uuid4().hex}"
            make(aside)
            if fs.exists(at(folder)) or not fs.rename(at(aside), at(folder)):
                fs.delete(at(aside), True)
        return folder


def keyword_index(spark: SparkSession, path: str, rows: DataFrame) -> KeywordIndex:
    """The index of rows (rowid, file, name, body) that come from the table at `path`."""
    return KeywordIndex(spark, stored(spark, "keywords", path, lambda folder: build(rows, folder)))


def vector_index(spark: SparkSession, path: str, segments: DataFrame) -> VectorIndex:
    """The index of segments (id, file, kind, modality, sets_scale, vec) that come from the table at `path`."""
    return VectorIndex(spark, stored(spark, "vectors", path, lambda folder: vectors.build(segments, folder)))
