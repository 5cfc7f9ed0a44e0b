"""Writing an intermediate table once, so that later steps only scan it.

The published tables feed percentiles, grades and regressions, which use them
several times. Without a cut, Spark would plan and run the whole history at each
use, and a lost executor would redo it. ``stage`` writes parquet below the
session's ``spark.checkpoint.dir``, the folder all executors share, and reads it
back: no lineage, and file sizes Catalyst can use to choose a join.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else the context's checkpoint folder.

    A temporary folder is used only by a local master, where the driver and all
    tasks share one machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not named:
        named = context.getCheckpointDir()
    if named:
        return f"{named.rstrip('/')}/ratebook"
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = context.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="ratebook-")
    return _LOCAL[app]


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    # Zstandard: about a quarter less on disk than the default.
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Bytes of the given files for each bucket, and for each task that deals them out.
BUCKET_BYTES, SPLIT_BYTES = 16 << 20, 32 << 20
MOST_BUCKETS = 512


def buckets_for(spark: SparkSession, path: str) -> int:
    """Buckets for the rows of a file or folder: by its size, at least one for each core."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    held = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return max(spark.sparkContext.defaultParallelism, min(MOST_BUCKETS, -(-held // BUCKET_BYTES)))


def stage_by(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    """:func:`stage` into a table bucketed by ``keys``: what joins or groups by them reads it in place.

    Each task writes its rows of a bucket as one compressed columnar file, a third of the bytes
    that an exchange of the same rows takes, and no exchange follows.
    """
    spark = df.sparkSession
    name = f"ratebook_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    # A task sorts its rows by bucket before it writes them: small splits are sorted in memory.
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before) > SPLIT_BYTES:
        spark.conf.set(setting, str(SPLIT_BYTES))
    try:
        writer = df.write.format("parquet").option("compression", "zstd").option("path", path)
        writer.bucketBy(buckets, *keys).saveAsTable(name)
    finally:
        spark.conf.set(setting, before)
    return spark.table(name)


# Where a frame keeps the copies of its rows that lie by some keys.
_COPIES, _LIES = "_ratebook_copies", "_ratebook_lies"


def lies_by(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    """Mark ``df``, read from :func:`stage_by`: equal ``keys`` are in one task, few rows of each."""
    vars(df)[_LIES] = tuple(keys), buckets
    return with_copy(df, keys, lambda: df)


def with_copy(df: DataFrame, keys: Sequence[str], make: Callable[[], DataFrame | None]) -> DataFrame:
    """Name a copy of the rows of ``df`` that lies by ``keys``; made when it is first asked for."""
    vars(df)[_COPIES] = (*vars(df).get(_COPIES, ()), (frozenset(keys), cache(make)))
    return df


def lying(df: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """The rows of ``df`` where each group by ``keys`` is in one task, if there is such a copy.

    Grouping them by the plain columns needs no exchange. Only a marked frame has one: what is
    derived from it has not.
    """
    for held, make in vars(df).get(_COPIES, ()):
        if held <= set(keys) and (copy := make()) is not None:
            return copy
    return None


def stage_beside(df: DataFrame, rows: DataFrame | None) -> DataFrame:
    """:func:`stage` of a table made from ``rows`` where they lie, in the same buckets if they are marked."""
    keys, buckets = ((), 0) if rows is None else vars(rows).get(_LIES, ((), 0))
    if not keys or not set(keys) <= set(df.columns):
        return stage(df)
    return lies_by(stage_by(df, keys, buckets), keys, buckets)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Tables staged here give up the files of their own exchanges once they are written.

    Otherwise those stay until the driver collects its garbage. The session's own
    setting is put back.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)
