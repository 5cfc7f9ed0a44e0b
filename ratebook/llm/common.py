"""Small helpers of the operators."""

from __future__ import annotations

import string
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratebook.operators.staging import stage

BROADCAST_BYTES = 16 << 20

# Lower-cased words of ASCII letters, digits and all other characters beyond ASCII.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def fold(text: Column) -> Column:
    """A-Z lowered, nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (a written table) with a broadcast hint if its bytes are counted and few.

    Beyond ``limit`` there is no hint: Spark shuffles, and AQE splits hot keys.
    """
    wide = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    row = sum(wide, F.lit(16 + 8 * len(df.columns)))
    size = df.agg(F.sum(row)).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


@contextmanager
def text_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Few rows in an Arrow batch while jobs over whole texts or sets run.

    A row holds a document; the default of 10 000 rows would put ten thousand of them
    into a Python worker at once. The session's own setting is put back.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stage_texts(df: DataFrame) -> DataFrame:
    """Write a table made by Python from whole texts, and return it."""
    with text_batches(df.sparkSession):
        return stage(df)
