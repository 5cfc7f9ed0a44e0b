"""Sharding by jump consistent hashing: no ring table, minimal movement on growth.

A row's shard depends on its key and the number of shards alone. With one more
shard, a row stays or moves into the new shard.

Slots number the rows of a shard from 0 without gaps. No task holds a shard: rows
are range-partitioned by (shard, key), each sorted partition knows how many rows
of each shard it has, and a small table of offsets does the rest.

Defined results: a NULL key hashes as the empty string; a NULL text has no bytes
and a NULL checksum; rows with equal keys share a shard and have slots of their
own, in order of checksum and size; an empty table gives no rows; further columns
are kept by :func:`assign` and ignored by :func:`number`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratebook.operators.staging import stage

OVERHEAD = 16


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key (Lamping and Veach)."""
    state = keys.astype(np.uint64)
    at = np.zeros(len(state), np.int64)
    target = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while live.size:
        at[live] = target[live]
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        share = (1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        target[live] = ((at[live] + 1) * share).astype(np.int64)
        live = live[target[live] < shards]
    return at.astype(np.int32)


def hash_key(key: Column) -> Column:
    """64 well-mixed bits of a key's text, the same on every engine."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 16), 16, -10).cast("long")


def assign(df: DataFrame, key: str, shards: int, out: str = "shard") -> DataFrame:
    """``df`` with the shard of each row."""

    @F.pandas_udf("int")
    def jumped(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64), shards))

    return df.withColumn(out, jumped(hash_key(F.col(key))))


def number(df: DataFrame, shard: str, order: list[str], out: str = "slot") -> DataFrame:
    """``df`` with a gapless number of each row in its shard, by ``order``."""
    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    sorted_rows = (
        df.repartitionByRange(int(parts), shard, *order)
        .sortWithinPartitions(shard, *order)
        .withColumns({"_part": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()})
    )
    rows = stage(sorted_rows)
    counts = rows.groupBy(shard, "_part").agg(F.count("*").alias("_n"), F.min("_seq").alias("_first"))
    before = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        shard, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    return (
        rows.join(offsets, [shard, "_part"])
        .withColumn(out, F.col("_seq") + F.col("_shift"))
        .drop("_part", "_seq", "_shift")
    )


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Every document's size, checksum, shard, slot, and shard after one is added."""
    text = F.encode(F.col("text"), "UTF-8")
    sized = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = assign(assign(sized, "doc_id", shards), "doc_id", shards + 1, "grown_shard")
    return number(placed, "shard", ["doc_id", "text_crc32", "size"])


def write_shards(docs: DataFrame, path: str, shards: int, key: str = "doc_id") -> None:
    """Write all rows and columns, one folder per shard; large shards get more files."""
    assign(docs, key, shards, "_shard").hint("rebalance", "_shard").write.partitionBy("_shard").parquet(path)
