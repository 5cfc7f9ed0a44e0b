"""Deterministic sampling: the same rows on every run and every cluster size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import attach
from .ordered import key_struct, long_values, ordered
from .staging import stage

_SPACE = 1 << 52  # row hashes are below this, and exact as doubles


def row_hash(keys: Sequence[str], seed: int) -> Column:
    """52 bits of a digest of the seed and the key, the same on every engine."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")


def hash_split(
    df: DataFrame, keys: Sequence[str], test_share: float = 0.25, seed: int = 17
) -> DataFrame:
    """``split`` = test or train by the hash of the row's key, to any share."""
    test = row_hash(keys, seed) < F.lit(int(test_share * _SPACE))
    return df.withColumn("split", F.when(test, "test").otherwise("train"))


def stratified_sample(
    df: DataFrame,
    strata: Sequence[str],
    keys: Sequence[str],
    size: int,
    seed: int = 17,
) -> DataFrame:
    """``size`` rows, split over the strata in proportion to their rows.

    A stratum gets the whole part of size * share, and those with the largest
    remainders one row more (ties by stratum), so the quotas add up to ``size``; it
    keeps the rows with the smallest key hash. The cut-off hash is found by the
    distributed rank operator, so no stratum is sorted in one task. Rows with the
    same key share their fate.
    """
    u = row_hash(keys, seed).cast("double")
    counts = stage(df.groupBy(key_struct(strata).alias("_g")).agg(F.count("*").alias("_rows")))
    total = counts.agg(F.sum("_rows")).first()[0] or 0
    want = min(size, total)
    share = F.col("_rows").cast("decimal(38,0)") * want
    whole = counts.withColumns(
        {"_whole": F.floor(share / max(total, 1)).cast("bigint"), "_rest": (share % max(total, 1)).cast("bigint")}
    )
    left = want - (whole.agg(F.sum("_whole")).first()[0] or 0)
    more = whole.orderBy(F.desc("_rest"), "_g").limit(left).select("_g", F.lit(1).alias("_more"))
    quotas = stage(
        whole.join(more, "_g", "left")
        .select("_g", (F.col("_whole") + F.coalesce("_more", F.lit(0))).alias("_quota"))
        .filter("_quota > 0")
    )
    data = ordered(long_values(df, strata, {"u": u}))
    counted = data.with_buckets(attach(data.buckets, quotas, ["_g"], "inner"))
    cut = counted.at_ranks(F.array(F.col("_quota") - F.lit(1))).select("_g", F.col("value").alias("_cut"))
    keyed = df.withColumns({"_g": key_struct(strata), "_u": u})
    return attach(keyed, cut, ["_g"], "inner").filter("_u <= _cut").drop("_g", "_u", "_cut")
