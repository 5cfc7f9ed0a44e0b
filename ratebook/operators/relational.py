"""Table plumbing: unions, deduplication, merges, column contracts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ensure_columns(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add the missing ones of ``name -> type`` as typed NULLs."""
    missing = {
        c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns
    }
    return df.withColumns(missing) if missing else df


def rename_missing(df: DataFrame, legacy: Mapping[str, str]) -> DataFrame:
    """Rename legacy columns whose new name does not exist yet."""
    names = {
        old: new
        for old, new in legacy.items()
        if old in df.columns and new not in df.columns
    }
    return df.withColumnsRenamed(names)


def project(df: DataFrame, columns: Sequence[str], rename: Mapping[str, str] | None = None) -> DataFrame:
    """Ordered projection with renames: a published schema."""
    rename = rename or {}
    return df.select(*[F.col(f"`{c}`").alias(rename.get(c, c)) for c in columns])


def drop_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def widen_numbers(df: DataFrame) -> DataFrame:
    """Integers to bigint and floats to double, so that unions line up."""
    wide = {
        "tinyint": "bigint", "smallint": "bigint", "int": "bigint", "float": "double",
    }
    return df.select(
        *[
            F.col(f"`{c}`").cast(wide[t]).alias(c) if t in wide else F.col(f"`{c}`")
            for c, t in df.dtypes
        ]
    )


def union_diagonal(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns a frame lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first by ``order``; remaining ties by content.

    Built as an aggregate (``min_by``) and not as a window, so that copies are
    reduced before the shuffle and a key with many copies never fills a task.
    """
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in df.columns])
    content = [F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    rank = F.struct(*order, *[c.alias(f"_{i}") for i, c in enumerate(content)], F.lit(0))
    return (
        df.groupBy(F.struct(*[F.col(k) for k in keys]).alias("_id"))
        .agg(F.min_by(row, rank).alias("_row"))
        .select("_row.*")
    )


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pass rows through; the job fails if a key repeats."""
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise ValueError(f"missing join keys {missing}")
    packed = F.struct(*[F.col(k) for k in keys])
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in df.columns])
    return (
        df.groupBy(packed.alias("_id"))
        .agg(F.count("*").alias("_n"), F.any_value(row).alias("_row"))
        .withColumn(
            "_ok",
            F.when(F.col("_n") == 1, F.lit(True)).otherwise(
                F.raise_error(F.concat(F.lit("duplicate key "), F.to_json("_id")))
                .cast("boolean")
            ),
        )
        .filter("_ok")
        .select("_row.*")
    )


def merge_frames(base: DataFrame, frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Left-merge frames that have at most one row per key."""
    for frame in frames:
        base = base.join(require_unique(frame, keys), list(keys), "left")
    return base


def merge_regressed(base: DataFrame, regressed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Published table plus the ``_reg``/``_raw``/``_n`` columns of its regression."""
    extra = [
        c
        for c in regressed.columns
        if c.endswith(("_reg", "_raw", "_n")) and c not in keys
    ]
    small = regressed.select(*keys, *extra)
    first = dedupe(small, keys, [])
    clash = [c for c in extra if c in base.columns]
    return base.drop(*clash).join(first, list(keys), "left")


def distinct_options(df: DataFrame, column: str, numeric: bool = False) -> DataFrame:
    """Distinct non-NULL values; numeric ones descending, text ascending."""
    options = df.select(column).filter(F.col(column).isNotNull()).distinct()
    if numeric:
        number = F.col(column).cast("string").try_cast("double")
        return options.orderBy(number.desc_nulls_last(), column)
    return options.orderBy(column)
