"""20-80 grades of a raw score (lower raw is better) and their composites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clip, half_even, ratio
from .joins import attach
from .ordered import NEAREST, long_values, ordered, quantile_points, unpack
from .sums import exact_sum, prepared

BEST, WORST = 80.0, 20.0


def _points(df: DataFrame, keys: Sequence[str], value: Column, qs: Sequence[float]) -> DataFrame:
    long = long_values(df, keys, {"v": value}).filter("value IS NOT NULL")
    return quantile_points(ordered(long), {"v": list(qs)}, NEAREST).select(
        *unpack(keys), "n", *[F.col("q")[i].alias(f"q{i}") for i in range(len(qs))]
    )


def grade_thresholds(
    df: DataFrame,
    entity: str = "pitcher_mlbid",
    season: str = "season",
    tag: str = "pitch_tag",
    raw: str = "stuff_raw",
    level: Column | None = None,
    min_rows: int = 50,
    min_entities: int = 10,
    low: float = 0.01,
    high: float = 0.99,
) -> DataFrame:
    """season, tag, lo, hi: nearest-rank quantiles of entity averages.

    Seasons with fewer than ``min_entities`` qualified entities use the
    all-season thresholds of their tag.
    """
    pool = df if level is None else df.filter(level)
    averages = (
        pool.groupBy(season, entity, tag)
        .agg(F.avg(raw).alias("score"), F.count("*").alias("rows"))
        .filter(F.col("rows") >= min_rows)
    )
    return _with_fallback(averages, season, tag, min_entities, low, high)


def row_thresholds(
    df: DataFrame,
    season: str = "season",
    tag: str = "pitch_tag",
    raw: str = "stuff_raw",
    low: float = 0.2,
    high: float = 0.8,
) -> DataFrame:
    """Thresholds of the raw rows themselves, one grain below entity averages."""
    points = _points(df, [season, tag], F.col(raw), [low, high])
    return points.select(season, tag, F.col("q0").alias("lo"), F.col("q1").alias("hi"))


def _with_fallback(
    averages: DataFrame, season: str, tag: str, min_entities: int, low: float, high: float
) -> DataFrame:
    # Entities count towards the minimum even when their average is NULL.
    sizes = averages.groupBy(season, tag).agg(F.count("*").alias("entities"))
    score = F.col("score")
    by_season = _points(averages, [season, tag], score, [low, high]).select(
        season, tag, F.col("q0").alias("lo"), F.col("q1").alias("hi")
    )
    overall = _points(averages, [tag], score, [low, high]).select(
        tag, F.col("q0").alias("all_lo"), F.col("q1").alias("all_hi")
    )
    enough = F.col("entities") >= min_entities
    return (
        sizes.join(by_season, [season, tag], "left")
        .join(overall, tag, "left")
        .select(
            season,
            tag,
            F.when(enough, F.col("lo")).otherwise(F.col("all_lo")).alias("lo"),
            F.when(enough, F.col("hi")).otherwise(F.col("all_hi")).alias("hi"),
        )
    )


def grade(raw: Column, lo: Column, hi: Column) -> Column:
    """80 at ``lo`` down to 20 at ``hi``, clamped, rounded half-even.

    NULL when a threshold or the score is NULL or both thresholds are equal.
    """
    scaled = F.lit(BEST) - F.try_divide(F.lit(BEST - WORST) * (raw - lo), hi - lo)
    return half_even(clip(scaled, WORST, BEST)).cast("bigint")


def apply_grades(
    df: DataFrame,
    thresholds: DataFrame,
    on: Sequence[str] = ("season", "pitch_tag"),
    raw: str = "stuff_raw",
    name: str = "stuff",
) -> DataFrame:
    return (
        attach(df, thresholds, on)
        .withColumn(name, grade(F.col(raw), F.col("lo"), F.col("hi")))
        .drop("lo", "hi")
    )


def weighted_mean(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    weight: str,
    name: str,
    skip_null: bool = False,
) -> DataFrame:
    """sum(value*weight)/sum(weight); a NULL value keeps its weight by default."""
    weights = f"CASE WHEN `{value}` IS NOT NULL THEN `{weight}` END" if skip_null else f"`{weight}`"
    products = f"`{value}` * `{weight}`"
    # A sum over NULL values only is 0, as a sum over nothing.
    top = F.coalesce(F.expr(exact_sum(products)), F.lit(0.0))
    added = prepared(df, [products]).groupBy(*keys)
    return added.agg(ratio(top, F.sum(F.expr(weights))).alias(name))


def with_composite(
    table: DataFrame, graded: DataFrame, keys: Sequence[str], name: str = "stuff"
) -> DataFrame:
    """Usage-weighted grade of ``graded`` brought to ``table`` (one row per keys)."""
    return table.join(weighted_mean(graded, keys, name, "pitches", name), list(keys), "left")


def z_grades(
    df: DataFrame,
    keys: Sequence[str],
    raw: str,
    pool: Column,
    z_name: str = "stuff_z",
    name: str = "stuff",
) -> DataFrame:
    """z against the pool's group mean and deviation; grade 50 - 10 z in 20..80."""
    stats = (
        df.filter(pool)
        .groupBy(*keys)
        .agg(F.avg(raw).alias("_mean"), F.stddev_samp(raw).alias("_std"))
    )
    z = F.when(F.col("_std") > 0, (F.col(raw) - F.col("_mean")) / F.col("_std"))
    return (
        attach(df, stats, keys)
        .withColumn(z_name, z)
        .withColumn(name, clip(F.lit(50.0) - F.lit(10.0) * F.col(z_name), WORST, BEST))
        .drop("_mean", "_std")
    )
