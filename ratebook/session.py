"""Session settings this library is written for.

They are ordinary Spark settings and only a recommendation: callers on a
cluster keep their own session, and AQE is on by default there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RECOMMENDED = {
    # Runtime re-planning: coalesce small shuffle partitions, split skewed ones.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Fact-to-dimension joins are followed by aggregations on the same keys, so
    # let the skew split happen even when it costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # The JVM never compiles a method above 8000 bytes of bytecode. Wide feature
    # and metric projections generate larger ones, and then the unfused plan,
    # whose methods are split, runs several times faster than the fused one.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Compiled plans kept for reuse; the default of 100 is fewer than one run of
    # all products needs, and wide aggregates take seconds to compile again.
    "spark.sql.codegen.cache.maxEntries": "2000",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(builder: SparkSession.Builder, **overrides: str) -> SparkSession.Builder:
    """Apply :data:`RECOMMENDED` (and overrides, dots written as ``__``)."""
    settings = dict(RECOMMENDED)
    settings.update({k.replace("__", "."): str(v) for k, v in overrides.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder


def tune(spark: SparkSession) -> SparkSession:
    """Apply :data:`RECOMMENDED` to a running session."""
    for key, value in RECOMMENDED.items():
        if spark.conf.isModifiable(key) and spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input with fewer splits than cores.

    A small file often is one row group, hence one task up to the first shuffle.
    Large inputs have more splits than cores and pass unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
