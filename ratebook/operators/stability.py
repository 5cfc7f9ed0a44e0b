"""How fast a statistic stabilises: between- and within-entity variance.

For a rate, the within-entity variance of entity i is mu(1-mu)/den_i, so its
mean over entities is mu(1-mu) * mean(1/den): no join back of mu is needed and
every constant of every statistic comes out of one two-level aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import ratio
from .beta import at_most as _at_most
from .metrics import Metric
from .ordered import (
    grouped_quantiles,
    key_struct,
    long_values,
    ordered,
    unpack,
)
from .staging import lying, stage

MIN_VARIANCE = 1e-8
CONSTANT_COLUMNS = [
    "n_players", "mu", "var_obs", "var_within", "var_true", "var_between", "K",
    "n_50", "n_70", "n_80",
]


def rate_samples(
    df: DataFrame, keys: Sequence[str], metrics: Sequence[Metric], min_denom: int = 20
) -> DataFrame:
    """keys, stat, num, den, value: one row per entity and rate."""
    cells = [m for m in metrics if m.kind == "rate"]
    df = lying(df, keys) or df
    wide = df.groupBy(*keys).agg(
        *[
            agg
            for i, m in enumerate(cells)
            for agg in (_cell(m.num).alias(f"num{i}"), _cell(m.den).alias(f"den{i}"))
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(m.name).alias("stat"),
                F.col(f"num{i}").alias("num"),
                F.col(f"den{i}").alias("den"),
            )
            for i, m in enumerate(cells)
        ]
    )
    return (
        wide.select(*keys, F.inline(rows))
        .filter(F.col("den") >= min_denom)
        .withColumn("value", ratio("num", "den"))
    )


def _cell(predicate: str) -> Column:
    return F.count("*") if predicate == "*" else F.count_if(F.expr(predicate))


def value_samples(
    df: DataFrame, keys: Sequence[str], metrics: Sequence[Metric], min_n: int = 20
) -> DataFrame:
    """keys, stat, value, var, n for means and maxima, in natural units."""
    cells = [m for m in metrics if m.kind in ("mean", "max")]
    df = lying(df, keys) or df
    aggs = []
    for i, m in enumerate(cells):
        v = F.expr(m.measured).cast("double")
        aggs += [
            (F.max(v) if m.kind == "max" else F.avg(v)).alias(f"v{i}"),
            F.var_samp(v).alias(f"s{i}"),
            F.count(v).alias(f"n{i}"),
        ]
    wide = df.groupBy(*keys).agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(m.name).alias("stat"),
                F.col(f"v{i}").alias("value"),
                F.col(f"s{i}").alias("var"),
                F.col(f"n{i}").alias("n"),
            )
            for i, m in enumerate(cells)
        ]
    )
    return wide.select(*keys, F.inline(rows)).filter(F.col("n") >= min_n)


def _floor(c: Column, low: float) -> Column:
    """Lower bound that keeps NULL."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), c))


def stabilisation_points(df: DataFrame) -> DataFrame:
    k = F.col("K")
    return df.withColumns(
        {
            "n_50": k * F.lit(0.5) / F.lit(0.5),
            "n_70": k * F.lit(0.7) / F.lit(0.3),
            "n_80": k * F.lit(0.8) / F.lit(0.2),
        }
    )


def rate_constants(
    samples: DataFrame, context: Sequence[str], min_players: int = 10
) -> DataFrame:
    """Beta-binomial moments per (context, stat)."""
    by = [*context, "stat"]
    spread = F.col("mu") * (F.lit(1.0) - F.col("mu"))
    out = (
        samples.groupBy(*by)
        .agg(
            F.avg("value").alias("mu"),
            F.var_samp("value").alias("var_obs"),
            F.count("*").alias("n_players"),
            F.avg(F.lit(1.0) / F.col("den")).alias("_inv"),
        )
        .filter(F.col("n_players") >= min_players)
        .withColumn("var_within", spread * F.col("_inv"))
        .withColumn("var_true", _floor(F.col("var_obs") - F.col("var_within"), MIN_VARIANCE))
        .withColumn("K", _floor(spread / F.col("var_true") - F.lit(1.0), 0.0))
        .drop("_inv")
    )
    return stabilisation_points(out)


def mean_constants(
    samples: DataFrame, context: Sequence[str], min_players: int = 10
) -> DataFrame:
    """One-way random effects per (context, stat)."""
    many = F.col("n") > 1
    freedom = F.when(many, F.col("n") - 1)
    out = (
        samples.groupBy(*context, "stat")
        .agg(
            F.avg("value").alias("mu"),
            F.var_samp("value").alias("var_obs"),
            F.count("*").alias("n_players"),
            F.avg(F.lit(1.0) / F.col("n")).alias("_inv"),
            ratio(F.sum(F.col("var") * freedom), F.sum(freedom)).alias("var_within"),
        )
        .filter(F.col("n_players") >= min_players)
        .withColumn(
            "var_between",
            _floor(F.col("var_obs") - F.col("var_within") * F.col("_inv"), MIN_VARIANCE),
        )
        .withColumn("K", _floor(F.col("var_within") / F.col("var_between"), 0.0))
        .drop("_inv")
    )
    return stabilisation_points(out)


# --- resampled statistics ---------------------------------------------------


def max_resampling_variance(
    df: DataFrame, keys: Sequence[str], value: Column, min_n: int = 20
) -> DataFrame:
    """keys, value, n, var_within: exact bootstrap variance of the maximum.

    A resample's maximum is the k-th smallest value or less with probability
    (k/n)^n, so value x with ``below`` smaller values and ``cnt`` copies has mass
    ((below+cnt)/n)^n - (below/n)^n. No resampling, hence no random numbers.
    Moments are taken around the maximum, where the mass sits.
    """
    long = long_values(df, keys, {"v": value}).filter("value IS NOT NULL")
    n = F.col("n").cast("double")
    mass = F.pow((F.col("below") + F.col("cnt")) / n, n) - F.pow(F.col("below") / n, n)
    gap = F.col("value") - F.col("top")
    return (
        ordered(long)
        .ranks()
        .filter(F.col("n") >= min_n)
        .groupBy("_g")
        .agg(
            F.max("value").alias("value"),
            F.max("n").alias("n"),
            F.sum(mass * gap).alias("_m1"),
            F.sum(mass * gap * gap).alias("_m2"),
        )
        .select(
            *unpack(keys),
            "value",
            "n",
            (F.col("_m2") - F.col("_m1") * F.col("_m1")).alias("var_within"),
        )
    )


def quantile_resampling_variance(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    q: float,
    iters: int,
    min_n: int = 20,
    seed: int = 7,
) -> DataFrame:
    """keys, value, n, var_within: bootstrap variance of the linear quantile.

    A resample is never drawn. The r-th smallest of n uniform draws is
    Beta(r, n-r+1), and the resample's r-th smallest value is the original value
    at position ceil(n * u); its successor follows from the conditional law of
    the next order statistic. A task draws ``iters`` position pairs per entity
    from a seed made of the entity's key, whatever the number of its rows, and
    only the values at those positions are looked up.
    """
    long = long_values(df, keys, {"v": value}).filter("value IS NOT NULL")
    data = ordered(long)
    sizes = data.buckets.groupBy("_g").agg(F.max("n").alias("n")).filter(F.col("n") >= min_n)

    @F.pandas_udf("array<bigint>")
    def draw(n: pd.Series, key_seed: pd.Series) -> pd.Series:
        out = []
        for size, s in zip(n, key_seed):
            rng = np.random.default_rng([seed, int(s) & 0xFFFFFFFFFFFFFFFF])
            r = int(np.floor((size - 1) * q)) + 1
            u = rng.beta(r, size - r + 1, iters)
            rest = max(size - r, 0)
            step = 1.0 - (1.0 - rng.random(iters)) ** (1.0 / rest) if rest else 0.0
            follow = u + (1.0 - u) * step
            places = np.concatenate([u, follow])
            ranks = np.clip(np.ceil(places * size).astype("int64") - 1, 0, size - 1)
            out.append(ranks.tolist())
        return pd.Series(out)

    at_q = F.lit(q) * (F.col("n") - 1)
    # Drawn once: 2 * iters positions per entity, and the two of the value itself.
    drawn = stage(
        sizes.select("_g", "n", draw(F.col("n"), F.xxhash64("_g")).alias("draws"))
    )
    wanted = F.concat(
        "draws", F.array(F.floor(at_q).cast("bigint"), F.ceil(at_q).cast("bigint"))
    )
    found = data.with_buckets(
        data.buckets.join(drawn.select("_g", "draws"), "_g")
    ).at_ranks(wanted)
    table = found.groupBy("_g").agg(
        F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at")
    )
    part = at_q - F.floor(at_q)

    def between(low: Column, high: Column) -> Column:
        a, b = F.try_element_at("at", low), F.try_element_at("at", high)
        return a + (b - a) * part

    stats = F.transform(
        F.sequence(F.lit(0), F.lit(iters - 1)),
        lambda i: between(F.col("draws")[i], F.col("draws")[i + iters]),
    )
    point = between(F.floor(at_q).cast("bigint"), F.ceil(at_q).cast("bigint"))
    return (
        drawn.join(table, "_g")
        .select("_g", "n", point.alias("value"), F.explode(stats).alias("stat"))
        .groupBy("_g", "n", "value")
        .agg(F.var_samp("stat").alias("var_within"))
        .select(*unpack(keys), "value", "n", "var_within")
    )


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("a", "b", "step")]))
def _order_law(n: pd.Series, r: pd.Series, below: pd.Series, upto: pd.Series) -> pd.DataFrame:
    """Chances that a resample's r-th and next smallest lie at positions (below, upto].

    ``step`` is the chance that exactly r draws lie at or before ``upto``.
    """
    size, rank = n.to_numpy("float64"), r.to_numpy("float64")
    low, low_step = _at_most(below.to_numpy("float64"), size, rank)
    high, step = _at_most(upto.to_numpy("float64"), size, rank)
    return pd.DataFrame({"a": high - low, "b": (high - step) - (low - low_step), "step": step})


def quantile_resampling_law(
    df: DataFrame, keys: Sequence[str], value: Column, q: float, min_n: int = 20
) -> DataFrame:
    """keys, value, n, var_within: exact bootstrap variance of the linear quantile.

    With a and b the r-th and next smallest of a resample and p the part between them,
    the statistic s has s^2 = (1-p) a^2 + p b^2 - p (1-p) (b-a)^2. The masses of a and b
    are differences of regularised incomplete beta values. (b-a)^2 is a sum over pairs of
    gaps k <= l of the sorted values, both inside with chance
    C(n,r) (k/n)^r (1-l/n)^(n-r): a product, so one fold along the values adds it up.

    Only values within 10 standard deviations plus 40 positions of r are kept; less than
    1e-15 of the mass lies outside. An entity of n rows so hands on at most about
    20 sqrt(n q (1-q)) + 80 values. No random numbers are used.
    """
    long = long_values(df, keys, {"v": value}).filter("value IS NOT NULL")
    near = "10 * sqrt(r * (n - r + 1D) / n) + 40"
    rows = (
        ordered(long)
        .ranks()
        .filter(F.col("n") >= min_n)
        .selectExpr(
            "_g", "n", f"CAST(floor({q!r}D * (n - 1)) AS BIGINT) + 1 AS r",
            "CAST(value AS DOUBLE) AS value", "below", "below + cnt AS upto",
        )
        .filter(f"upto >= r - ({near}) AND below <= r + ({near})")
        .withColumn("law", _order_law("n", "r", "below", "upto"))
        .selectExpr("_g", "n", "r", "struct(value, below, upto, law.a, law.b, law.step) AS row")
        .groupBy("_g", "n", "r")
        .agg(F.sort_array(F.collect_list("row")).alias("rows"))
    )
    gaps = """aggregate(slice(rows, 2, size(rows)),
      named_struct('value', rows[0].value, 'upto', rows[0].upto, 'step', rows[0].step, 'run', 0D, 'square', 0D),
      (s, x) -> named_struct('value', x.value, 'upto', x.upto, 'step', x.step,
        'run', pow(s.upto / x.upto, r) * (s.run + x.value - s.value),
        'square', s.square + s.step * (x.value - s.value) * (x.value - s.value + 2D * s.run)),
      s -> s.square)"""

    def moment(mass: str, power: int) -> str:
        gap = " * ".join(["(x.value - low)"] * power)
        return f"aggregate(rows, 0D, (s, x) -> s + x.{mass} * {gap})"

    def mixed(power: int) -> str:
        return f"(1 - part) * {moment('a', power)} + part * {moment('b', power)}"

    return (
        rows.selectExpr(
            "*", f"{q!r}D * (n - 1) - floor({q!r}D * (n - 1)) AS part",
            "filter(rows, x -> x.upto >= r)[0].value AS low",
            "filter(rows, x -> x.upto >= least(r + 1, n))[0].value AS high",
            f"{gaps} AS square",
        )
        .selectExpr("*", f"{mixed(1)} AS m1", f"{mixed(2)} - part * (1 - part) * square AS m2")
        .select(
            *unpack(keys),
            F.expr("low + (high - low) * part").alias("value"),
            "n",
            F.expr("greatest(m2 - m1 * m1, 0D)").alias("var_within"),
        )
    )


def resampled_constants(
    players: DataFrame, context: Sequence[str], min_players: int = 10
) -> DataFrame:
    """Constants from (context, value, n, var_within) rows of resampled entities.

    K is the median over entities of n(1-r)/r with r = vb/(vb+vw).
    """
    players = stage(players)
    group = (
        players.groupBy(key_struct(context))
        .agg(
            F.avg("value").alias("mu"),
            F.var_samp("value").alias("var_obs"),
            F.avg("var_within").alias("var_within"),
            F.count("*").alias("n_players"),
        )
        .withColumn("var_between", _floor(F.col("var_obs") - F.col("var_within"), MIN_VARIANCE))
    )
    # n(1-r)/r = n * vw/vb: vb is one number per context, so the median of n*vw
    # is taken first and divided afterwards, without joining vb back.
    scaled = grouped_quantiles(
        players, context, {"_k": (F.col("n") * F.col("var_within"), 0.5)}, "linear"
    )
    out = (
        group.join(scaled, "_g")
        .withColumn("K", ratio("_k", "var_between"))
        .filter(F.col("n_players") >= min_players)
        .select(*unpack(context), "n_players", "mu", "var_obs", "var_within", "var_between", "K")
    )
    return stabilisation_points(out)


def constants_for(
    df: DataFrame,
    dataset: str,
    keys: Sequence[str],
    context: Sequence[str],
    metrics: Sequence[Metric],
    min_denom: int = 20,
    min_players: int = 10,
    bootstrap_iters: int = 0,
) -> DataFrame:
    """All constants of one dataset, one row per (context, stat).

    Rates and means take one scan each for all statistics. Maxima and quantiles
    follow the exact law of a resample, and only when ``bootstrap_iters`` is positive.
    """
    frames = []
    if any(m.kind == "rate" for m in metrics):
        rates = rate_constants(rate_samples(df, keys, metrics, min_denom), context, min_players)
        frames.append(rates.withColumn("kind", F.lit("rate")))
    if any(m.kind == "mean" for m in metrics):
        means = [m for m in metrics if m.kind == "mean"]
        values = mean_constants(value_samples(df, keys, means, min_denom), context, min_players)
        frames.append(values.withColumn("kind", F.lit("mean")))
    for m in metrics:
        if bootstrap_iters <= 0 or m.kind not in ("max", "quantile"):
            continue
        value = F.expr(m.measured)
        if m.kind == "max":
            players = max_resampling_variance(df, keys, value, min_denom)
        else:
            players = quantile_resampling_law(df, keys, value, m.q, min_denom)
        frames.append(
            resampled_constants(players, context, min_players)
            .withColumn("stat", F.lit(m.name))
            .withColumn("kind", F.lit(m.kind))
        )
    if not frames:
        raise ValueError(f"no metric of {dataset} has stability constants")
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    for c in CONSTANT_COLUMNS:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("double"))
    return out.select(
        F.lit(dataset).alias("dataset"), "stat", "kind", *context, *CONSTANT_COLUMNS
    )
