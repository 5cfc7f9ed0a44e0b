"""Empirical-Bayes shrinkage of entity statistics toward their context mean."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ratio
from .joins import attach
from .metrics import Metric, aggregate
from .ordered import key_struct
from .relational import union_diagonal
from .staging import stage

CONTEXT_KEYS = ["level_id", "pitch_tag", "season"]


def _guarded(raw: Column, reg: Column) -> Column:
    k = F.col("K")
    usable = k.isNotNull() & F.col("mu").isNotNull() & (k != 0)
    return F.when(usable, reg).otherwise(raw)


def shrunk_rate(num: Column, den: Column) -> Column:
    """(num + K mu) / (den + K); the raw rate when K is 0 or a constant is NULL."""
    k, mu = F.col("K"), F.col("mu")
    return _guarded(ratio(num, den), ratio(num + k * mu, den + k))


def shrunk_value(raw: Column, n: Column) -> Column:
    k, mu = F.col("K"), F.col("mu")
    return _guarded(raw, ratio(raw * n + k * mu, n + k))


def with_constants(long: DataFrame, constants: DataFrame, dataset: str) -> DataFrame:
    """Add mu and K by (stat + the context keys both sides have).

    Without a common context key the join is on the statistic alone. Context
    keys that are NULL throughout the constants (pooled seasons) are not keys.
    """
    own = constants.filter(F.col("dataset") == dataset)
    on = [c for c in CONTEXT_KEYS if c in constants.columns and c in long.columns]
    if on:
        filled = own.agg(*[F.count(c).alias(c) for c in on]).first()
        on = [c for c in on if filled[c]]
    return attach(long, own.select("stat", *on, "mu", "K"), ["stat", *on])


def rate_cells(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """keys, stat, num, n from published ``_num``/``_den`` columns, n > 0."""
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("stat"),
                F.col(f"{n}_num").cast("double").alias("num"),
                F.col(f"{n}_den").cast("bigint").alias("n"),
            )
            for n in names
        ]
    )
    return df.select(*keys, F.inline(rows)).filter(F.col("n") > 0)


def value_cells(df: DataFrame, keys: Sequence[str], scales: dict[str, float]) -> DataFrame:
    """keys, stat, value, n from published ``name``/``name_n``; value / scale."""
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("stat"),
                (F.col(n).cast("double") / F.lit(float(s))).alias("value"),
                F.col(f"{n}_n").cast("bigint").alias("n"),
            )
            for n, s in scales.items()
        ]
    )
    return df.select(*keys, F.inline(rows)).filter(F.col("n") > 0)


def shrink_long(
    cells: DataFrame, constants: DataFrame, dataset: str, percent_means: Sequence[str] = ()
) -> DataFrame:
    """Long result: keys, stat, num, n, raw, reg, mu, K with rates in percent.

    ``cells`` holds rate rows (``num`` set) and value rows (``value`` set).
    """
    c = with_constants(cells, constants, dataset)
    is_rate = F.col("num").isNotNull()
    raw = F.when(is_rate, ratio("num", "n")).otherwise(F.col("value"))
    reg = F.when(is_rate, shrunk_rate(F.col("num"), F.col("n"))).otherwise(
        shrunk_value(F.col("value"), F.col("n"))
    )
    hundred = is_rate | F.col("stat").isin(list(percent_means))
    scale = F.when(hundred, F.lit(100.0)).otherwise(F.lit(1.0))
    return c.withColumns({"raw": raw * scale, "reg": reg * scale}).drop("value")


def shrink_wide(
    long: DataFrame, base: DataFrame, keys: Sequence[str], stats: Sequence[str]
) -> DataFrame:
    """One ``_n``/``_raw``/``_reg`` triple per statistic, left-joined to ``base``."""
    pick = lambda s, c: F.max(F.when(F.col("stat") == s, F.col(c)))
    cells = [
        pick(s, c).alias(f"{s}_{c}") for s in stats for c in ("num", "n", "raw", "reg")
    ]
    wide = long.groupBy(key_struct(keys)).agg(*cells)
    return base.withColumn("_g", key_struct(keys)).join(wide, "_g", "left").drop("_g")


def fact_cells(df: DataFrame, keys: Sequence[str], metrics: Sequence[Metric]) -> DataFrame:
    """Rate and value cells of every metric from the rows, in one aggregate."""
    rates = [m for m in metrics if m.kind == "rate"]
    values = [m for m in metrics if m.kind in ("mean", "max", "quantile")]
    plain = [
        Metric(**{**m.__dict__, "parts": True, "scale": 1.0, "n": None}) for m in rates + values
    ]
    wide = stage(aggregate(df, keys, plain))
    frames = []
    if rates:
        frames.append(rate_cells(wide, keys, [m.name for m in rates]))
    if values:
        frames.append(value_cells(wide, keys, {m.name: 1.0 for m in values}))
    out = union_diagonal(frames)
    for c, t in (("num", "double"), ("value", "double")):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast(t))
    return out


def difference(df: DataFrame, name: str, left: str, right: str, *minus: str) -> DataFrame:
    """``name_raw``/``name_reg`` = left - right [- columns], where both exist."""
    for kind in ("raw", "reg"):
        a, b = f"{left}_{kind}", f"{right}_{kind}"
        if a in df.columns and b in df.columns:
            value = F.col(a) - F.col(b)
            for c in minus:
                if c in df.columns:
                    value = value - F.col(c)
            df = df.withColumn(f"{name}_{kind}", value)
    return df


def contact_baseline(table: DataFrame, group: Sequence[str] = ("season", "level_id")) -> DataFrame:
    """League expected minus actual whiff percentage, both in percent.

    Means enter weighted by their n; a NULL mean keeps its weight.
    """
    expected = F.lit(100.0) * ratio(
        F.sum(F.col("pred_whiff_loc_mean") * F.col("pred_whiff_loc_mean_n")),
        F.sum("pred_whiff_loc_mean_n"),
    )
    actual = F.lit(100.0) * ratio(F.sum("whiff_rate_num"), F.sum("whiff_rate_den"))
    return table.groupBy(*group).agg((expected - actual).alias("lg_contact_baseline"))
