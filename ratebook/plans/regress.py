"""Stability constants and regressed tables of the three datasets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import attach
from ..operators.metrics import Metric, rate, round_floats
from ..operators.ordered import key_struct, unpack
from ..operators.relational import union_diagonal, widen_numbers
from ..operators.shrink import (
    contact_baseline,
    difference,
    fact_cells,
    rate_cells,
    shrink_long,
    shrink_wide,
    value_cells,
)
from ..operators.stability import constants_for
from ..operators.staging import lying
from . import specs as S

CONTEXT = {
    "hitters": ["level_id"],
    "pitchers": ["level_id"],
    "pitch_types": ["level_id", "pitch_tag"],
}


def stability_constants(
    pitch: DataFrame,
    datasets: Mapping[str, Sequence[Metric]] | None = None,
    by_season: bool = False,
    min_denom: int = 20,
    min_players: int = 10,
    bootstrap_iters: int = 0,
) -> DataFrame:
    """One row per (dataset, statistic, context)."""
    frames = []
    for dataset, metrics in (datasets or S.REGRESSED).items():
        context = (["season"] if by_season else []) + CONTEXT[dataset]
        frames.append(
            constants_for(
                pitch, dataset, S.REGRESSED_KEYS[dataset], context, metrics,
                min_denom, min_players, bootstrap_iters,
            )
        )
    return union_diagonal(frames)


def _entities(pitch: DataFrame, dataset: str) -> DataFrame:
    """Keys plus descriptive columns, the smallest value where they vary."""
    keys = S.REGRESSED_KEYS[dataset]
    meta = [F.min(c).alias(c) for c in S.REGRESSED_META[dataset] if c in pitch.columns]
    placed = lying(pitch, keys)
    if placed is not None:
        return placed.groupBy(*keys).agg(*meta or [F.count("*")]).select(*keys, *[c for c in S.REGRESSED_META[dataset] if c in pitch.columns])
    return pitch.groupBy(key_struct(keys)).agg(*meta or [F.count("*")]).select(
        *unpack(keys), *[c for c in S.REGRESSED_META[dataset] if c in pitch.columns]
    )


_WHIFF_RATE = rate("whiff_rate", "whiff", "swing")


def _finish(wide: DataFrame, dataset: str, places: int | None, *minus: str) -> DataFrame:
    if dataset == "hitters":
        wide = difference(wide, "SEAGER", "selection_skill", "hittable_pitches_taken")
        wide = difference(wide, "contact_vs_avg", "pred_whiff_loc_mean", "whiff_rate", *minus)
        wide = wide.drop(*[c for c in wide.columns if c.startswith("whiff_rate_")])
    return wide if places is None else round_floats(wide, places)


def _stats(metrics: Sequence[Metric]) -> list[str]:
    return [m.name for m in metrics if m.kind != "derived"]


def regress_facts(
    pitch: DataFrame,
    constants: DataFrame,
    dataset: str,
    metrics: Sequence[Metric] | None = None,
    places: int | None = 1,
) -> tuple[DataFrame, DataFrame]:
    """(wide, long) regressed statistics computed from the rows."""
    metrics = list(metrics or S.REGRESSED[dataset])
    keys = S.REGRESSED_KEYS[dataset]
    used = [*metrics, _WHIFF_RATE] if dataset == "hitters" else metrics
    cells = fact_cells(pitch, keys, used)
    # Not written: many rows, of which a caller reads the wide or the long form.
    full = shrink_long(cells, constants, dataset, sorted(S.PERCENT_MEANS))
    wide = shrink_wide(full, _entities(pitch, dataset), keys, _stats(used))
    values = [m.name for m in used if m.kind != "rate" and m.kind != "derived"]
    wide = wide.drop(*[f"{v}_num" for v in values])
    long = full.filter(F.col("stat") != _WHIFF_RATE.name).select(
        *keys, F.lit(dataset).alias("dataset"), "stat", "num", "n", "raw", "reg", "mu", "K"
    )
    long = widen_numbers(long)
    return (
        _finish(wide, dataset, places),
        long if places is None else round_floats(long, places),
    )


def regression_long(
    pitch: DataFrame,
    constants: DataFrame,
    datasets: Sequence[str] = tuple(S.REGRESSED),
    places: int | None = 1,
) -> DataFrame:
    """The long tables of all datasets, stacked by column name."""
    return union_diagonal([regress_facts(pitch, constants, d, places=places)[1] for d in datasets])


def regress_table(
    table: DataFrame,
    constants: DataFrame,
    dataset: str,
    keys: Sequence[str],
    metrics: Sequence[Metric] | None = None,
    places: int | None = 1,
) -> DataFrame:
    """Regressed statistics of a published table; the facts are not read.

    Statistics whose published parts are missing are left out. The published
    percent means are brought to proportions first; ``pred_whiff_loc_mean`` is
    published as a proportion already.
    """
    metrics = list(metrics or S.REGRESSED[dataset])
    have = set(table.columns)
    rates = [m.name for m in metrics if m.kind == "rate" and {f"{m.name}_num", f"{m.name}_den"} <= have]
    if dataset == "hitters" and {"whiff_rate_num", "whiff_rate_den"} <= have:
        rates.append(_WHIFF_RATE.name)
    in_percent = S.PERCENT_MEANS - {"pred_whiff_loc_mean"}
    scales = {
        m.name: 100.0 if m.name in in_percent else 1.0
        for m in metrics
        if m.kind in ("mean", "max", "quantile") and {m.name, f"{m.name}_n"} <= have
    }
    frames = []
    if rates:
        frames.append(rate_cells(table, keys, rates).withColumn("value", F.lit(None).cast("double")))
    if scales:
        frames.append(value_cells(table, keys, scales).withColumn("num", F.lit(None).cast("double")))
    long = shrink_long(union_diagonal(frames), constants, dataset, sorted(S.PERCENT_MEANS))
    base = table.select(*keys).distinct()
    stats = [*rates, *scales]
    wide = shrink_wide(long, base, keys, stats).drop(*[f"{s}_num" for s in stats])
    if dataset == "hitters" and {"pred_whiff_loc_mean", "whiff_rate_num"} <= have:
        wide = attach(wide, contact_baseline(table), ["season", "level_id"])
        return _finish(wide, dataset, places, "lg_contact_baseline")
    return _finish(wide, dataset, places)
