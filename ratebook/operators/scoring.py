"""Row scoring with Python model objects, and model evaluation.

A model is any object with ``predict`` or ``predict_proba`` over a pandas frame.
It is broadcast once per executor, and batches reach it through Arrow.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.domain import two_way_code
from ..functions.scalar import finite_or, ratio
from .context import add_pitch_contexts


def _predict(model: object, frame: pd.DataFrame) -> np.ndarray:
    """Probability of the second class, or the plain prediction."""
    if hasattr(model, "predict_proba"):
        return np.asarray(model.predict_proba(frame), dtype="float64")[:, 1]
    return np.asarray(model.predict(frame), dtype="float64")


def prediction(
    df: DataFrame,
    model: object,
    features: Sequence[str],
    categorical: Sequence[str] = (),
    where: Column | None = None,
    missing_category: str = "unknown",
    sources: Mapping[str, Column] | None = None,
) -> Column:
    """The model's output as a column of ``df``.

    Numeric features arrive as doubles (NULL and absent ones as NaN),
    categorical ones as strings (NULL and absent ones as ``missing_category``).
    With ``where``, only matching rows get a value; others are NULL. Results are
    row-aligned: rows outside ``where`` are left out of the model call inside
    their own batch.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = list(features)
    cats = set(categorical)
    given = dict(sources or {})

    def source(f: str) -> Column:
        if f in given:
            return given[f].cast("double").alias(f)
        if f in cats:
            c = F.col(f).cast("string") if f in df.columns else F.lit(None).cast("string")
            return F.coalesce(c, F.lit(missing_category)).alias(f)
        c = F.col(f).cast("double") if f in df.columns else F.lit(None).cast("double")
        return c.alias(f)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        model_ = shared.value
        for batch in batches:
            keep = batch["__use"].to_numpy(dtype=bool)
            out = np.full(len(batch), np.nan)
            if keep.any():
                out[keep] = _predict(model_, batch.loc[keep, names])
            series = pd.Series(out, dtype="Float64")
            series[~keep | np.isnan(out)] = pd.NA
            yield series

    use = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return score(F.struct(*[source(f) for f in names], use.alias("__use")))


def score(
    df: DataFrame, name: str, model: object | None, features: Sequence[str], **kw: object
) -> DataFrame:
    """Add column ``name``; a missing model leaves it as typed NULL."""
    if model is None:
        if name in df.columns:
            return df
        return df.withColumn(name, F.lit(None).cast("double"))
    return df.withColumn(name, prediction(df, model, features, **kw))


def location_adjusted(
    df: DataFrame, model: object | None, features: Sequence[str] = ("z", "pitch_velo")
) -> DataFrame:
    """``loc_adj_vaa`` = vaa - model(location); plain vaa without a model."""
    if model is None:
        return df.withColumn("loc_adj_vaa", F.col("vaa").cast("double"))
    return df.withColumn("loc_adj_vaa", F.col("vaa") - prediction(df, model, features))


def signed_decision(raw: Column | str, swing: Column | str) -> Column:
    """The model's value, negated where the batter did not swing."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    swing = F.col(swing) if isinstance(swing, str) else swing
    return F.when(~swing, -raw).otherwise(raw)


# Feature lists of the published models.
WHIFF_FEATURES = [
    "avg_release_z", "avg_release_x", "avg_ext", "pitch_velo", "rpm", "vbreak",
    "hbreak", "axis", "spin_efficiency", "z_angle_release", "x_angle_release",
    "vaa", "haa", "primary_velo", "primary_loc_adj_vaa", "primary_z_release",
    "primary_x_release", "primary_rpm", "primary_axis", "x", "z",
]
WHIFF_CATEGORIES = ["balls", "strikes", "throws", "stands"]
STUFF_FEATURES = [
    "avg_release_z", "avg_release_x", "avg_ext", "pitch_velo", "rpm", "inf_rpm",
    "vbreak", "hbreak", "axis", "inf_axis", "spin_efficiency", "z_angle_release",
    "x_angle_release", "loc_adj_vaa", "haa", "primary_velo", "primary_vbreak",
    "primary_hbreak", "primary_loc_adj_vaa", "primary_z_release",
    "primary_x_release", "primary_rpm", "primary_axis", "throws", "stands",
]
STUFF_CATEGORIES = ["throws", "stands"]
DAMAGE_FEATURES = ["exit_velo", "launch_angle", "spray_angle_adj"]
DAMAGE_SURFACE_FEATURES = ["spray_angle_adj_full", "launch_angle_full"]
DECISION_FEATURES = [
    "balls", "strikes", "x", "z", "pitch_velo", "vaa", "haa", "stands", "throws",
]


@dataclass(frozen=True)
class Models:
    """Model objects of the scoring chain; each may be missing."""

    location: object | None = None
    whiff_location: object | None = None
    whiff_base: object | None = None
    damage: object | None = None
    decision: object | None = None
    stuff: object | None = None
    damage_is_surface: bool = False


def _features_of(model: object, default: Sequence[str]) -> list[str]:
    return list(getattr(model, "feature_names_in_", default))


def score_chain(df: DataFrame, models: Models) -> DataFrame:
    """Location adjustment, contexts, whiff, damage, decision and stuff in order."""
    df = location_adjusted(df, models.location, _features_of(models.location, ["z", "pitch_velo"]))
    df = add_pitch_contexts(df)
    categories = WHIFF_CATEGORIES
    df = df.drop("pred_whiff_loc", "pred_whiff_base", "damage_pred", "decision_value", "stuff_raw")
    df = score(
        df,
        "pred_whiff_loc",
        models.whiff_location,
        [*WHIFF_FEATURES, *categories],
        categorical=categories,
    )
    df = score(
        df,
        "pred_whiff_base",
        models.whiff_base,
        [*(f for f in WHIFF_FEATURES if f not in ("x", "z")), *categories],
        categorical=categories,
    )
    if models.damage_is_surface:
        df = df.withColumns(
            {
                "spray_angle_adj_full": finite_or("spray_angle_adj"),
                "launch_angle_full": finite_or("launch_angle"),
            }
        )
        df = score(df, "damage_pred", models.damage, DAMAGE_SURFACE_FEATURES)
    else:
        df = score(
            df,
            "damage_pred",
            models.damage,
            _features_of(models.damage, DAMAGE_FEATURES),
            where=F.col("is_in_play"),
        )
    if models.decision is None:
        raw = F.lit(None).cast("double")
    else:
        raw = prediction(
            df,
            models.decision,
            _features_of(models.decision, DECISION_FEATURES),
            sources={c: two_way_code(c) for c in ("stands", "throws")},
        )
    df = df.withColumn("decision_value_raw", raw).withColumn(
        "decision_value", signed_decision("decision_value_raw", "swing")
    )
    return score(
        df,
        "stuff_raw",
        models.stuff,
        STUFF_FEATURES,
        categorical=STUFF_CATEGORIES,
    )


def evaluate(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """rmse, r2, mae, correlation, n over the rows that have both values.

    One pass: the total sum of squares is n times the population variance.
    """
    pairs = df.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    err = y - p
    return (
        pairs.groupBy(*keys)
        .agg(
            F.sqrt(F.avg(err * err)).alias("rmse"),
            (F.lit(1.0) - ratio(F.sum(err * err), F.count("*") * F.var_pop(y))).alias("r2"),
            F.avg(F.abs(err)).alias("mae"),
            F.corr(y, p).alias("correlation"),
            F.count("*").alias("n"),
        )
    )


class LinearModel:
    """Weighted sum of features; NaN inputs count as 0."""

    def __init__(self, weights: Mapping[str, float], intercept: float) -> None:
        self.weights, self.intercept = dict(weights), intercept
        self.feature_names_in_ = list(weights)

    def predict(self, frame: pd.DataFrame) -> np.ndarray:
        out = np.full(len(frame), self.intercept)
        for name, w in self.weights.items():
            out += w * frame[name].fillna(0.0).to_numpy(dtype="float64")
        return out


class LogisticModel(LinearModel):
    """Two-class probabilities of a linear score."""

    def predict_proba(self, frame: pd.DataFrame) -> np.ndarray:
        p = 1.0 / (1.0 + np.exp(-self.predict(frame)))
        return np.column_stack([1.0 - p, p])
