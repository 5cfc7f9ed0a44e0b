"""Models that are tables of numbers, as column expressions (M2, M3, P33).

A linear, logistic or tree-table model comes with its own feature list, its categories
and its fill values. It becomes one expression inside whole-stage code: no Python
worker sees a row, and unused columns are never read.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"


@dataclass(frozen=True)
class TableModel:
    """Weights of numeric features and of levels of categories, plus trees.

    ``trees`` are nested mappings: a leaf ``{"value": v}``; a split ``{"feature": f,
    "below": t, "yes": .., "no": ..}`` or ``{"feature": f, "in": [levels], ..}``.

    A numeric feature that is NULL, NaN or no column counts as its entry in ``medians``;
    without one it adds nothing to the weighted sum and goes ``yes`` at a split, as if it
    were smaller than any number. A category that is NULL or no column is the level
    ``unknown``; a level without a weight adds nothing and goes ``no``.
    """

    features: Sequence[str]
    categorical: Sequence[str] = ()
    weights: Mapping[str, float] = field(default_factory=dict)
    levels: Mapping[str, Mapping[str, float]] = field(default_factory=dict)
    trees: Sequence[Mapping] = ()
    medians: Mapping[str, float] = field(default_factory=dict)
    intercept: float = 0.0
    link: str = "identity"

    def __post_init__(self) -> None:
        named = {*self.weights, *self.levels, *(f for t in self.trees for f in _named(t))}
        if lost := sorted(named - set(self.features)):
            raise ValueError(f"not in the model's feature list: {lost}")
        if wrong := sorted(set(self.levels) - set(self.categorical) | set(self.weights) & set(self.categorical)):
            raise ValueError(f"numeric and categorical features mixed up: {wrong}")
        if self.link not in ("identity", "logistic"):
            raise ValueError(f"unknown link {self.link!r}")

    @classmethod
    def from_json(cls, text: str) -> TableModel:
        given = json.loads(text)
        if "categorical_features" in given:
            given["categorical"] = given.pop("categorical_features")
        known = cls.__dataclass_fields__
        return cls(**{k: v for k, v in given.items() if k in known})


def _named(tree: Mapping) -> list[str]:
    if "value" in tree:
        return []
    return [tree["feature"], *_named(tree["yes"]), *_named(tree["no"])]


def compiled(df: DataFrame, model: TableModel) -> Column:
    """The model's output over the rows of ``df``."""
    present = set(df.columns)

    def category(name: str) -> Column:
        own = F.col(f"`{name}`").cast("string") if name in present else F.lit(None).cast("string")
        return F.coalesce(own, F.lit(UNKNOWN))

    def number(name: str) -> Column:
        own = F.col(f"`{name}`").cast("double") if name in present else F.lit(None).cast("double")
        fill = model.medians.get(name)
        return F.coalesce(F.nullif(own, F.lit(float("nan"))), F.lit(fill).cast("double"))

    def leaf(tree: Mapping) -> Column:
        if "value" in tree:
            return F.lit(float(tree["value"]))
        name = tree["feature"]
        if "in" in tree:
            goes = category(name).isin(list(tree["in"]))
        else:
            goes = F.coalesce(number(name) < F.lit(float(tree["below"])), F.lit(True))
        return F.when(goes, leaf(tree["yes"])).otherwise(leaf(tree["no"]))

    def level(name: str) -> Column:
        weights = model.levels[name].items()
        chain = reduce(lambda c, x: c.when(category(name) == x[0], F.lit(float(x[1]))), weights, F)
        return chain.otherwise(F.lit(0.0)) if weights else F.lit(0.0)

    terms = [F.lit(float(model.intercept))]
    terms += [F.lit(float(w)) * F.coalesce(number(f), F.lit(0.0)) for f, w in model.weights.items()]
    terms += [level(f) for f in model.levels]
    terms += [leaf(t) for t in model.trees]
    total = reduce(add, terms)
    if model.link == "logistic":
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))
    return total
