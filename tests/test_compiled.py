"""Compiled models against a plain evaluation of each row."""

import json
import math

import pytest

from ratebook.operators.compiled import TableModel, compiled

MODEL = {
    "features": ["v", "w", "absent", "hand", "gone"],
    "categorical_features": ["hand", "gone"],
    "boruta_selected_features": ["v"],
    "weights": {"v": 2.0, "absent": 7.0},
    "levels": {"hand": {"L": 1.0, "unknown": -3.0}, "gone": {"unknown": 0.5}},
    "trees": [
        {"feature": "v", "below": 1.5, "yes": {"value": 10}, "no": {"feature": "hand", "in": ["L", "S"], "yes": {"value": 20}, "no": {"value": 30}}},
        {"feature": "w", "below": 0, "yes": {"value": 100}, "no": {"value": 200}},
    ],
    "medians": {"w": 4.0},
    "intercept": 0.25,
}
ROWS = [(1, 1.0, -1.0, "L"), (2, 2.0, None, None), (3, None, 3.0, "Q"), (4, float("nan"), float("nan"), "S"), (5, 3.0, -2.0, "S")]
WANT = {
    1: 0.25 + 2 + 1 + 0.5 + 10 + 100,
    2: 0.25 + 4 - 3 + 0.5 + 30 + 200,
    3: 0.25 + 0 + 0 + 0.5 + 10 + 200,
    4: 0.25 + 0 + 0 + 0.5 + 10 + 200,
    5: 0.25 + 6 + 0 + 0.5 + 20 + 100,
}


def test_every_kind_of_gap(spark):
    df = spark.createDataFrame(ROWS, "id long, v double, w double, hand string")
    model = TableModel.from_json(json.dumps(MODEL))
    out = df.select("id", compiled(df, model).alias("s"))
    assert {r["id"]: r["s"] for r in out.collect()} == WANT
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert df.limit(0).select(compiled(df, model).alias("s")).collect() == []


def test_logistic_link_and_clashing_names(spark):
    df = spark.createDataFrame([(1, 2.0)], "id long, `a.b` double")
    model = TableModel(["a.b"], weights={"a.b": 0.5}, intercept=-2.0, link="logistic")
    assert df.select(compiled(df, model).alias("s")).first()["s"] == pytest.approx(1 / (1 + math.exp(1)))


@pytest.mark.parametrize(
    "given",
    [
        {"features": ["a"], "weights": {"b": 1.0}},
        {"features": ["a"], "levels": {"a": {"x": 1.0}}},
        {"features": ["a"], "link": "probit"},
    ],
)
def test_contradicting_models_fail(given):
    with pytest.raises(ValueError):
        TableModel(**given)
