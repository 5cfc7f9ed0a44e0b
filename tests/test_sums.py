"""Means by exact sums: order, grain and the full range of doubles."""

import math
import random
from fractions import Fraction

import pytest

from ratebook.operators import metrics as M
from ratebook.operators import sums

SPEC = [M.mean("m", "v"), M.mean("half", "v", where="v > 0", parts=True)]


def means(spark, values, keys=("g",)):
    df = spark.createDataFrame([(g, f"s{i % 3}", v) for i, (g, v) in enumerate(values)], "g string, s string, v double")
    return {r["g"]: r for r in M.aggregate(df, list(keys), SPEC).collect()}


@pytest.mark.parametrize(
    ("values", "want"),
    [
        ([1.0, math.inf], math.inf),
        ([math.inf, -math.inf], math.nan),
        ([1e-13, 3e-13], 2e-13),
        ([1e17, 3e17], 2e17),
        ([1e300, 1e300, -1e300, 5.0], 2.5e299),
        ([5e-324, None], 5e-324),
        ([-0.75, 0.25], -0.25),
        ([-1.5, -1e-7], -0.75000005),
        ([None, float("nan")], None),
        ([float("nan"), 4.0], 4.0),
        ([0.0, -0.0], 0.0),
    ],
)
def test_mean_over_the_whole_range(spark, values, want):
    got = means(spark, [("a", v) for v in values])["a"]["m"]
    if want is None or math.isnan(want) or math.isinf(want):
        assert str(got) == str(want)
    else:
        assert got == pytest.approx(want, rel=1e-14, abs=0)


def test_sum_is_the_nearest_double_in_any_order_and_at_any_grain(spark):
    r = random.Random(4)
    values = [r.choice([r.uniform(-1, 1), r.uniform(0, 1e-5), r.uniform(-1e7, 1e7), r.uniform(-1e15, 1e15), 0.1, -0.3]) for _ in range(4000)]
    values = [v for v in values if abs(v) >= sums.LEAST]
    seen = set()
    for _ in range(3):
        r.shuffle(values)
        df = spark.createDataFrame([("a", f"s{i % 7}", v) for i, v in enumerate(values)], "g string, s string, v double").repartition(r.randrange(2, 9))
        seen.add(M.aggregate(df, ["g"], SPEC).first()["m"])
        seen.add(M.roll_up(M.partials(df, ["g", "s"], SPEC), ["g"], SPEC).first()["m"])
    exact = sum(map(Fraction, values))
    assert len(seen) == 1
    assert math.isclose(seen.pop(), float(exact) / len(values), rel_tol=3e-16)


def test_equal_totals_of_unlike_values_are_equal(spark):
    rows = [("a", 0.5), ("a", 0.5), ("b", 1.5), ("b", -0.5), ("c", 1.25), ("c", -0.25), ("d", 2.0**-20 + 1), ("d", -(2.0**-20))]
    assert {r["m"] for r in means(spark, rows).values()} == {0.5}


def test_text_of_a_prepared_value_is_shared(spark):
    df = spark.createDataFrame([(1.0,), (2.5,)], "v double")
    twice = sums.prepared(df, ["v", " v "])
    assert twice.selectExpr(sums.exact_sum("v") + " AS s").first()["s"] == 3.5 and len(twice.columns) == 3
