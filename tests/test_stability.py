"""Resampling laws against plain resampling, and constants against numpy."""

from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratebook.operators import metrics as M
from ratebook.operators import stability as ST
from ratebook.operators.beta import at_most
from ratebook.operators.shrink import with_constants


def values(spark, arrays):
    rows = [(i, float(v)) for i, a in enumerate(arrays) for v in a]
    return spark.createDataFrame(rows, "id long, v double")


ARRAYS = [np.round(np.random.default_rng(i).normal(90, 8, 30 + 10 * i), 1) for i in range(4)]


def test_max_law_matches_resampling(spark):
    got = {r["id"]: r for r in ST.max_resampling_variance(values(spark, ARRAYS), ["id"], F.col("v")).collect()}
    rng = np.random.default_rng(11)
    for i, a in enumerate(ARRAYS):
        draws = rng.choice(a, (20000, len(a))).max(axis=1)
        assert got[i]["value"] == a.max() and got[i]["n"] == len(a)
        assert got[i]["var_within"] == pytest.approx(draws.var(ddof=1), rel=0.1, abs=1e-3)


def test_quantile_law_matches_resampling(spark):
    df = values(spark, ARRAYS)
    got = {
        r["id"]: r
        for r in ST.quantile_resampling_variance(df, ["id"], F.col("v"), 0.9, 4000).collect()
    }
    again = ST.quantile_resampling_variance(df.repartition(5), ["id"], F.col("v"), 0.9, 4000).collect()
    rng = np.random.default_rng(11)
    for i, a in enumerate(ARRAYS):
        draws = np.quantile(rng.choice(a, (20000, len(a))), 0.9, axis=1)
        assert got[i]["value"] == pytest.approx(np.quantile(a, 0.9))
        assert got[i]["var_within"] == pytest.approx(draws.var(ddof=1), rel=0.12)
    for r in again:
        assert r["var_within"] == pytest.approx(got[r["id"]]["var_within"], rel=1e-9)


def test_exact_quantile_law(spark):
    ties = [np.array([1.0] * 19 + [5.0] * 11), np.full(25, 3.0), np.arange(20.0) ** 2]
    arrays = [*ARRAYS, *ties]
    rng = np.random.default_rng(3)
    for q in (0.0, 0.1, 0.5, 0.9, 1.0):
        rows = ST.quantile_resampling_law(values(spark, arrays), ["id"], F.col("v"), q).collect()
        got = {r["id"]: r for r in rows}
        assert len(rows) == len(arrays)
        for i, a in enumerate(arrays):
            draws = np.quantile(rng.choice(a, (20000, len(a))), q, axis=1)
            assert got[i]["value"] == pytest.approx(np.quantile(a, q)) and got[i]["n"] == len(a)
            assert got[i]["var_within"] == pytest.approx(draws.var(ddof=1), rel=0.12, abs=2e-2)


def test_order_law_against_whole_number_sums():
    for n in (1, 2, 20, 61):
        for r in {1, (n + 1) // 2, n}:
            least, exact = at_most(np.arange(n + 1.0), np.full(n + 1, float(n)), np.full(n + 1, float(r)))
            for k in range(n + 1):
                chances = [comb(n, m) * k**m * (n - k) ** (n - m) / n**n for m in range(n + 1)]
                assert least[k] == pytest.approx(sum(chances[r:]), rel=1e-11, abs=1e-15)
                assert exact[k] == pytest.approx(chances[r], rel=1e-11, abs=1e-15)


def test_order_law_of_a_large_group():
    n, r = 1e7, 9e6
    step = np.sqrt(r * (n - r) / n)
    least, _ = at_most(r + step * np.array([-12.0, 0.0, 12.0]), np.full(3, n), np.full(3, r))
    assert least[0] < 1e-15 and least[1] == pytest.approx(0.5, abs=1e-3) and 1 - least[2] < 1e-15


def test_small_entities_are_left_out(spark):
    df = values(spark, [np.arange(19.0), np.arange(20.0)])
    assert [r["id"] for r in ST.max_resampling_variance(df, ["id"], F.col("v")).collect()] == [1]


def test_rate_constants_recover_a_beta_prior(spark):
    rng = np.random.default_rng(5)
    rows = []
    for player, p in enumerate(rng.beta(6, 14, 400)):
        rows += [(player, bool(x)) for x in rng.random(200) < p]
    df = spark.createDataFrame(rows, "id long, hit boolean")
    samples = ST.rate_samples(df, ["id"], [M.rate("r", "hit")])
    c = ST.rate_constants(samples, []).first()
    assert c["K"] == pytest.approx(20, rel=0.25) and c["mu"] == pytest.approx(0.3, abs=0.02)
    assert c["n_70"] == pytest.approx(c["K"] * 7 / 3) and c["n_players"] == 400


def test_too_few_players_give_no_constants(spark):
    df = spark.createDataFrame([(i, True) for i in range(5) for _ in range(30)], "id long, hit boolean")
    samples = ST.rate_samples(df, ["id"], [M.rate("r", "hit")])
    assert ST.rate_constants(samples, []).count() == 0


def test_pooled_constants_have_null_keys(spark):
    long = spark.createDataFrame([("s", 2024, 1, 3.0)], "stat string, season long, level_id long, num double")
    pooled = spark.createDataFrame([("d", "s", None, None, 0.5, 10.0)], "dataset string, stat string, season long, level_id long, mu double, K double")
    row = with_constants(long, pooled, "d").first()
    assert (row["mu"], row["K"]) == (0.5, 10.0)
