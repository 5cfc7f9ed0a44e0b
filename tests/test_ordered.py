"""The distributed rank operators against brute force, with forced bucketing."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ratebook.operators import ordered as O
from ratebook.operators import percentiles as P
from ratebook.operators import sampling as SA


@pytest.fixture(autouse=True)
def small_buckets(monkeypatch):
    """Edges from every second row, so that even small groups span many buckets."""
    monkeypatch.setattr(O, "ROWS_PER_SPLITTER", 2)


@pytest.fixture(scope="module")
def table():
    """One hot group with a third of all rows, ties, NULLs, NULL keys, a constant group."""
    rng = np.random.default_rng(3)
    n = 3000
    g = np.where(rng.random(n) < 0.35, "hot", rng.choice(["a", "b", "c", "flat", None], n))
    v = np.round(rng.normal(50, 20, n), 1)
    v[rng.random(n) < 0.2] = 42.0
    pdf = pd.DataFrame({"id": np.arange(n), "g": g, "v": v, "w": rng.random(n)})
    pdf.loc[rng.random(n) < 0.1, "v"] = np.nan
    pdf.loc[pdf.g == "flat", "v"] = 2.0
    return pdf


def frame(spark, pdf):
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "id long, g string, v double, w double")
    return df


@pytest.mark.parametrize("q", [0.0, 0.01, 0.5, 0.9, 1.0])
def test_quantiles(spark, table, q):
    df = frame(spark, table)
    near = O.grouped_quantiles(df, ["g"], {"x": (F.col("v"), q)}, O.NEAREST).select("_g.g", "x")
    lin = O.grouped_quantiles(df, ["g"], {"x": (F.col("v"), q), "y": (F.col("w"), q)}, O.LINEAR)
    got_near, got_lin = dict(near.collect()), {r[0]: (r[1], r[2]) for r in lin.select("_g.g", "x", "y").collect()}
    for name, part in table.groupby("g", dropna=False):
        key = None if pd.isna(name) else name
        values = np.sort(part.v.dropna().to_numpy())
        assert got_near[key] == values[int(np.floor((len(values) - 1) * q + 0.5))]
        assert got_lin[key][0] == pytest.approx(np.quantile(values, q), abs=1e-12)
        assert got_lin[key][1] == pytest.approx(np.quantile(part.w, q), abs=1e-12)


def test_buckets_are_used(spark, table):
    data = O.ordered(O.long_values(frame(spark, table), ["g"], {"v": F.col("v")}), splitters=16)
    used = data.rows.select("bucket").distinct().count()
    assert 8 <= used <= 18


@pytest.mark.parametrize("splitters", [1, 7, 1024])
def test_average_rank(spark, table, splitters):
    long = O.long_values(frame(spark, table), ["g"], {"v": F.col("v")})
    ranks = O.ordered(long, splitters).average_rank().filter("value IS NOT NULL")
    got = {(r["g"], r["value"]): r["avg_rank"] for r in ranks.select("_g.g", "value", "avg_rank").collect()}
    for name, part in table.groupby("g", dropna=False):
        key = None if pd.isna(name) else name
        want = part.v.rank(method="average")
        for v, r in zip(part.v, want):
            if not np.isnan(v):
                assert got[(key, v)] == r


def test_same_result_for_any_partitioning(spark, table):
    results = []
    for parts in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        long = O.long_values(frame(spark, table).repartition(5), ["g"], {"v": F.col("v")})
        results.append(sorted(map(str, O.ordered(long).ranks().collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1]


def percentiles(spark, pdf, mode, **kw):
    out = P.percentile_table(frame(spark, pdf), ["id"], ["g"], ["v"], mode, **kw)
    return out.toPandas().sort_values("id").reset_index(drop=True).v_pctile.astype("float64")


def same(got, want):
    want = want.astype("float64").reset_index(drop=True)
    assert (got.isna() == want.isna()).all()
    assert np.allclose(got.dropna(), want.dropna(), atol=1e-9)


def test_percentile_average_rank(spark, table):
    groups = table.groupby("g", dropna=False).v
    rank, n = groups.rank(method="average"), groups.transform("size")
    same(percentiles(spark, table, "average_rank"), (rank - 1) / (n - 1) * 100)


def test_percentile_of_a_single_row_is_100(spark):
    pdf = pd.DataFrame({"id": [1, 2], "g": ["a", "b"], "v": [5.0, np.nan], "w": [1.0, 1.0]})
    assert list(percentiles(spark, pdf, "average_rank")) == [100.0, 100.0]


def test_percent_rank_of_qualified(spark, table):
    ok = table[table.w >= 0.4]
    want = (ok.groupby("g").v.rank(pct=True) * 100).reindex(table.index)
    same(percentiles(spark, table, "percent_rank", qualified=F.col("w") >= 0.4), want)


def test_quantile_bins_of_qualified(spark, table):
    ok = table[table.w >= 0.4]

    def bins(s):
        try:
            return pd.qcut(s, 100, labels=False, duplicates="drop") + 1
        except (ValueError, IndexError):
            return pd.Series(np.nan, index=s.index)

    want = ok.groupby("g", group_keys=False).v.apply(bins).reindex(table.index)
    same(percentiles(spark, table, "quantile_bin", qualified=F.col("w") >= 0.4), want)


def test_stratified_sample_is_proportional_and_stable(spark, table):
    df = frame(spark, table)
    one = SA.stratified_sample(df, ["g"], ["id"], 300)
    counts = dict(one.groupBy("g").count().collect())
    shares = table.g.fillna("-").value_counts() / len(table)
    for g, share in shares.items():
        assert abs(counts[None if g == "-" else g] - 300 * share) < 1
    assert sum(counts.values()) == 300
    two = SA.stratified_sample(df.repartition(7), ["g"], ["id"], 300)
    assert sorted(r["id"] for r in one.collect()) == sorted(r["id"] for r in two.collect())


def test_small_samples_and_shares(spark):
    df = spark.range(100_000).withColumn("g", F.col("id") % 200)
    assert SA.stratified_sample(df, ["g"], ["id"], 10).count() == 10
    tests = SA.hash_split(df, ["id"], 0.0004).filter("split = 'test'").count()
    assert 15 < tests < 75
    assert SA.hash_split(df, ["id"], 0.0).filter("split = 'test'").count() == 0
