"""Plan shape: what must hold for the plans to survive large inputs."""

import re

import pytest
from pyspark.sql import functions as F

from checks import queries as Q
from checks.fixtures import load
from ratebook.functions.scalar import real_code
from ratebook.operators import metrics as M
from ratebook.operators import ordered as O
from ratebook.operators.joins import attach

from .conftest import SF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


NO_PYTHON = ["entity_rates", "hitters", "pitcher_pctiles", "regressed_hitters", "comps_topk", "anchored_score", "grade_20_80"]


@pytest.mark.parametrize("name", NO_PYTHON)
def test_stays_in_the_jvm_without_cross_joins(spark, name):
    text = plan(Q.QUERIES[name](spark, SF))
    for bad in ("Cartesian", "NestedLoop", "Python", "InPandas"):
        assert bad not in text


def test_only_needed_columns_are_read(spark):
    li = load(spark, SF, "lineitem")
    text = plan(M.aggregate(li, ["l_suppkey"], [M.rate("r", "l_tax > 0.02", "l_discount > 0.05")]))
    assert re.search(r"ReadSchema: struct<l_suppkey:bigint,l_discount:double,l_tax:double>", text)


def test_filters_reach_the_scan(spark):
    text = plan(load(spark, SF, "lineitem").filter("l_quantity >= 49 AND l_returnflag = 'R'"))
    assert "GreaterThanOrEqual(l_quantity,49.0)" in text and "EqualTo(l_returnflag,R)" in text
    text = plan(load(spark, SF, "part").filter(real_code("p_brand")))
    assert "IsNotNull(p_brand)" in text


def test_additive_metrics_take_one_exchange(spark):
    li = load(spark, SF, "lineitem")
    spec = [M.rate(f"r{i}", f"l_linenumber = {i}") for i in range(7)] + [M.mean("m", "l_tax")]
    text = plan(M.aggregate(li, ["l_suppkey"], spec))
    assert text.count("Exchange hashpartitioning") == 1 and text.count("FileScan") == 1


def test_families_join_without_reshuffling(spark):
    """Distinct counts and lists meet the additive metrics on the same partitioning."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        li = load(spark, SF, "lineitem")
        df = M.aggregate(li, ["l_suppkey"], [M.count("n"), M.distinct("d", "l_orderkey")])
        text = plan(df)
        # rows by key; distinct pairs by (key, value), then by key: no exchange for the join
        assert text.count("Exchange hashpartitioning") <= 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_window_over_a_whole_group(spark):
    li = load(spark, SF, "lineitem")
    df = O.grouped_quantiles(li, ["l_returnflag"], {"q": (F.col("l_extendedprice"), 0.9)})
    for spec in re.findall(r"windowspecdefinition\(([^)]*value[^)]*)\)", plan(df)):
        assert "bucket" in spec.split("value")[0]


def test_attach_broadcasts_only_checked_sizes(spark):
    fact = spark.range(1000).selectExpr("id", "id % 50 AS k")
    dim = fact.groupBy("k").agg(F.max("id").alias("m"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small, large = attach(fact, dim, ["k"]), attach(fact, dim, ["k"], max_rows=10)
        assert "BroadcastHashJoin" in plan(small) and "SortMergeJoin" in plan(large)
        assert sorted(small.collect()) == sorted(large.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_means_do_not_depend_on_order(spark):
    values = [0.1, 0.2, 0.3, 1e15, -1e15, 0.7, None, float("nan")]
    rows = [(k, v) for k, order in (("a", values), ("b", values[::-1])) for v in order]
    df = spark.createDataFrame(rows, "k string, v double").coalesce(1)
    got = M.aggregate(df, ["k"], [M.mean("m", "v", parts=True)]).collect()
    assert [(r["m"], r["m_n"]) for r in got] == [(1.3 / 6, 6)] * 2


def test_spec_lists():
    assert M.spec_predicate("pi_pitch_group is in ['CU','SL']") == "pi_pitch_group IN ('CU','SL')"
    assert M.spec_predicate("a not in [1] and b") == "a not IN (1) and b"
    assert M.spec_predicate("pitches") == "*" and M.spec_predicate(None) is None
    for bad in ("a is in (1)", "a in [1"):
        with pytest.raises(ValueError, match="not a predicate"):
            M.spec_predicate(bad)
