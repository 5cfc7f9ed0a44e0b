"""Large tables are written in buckets by join or window key: no exchange of their rows."""

from __future__ import annotations

import math
import os
import shutil

import pytest

from checks import fixtures, queries
from ratebook.operators import context as C
from ratebook.operators.staging import stage, stage_by

from .test_contexts import _rows, _same
from .test_disk import tables  # noqa: F401


@pytest.fixture
def no_broadcast(spark):
    """Every table counts as beyond a broadcast."""
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = {n: spark.conf.get(n, None) for n in names}
    for n in names:
        spark.conf.set(n, "-1")
    yield
    for n, value in before.items():
        spark.conf.unset(n) if value is None else spark.conf.set(n, value)


def _twin(path):
    """The same files under another name, whose facts are not yet written."""
    other = f"{path}_twin"
    shutil.copytree(path, other)
    return other


def test_joined_rows_are_the_same(spark, tables, no_broadcast):  # noqa: F811
    """With NULL and repeated keys: the rows of the SQL over the tables as they are."""
    for text in (fixtures.OBS, fixtures._BASE):
        for name in ("supplier", "orders", "part", "lineitem"):
            fixtures.load(spark, tables, name).createOrReplaceTempView(name)
        plain = sorted(map(repr, spark.sql(text).collect()))
        for clustered in (False, True):
            dealt = fixtures._run(spark, tables, text, clustered)
            assert len(plain) > 0 and sorted(map(repr, dealt.collect())) == plain


def test_join_of_orders_moves_no_lines(spark, tables, no_broadcast):  # noqa: F811
    lines, orders = fixtures._lines_and_orders(spark, tables)
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey, "left")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()


def test_fact_is_the_same(spark, tables):  # noqa: F811
    """The full fact by buckets has the rows of the one by exchange, and none is exchanged."""
    expected = queries.pitch(spark, _twin(tables))
    names = ["game_pk", "at_bat_index", "batter_mlbid", "pitcher_mlbid", "season", "price", "stands", *C.PITCHER_AVERAGES, "primary_tag", *C.PRIMARY_AVERAGES]
    names = [n for n in names if n in expected.columns]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = queries.pitch(spark, tables)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    left, right = (sorted(d.select(*names).collect(), key=lambda r: repr(r[:7])) for d in (expected, found))
    assert len(left) == len(right) > 0
    for a, b in zip(left, right, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and y is not None and math.isclose(x, y, rel_tol=1e-9))


def test_placed_rows_are_not_exchanged(spark):
    df = _rows(spark).filter("pitcher_mlbid IS NOT NULL AND season IS NOT NULL")
    placed = C.season_contexts(stage_by(df, C.PITCHER_SEASON, 4), placed=True)
    assert "Exchange" not in placed._jdf.queryExecution().executedPlan().toString()
    _same(placed.orderBy("i").collect(), C.season_contexts(stage(df)).orderBy("i").collect())


def test_setting_is_put_back(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    table = stage_by(spark.range(100).selectExpr("id", "id % 7 AS k"), ["k"], 4)
    assert spark.conf.get(name) == before and table.count() == 100
    assert len(set(map(os.path.dirname, table.inputFiles()))) == 1
