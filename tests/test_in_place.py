"""Rows that lie by their keys are grouped where they are: the same tables without an exchange."""

from __future__ import annotations

import pytest

from checks import queries
from ratebook.operators import metrics as M
from ratebook.operators.staging import lies_by, lying, stage_by
from ratebook.plans import feed as FEED
from ratebook.plans import products as PR
from ratebook.plans import regress as RG
from ratebook.plans import specs as S

from .test_buckets import _twin, no_broadcast  # noqa: F401
from .test_disk import tables  # noqa: F401


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df):
    df = queries.rounded(df, 5)
    return sorted(map(repr, df.select(*[f"`{c}`" for c in sorted(df.columns)]).collect()))


@pytest.fixture
def facts(spark, tables):  # noqa: F811
    """The fact as before, and in buckets."""
    plain = queries.pitch(spark, _twin(tables))
    assert lying(plain, S.PITCHER_KEYS) is None
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        dealt = queries.pitch(spark, tables)
        yield plain, dealt
    finally:
        spark.conf.set(name, before)


def test_products_in_place(facts):
    plain, dealt = facts
    assert plain.columns == dealt.columns and plain.dtypes == dealt.dtypes
    for table in (PR.hitters, PR.pitchers, PR.pitch_types):
        a, b = table(plain), table(dealt)
        assert "Exchange" not in _plan(b) and a.dtypes == b.dtypes
        assert len(rows := _rows(b)) > 5 and rows == _rows(a)
    assert "Exchange" not in _plan(PR.pitching_partials(dealt))


def test_grades_in_place(facts):
    plain, dealt = (PR.graded_pitching(f, 1, 2) for f in facts)
    for name, table in plain.items():
        assert table.dtypes == dealt[name].dtypes
        assert len(rows := _rows(dealt[name])) > 0 and rows == _rows(table), name


@pytest.mark.parametrize("dataset", ["hitters", "pitchers", "pitch_types"])
def test_regressed_in_place(facts, dataset):
    found = []
    for fact in facts:
        constants = RG.stability_constants(fact, {dataset: S.REGRESSED[dataset]}, min_denom=1, min_players=1)
        wide, long = RG.regress_facts(fact, constants, dataset, places=None)
        found.append((wide.dtypes, _rows(wide), long.dtypes, _rows(long)))
    assert found[0] == found[1] and found[0][1]


def test_all_kinds_in_place(spark):
    rows = [
        (i % 5 if i % 7 else None, i % 3, None if i % 4 == 0 else float(i % 9) - 4, None if i % 6 == 0 else f"s{i % 5}", i % 2 == 0)
        for i in range(500)
    ]
    rows += [(9, 9, None, None, None), (8, 8, float("nan"), "x", True), (8, 8, -0.0, None, False), (8, 8, 0.0, None, False)]
    df = stage_by(spark.createDataFrame(rows, "a int, b int, v double, s string, f boolean"), ["a", "b"], 4)
    spec = [
        M.count("n"), M.rate("r", "f", "v IS NOT NULL", parts=True), M.mean("m", "v", "f", parts=True),
        M.maximum("top", "v"), M.total("sum", "b"), M.distinct("vs", "v"), M.distinct("known", "s", count_null=False),
        M.distinct("pairs", "struct(v, s)"), M.sorted_list("names", "s", "f"), M.quantile("near", "v", 0.7, parts=True),
        M.quantile("line", "v", 0.25, "f", interpolation="linear"), M.derived("per", "try_divide(vs, n)"),
    ]
    want = M.aggregate(df, ["a", "b"], spec)
    found = M.aggregate(lies_by(df, ["a", "b"], 4), ["a", "b"], spec)
    assert "Exchange" in _plan(want) and "Exchange" not in _plan(found)
    assert want.dtypes == found.dtypes and _rows(want) == _rows(found)


def test_only_a_marked_frame_lies(spark):
    df = lies_by(stage_by(spark.range(9).selectExpr("id", "id % 3 AS k"), ["k"], 2), ["k"], 2)
    assert lying(df, ["k", "id"]) is df and lying(df, ["id"]) is None
    assert lying(df.filter("id > 2"), ["k"]) is None


def test_feed_in_place(spark, tables, no_broadcast):  # noqa: F811
    plain, dealt = queries.feed(spark, tables, clustered=True), queries.feed(spark, tables)
    assert plain.columns == dealt.columns
    for table in (FEED.hitter_table, FEED.pitcher_table, FEED.pitch_type_table):
        assert len(rows := _rows(table(dealt))) > 5 and rows == _rows(table(plain))
    for keys, metrics in ((FEED.HITTER_KEYS, FEED.HITTERS), (FEED.PITCH_TYPE_KEYS, FEED.PITCH_TYPES)):
        assert "Exchange" not in _plan(M.aggregate(dealt, keys, metrics))


def test_grains_in_place(facts):
    plain, dealt = facts
    spec = [M.quantile("near", "pitch_velo", 0.9), M.quantile("line", "exit_velo", 0.5, "launch_angle > 0", interpolation="linear")]
    sets = [M.count("n"), M.distinct("TBF", "pa_id"), M.sorted_list("tags", "pitch_tag"), M.mean("velo", "pitch_velo")]
    for table, metrics in ((PR.multi_grain_quantiles, spec), (PR.multi_grain, sets)):
        a, b = (table(f, queries.GRAINS, metrics) for f in (plain, dealt))
        assert a.dtypes == b.dtypes and len(rows := _rows(b)) > 5 and rows == _rows(a)
    assert "Exchange" not in _plan(M.histograms(dealt, queries.GRAINS["player"], spec))
    assert "Exchange" not in _plan(M.cells(dealt, queries.GRAINS["player"], sets))
