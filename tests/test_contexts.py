"""Both contexts of a pitch by one join, and facts whose joins run once."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from checks.fixtures import base_rows, feed_raw, obs, pitch_raw
from ratebook.operators import context as C

MEASURED = {**C.PITCHER_AVERAGES, **C.PRIMARY_AVERAGES}


def _rows(spark):
    rows = []
    for i in range(400):
        pitcher = None if i % 23 == 0 else i % 5
        season = None if i % 29 == 0 else 2000 + i % 2
        stands = None if i % 7 == 0 else "LR"[i % 3 == 0]
        tag = None if i % 11 == 0 else ("FA", "SI", "FC", "SL", "CU")[i * i % 5]
        value = [None if (i + k) % 13 == 0 else float((i * (k + 3)) % 97) / 4 for k in range(len(MEASURED))]
        rows.append((i, pitcher, 1, season, stands, tag, *value))
    names = ", ".join(f"{c} double" for c in MEASURED.values())
    return spark.createDataFrame(
        rows, f"i int, pitcher_mlbid int, level_id int, season int, stands string, pitch_tag string, {names}"
    )


def _same(left, right):
    for a, b in zip(left, right, strict=True):
        for c in a.asDict():
            x, y = a[c], b[c]
            assert x == y or (isinstance(x, float) and y is not None and math.isclose(x, y, rel_tol=1e-12)), (c, x, y)


def test_both_contexts_by_one_join(spark):
    df = _rows(spark)
    for mode in (C.MOST_FREQUENT, C.FIRST_NAME):
        two = C.add_primary_pitch_context(C.add_pitcher_context(df), mode)
        one = C.add_pitch_contexts(df, mode)
        assert sorted(one.columns) == sorted(two.columns)
        _same(one.orderBy("i").collect(), two.select(*one.columns).orderBy("i").collect())
        plan = one._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join ") == 1


def test_facts_are_read_without_their_joins(spark):
    """Each pass over a fact scans written rows; it does not join the tables again."""
    for fact in (obs, base_rows, pitch_raw, feed_raw):
        plan = fact(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Join " not in plan, fact.__name__


def test_season_contexts_move_the_rows_once(spark):
    """As by join, for small and for very large seasons; no states and no second copy are exchanged."""
    df = _rows(spark)
    none = spark.createDataFrame([], "pitcher_mlbid int, level_id int, season int")
    more = df.drop(*C.PITCHER_SEASON)
    some = C.hot_seasons(df, rows=37, counted=1)
    assert 0 < some.count() < df.select(*C.PITCHER_SEASON).distinct().count()
    for mode in (C.MOST_FREQUENT, C.FIRST_NAME):
        joined = C.add_pitch_contexts(df, mode)
        for hot in (None, none, some):
            one = C.add_season_contexts(df.select("i", *C.PITCHER_SEASON), mode, lambda d: d.join(F.broadcast(more), "i"), hot)
            _same(one.orderBy("i").collect(), joined.select(*one.columns).orderBy("i").collect())
    rows = C.season_contexts(df.filter("pitcher_mlbid IS NOT NULL AND season IS NOT NULL"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
