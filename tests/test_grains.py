"""Sets and quantiles at several grains against the same from the rows, and the number of scans."""

import random

import pytest

from ratebook.operators import metrics as M
from ratebook.operators import ordered as O
from ratebook.plans import products as PR

GRAINS = {"a": ["a", "b"], "b": ["b"], "all": []}
SETS = [
    M.count("n"),
    M.mean("v", "v"),
    M.distinct("ids", "id"),
    M.distinct("known", "id", count_null=False),
    M.distinct("doubles", "v"),
    M.distinct("pairs", "struct(a, id)"),
    M.distinct("some", "CASE WHEN v > 1 THEN id END"),
    M.sorted_list("names", "s"),
    M.derived("per", "try_divide(ids, n)"),
]
QUANTILES = [
    M.quantile("near", "v", 0.7),
    M.quantile("line", "v", 0.25, interpolation="linear"),
    M.quantile("part", "v", 0.5, "id > 2"),
]


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(6)
    values = [None, 0.0, -0.0, 1.5, 2.0, float("inf"), -3.25]
    data = [
        (r.choice(["x", "y", None]), r.choice([1, 2, None]), r.choice([None, *range(9)]), r.choice(values), r.choice(["p", "q", None]))
        for _ in range(400)
    ]
    return spark.createDataFrame([*data, ("z", 9, None, None, None)], "a string, b int, id int, v double, s string").repartition(4)


def table(df, keys, names):
    return sorted(map(str, ([r[k] for k in [*keys, *names]] for r in df.collect())))


def test_sets_at_several_grains(rows):
    together = PR.multi_grain(rows, GRAINS, SETS)
    names = [m.name for m in SETS]
    for grain, keys in GRAINS.items():
        assert table(together.where(f"grain = '{grain}'"), keys, names) == table(M.aggregate(rows, keys, SETS), keys, names)
    every = {tuple(x) for x in rows.where("b = 1").select("id").collect()}
    assert together.where("grain = 'b' AND b = 1").first()["ids"] == len(every)
    assert together.where("grain = 'b' AND b = 1").first()["doubles"] == len({r[0] for r in rows.where("b = 1").select("v").collect()})


def test_quantiles_at_several_grains(rows):
    together = PR.multi_grain_quantiles(rows, GRAINS, QUANTILES)
    names = [m.name for m in QUANTILES]
    for grain, keys in GRAINS.items():
        alone = M.aggregate(rows, keys, QUANTILES).where("near IS NOT NULL")
        assert table(together.where(f"grain = '{grain}'"), keys, names) == table(alone, keys, names)
    assert together.where("grain = 'a' AND a = 'z'").count() == 0


def test_grains_of_nothing(rows):
    assert PR.multi_grain_quantiles(rows.limit(0), GRAINS, QUANTILES).count() == 0
    assert PR.multi_grain(rows.limit(0), {"a": ["a"]}, SETS).count() == 0


def test_one_scan_of_the_rows(spark, tmp_path, rows):
    """The rows are read by the write of the cells alone; the grains read what was written."""
    rows.write.parquet(f"{tmp_path}/rows")
    df = spark.read.parquet(f"{tmp_path}/rows")
    cells = M.cells(df, ["a", "b"], SETS)
    assert cells._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    for out in (PR.multi_grain(df, GRAINS, SETS), PR.multi_grain_quantiles(df, GRAINS, QUANTILES)):
        assert not [f for f in out.inputFiles() if f"{tmp_path}/rows" in f]


def test_buckets_keep_their_size_as_rows_grow(spark, monkeypatch):
    monkeypatch.setattr(O, "ROWS_PER_SPLITTER", 64)
    held = []
    for n in (4000, 40_000):
        long = spark.range(n).selectExpr("struct(1 AS k) AS _g", "'m' AS metric", "CAST(xxhash64(id) AS DOUBLE) AS value")
        held.append(O.ordered(long).buckets.agg({"held": "max"}).first()[0])
    assert held[1] < 3 * held[0] < 3 * 1000
