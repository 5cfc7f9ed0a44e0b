"""The page index against plain sorting, and what it reads."""

import random

import pytest
from pyspark.sql import functions as F

from ratebook.operators.pages import page_index

def order():
    return [F.col("a").desc_nulls_last(), F.col("id")]


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(2)
    data = [(i, r.choice([None, r.randrange(6), r.randrange(900)]), f"x{i}") for i in range(1000)]
    return spark.createDataFrame(data, "id long, a int, `_range` string").repartition(5)


def test_pages_follow_the_order(rows):
    want = [tuple(r) for r in rows.orderBy(*order()).collect()]
    index = page_index(rows, order(), range_rows=90)
    assert len(index) == 1000 and len(index.ends) > 5 and index.column not in rows.columns
    for number, size in [(1, 7), (143, 7), (144, 7), (2, 300), (4, 300), (5, 300), (1, 5000), (999, 1)]:
        got = index.page(number, size)
        assert got.columns == rows.columns
        assert [tuple(r) for r in got.collect()] == want[size * (number - 1) : size * number]
    with pytest.raises(ValueError):
        index.page(0, 5)


def test_a_page_reads_its_range_only(rows):
    index = page_index(rows, order(), range_rows=100)
    plan = index.page(60, 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_range_" in plan or "PartitionFilters: [(_range_" in plan
    assert "SinglePartition" not in plan and "TakeOrderedAndProject" in plan
    first, last = (i for i, e in enumerate(index.ends) if e > 590), len(index.ends)
    assert next(first) < last - 1


def test_pages_of_nothing(rows):
    index = page_index(rows.limit(0), order())
    assert len(index) == 0 and index.page(1, 10).count() == 0 and index.page(1, 10).columns == rows.columns
