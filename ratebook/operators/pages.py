"""A page index: any page of a sorted table from the one range that holds it.

``orderBy().offset().limit()`` brings all rows up to the page's end together, so page
500 000 costs as much as half the table. Here the table is dealt into sorted ranges once
and written with the range as its folder; the number of rows of each range is kept. A
page then reads the folder (or the few) its rows lie in, sorts only those, and drops
at most a range's rows in front of it.

Defined results: the order must be total for pages to be the same on each reading; NULLs
go where the order expressions put them; pages beyond the end and of an empty table have
no rows; columns come back as they were, whatever their names.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import shared_folder

RANGE_ROWS = 100_000


@dataclass(frozen=True)
class Pages:
    """A written table in ranges. ``ends`` counts the rows up to and with each range: two numbers a range."""

    rows: DataFrame
    order: tuple[Column, ...]
    column: str
    numbers: tuple[int, ...]
    ends: tuple[int, ...]

    def __len__(self) -> int:
        return self.ends[-1] if self.ends else 0

    def page(self, number: int, size: int) -> DataFrame:
        """Page ``number`` (from 1) of ``size`` rows, in order."""
        if number < 1 or size < 1:
            raise ValueError("pages and sizes count from 1")
        start = size * (number - 1)
        first, last = bisect_right(self.ends, start), bisect_right(self.ends, start + size - 1)
        held = [*self.numbers[first : last + 1]]
        if not held:
            return self.rows.drop(self.column).limit(0)
        before = self.ends[first - 1] if first else 0
        near = self.rows.where(F.col(self.column).isin(held)).drop(self.column)
        return near.orderBy(*self.order).offset(start - before).limit(size)


def page_index(df: DataFrame, order: Sequence[Column], range_rows: int = RANGE_ROWS) -> Pages:
    """Sort ``df`` into ranges of about ``range_rows`` rows and write them."""
    spark = df.sparkSession
    column = "_range"
    while column in df.columns:
        column += "_"
    ranges = max(1, -(-df.count() // range_rows))
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    dealt = df.repartitionByRange(ranges, *order).withColumn(column, F.spark_partition_id())
    dealt.sortWithinPartitions(*order).write.partitionBy(column).parquet(path)
    rows = spark.read.schema(f"{_ddl(df)}, `{column}` int").parquet(path)
    sizes = sorted(tuple(r) for r in rows.groupBy(column).count().collect())  # one row a range
    return Pages(rows, tuple(order), column, tuple(n for n, _ in sizes), tuple(accumulate(c for _, c in sizes)))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
