"""Exact ranks and quantiles inside groups of any size.

A plain ``row_number() over (partition by group order by value)`` sends a whole
group to one task. Leagues hold a large share of all rows, so the operators here
cut every group into value buckets first:

1. equal values are counted together (``compact``), hashed on group *and* value,
   so a hot group is spread over all tasks and ties cost one row;
2. the :data:`SPLITTERS` largest groups are found by size. Any other group holds
   at most 1/SPLITTERS of the compacted rows, less than a task's usual share, and
   stays in one bucket;
3. one row in :data:`ROWS_PER_SPLITTER` of the large groups, at most SPLITTERS rows
   in all, is chosen by the hash of (group, value) and gives a bucket edge. It is
   a uniform sample of their rows and a pure function of the data, so a
   recomputed task sees the same edges. So the number of edges grows with the
   compacted rows and buckets keep their size up to SPLITTERS * ROWS_PER_SPLITTER
   (268 million) of them; at 10^11 a bucket has about 1.5 million, still a small sort;
4. bucket totals are summed per group; at most SPLITTERS + 2 rows per group;
5. rows join their bucket's offset on (group, bucket), and only a bucket is ever
   sorted, about 1/SPLITTERS of the compacted rows.

Groups are carried as one struct column ``_g``: struct equality treats NULL
fields as equal, so NULL keys form groups as in SQL and joins on ``_g`` reuse the
partitioning of aggregations on ``_g``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLITTERS = 1 << 16
ROWS_PER_SPLITTER = 4096
_KEY = ["_g", "metric", "bucket"]


def key_struct(cols: Sequence[str], name: str = "_g") -> Column:
    """Keys packed into one struct; a constant when there are no keys."""
    if not cols:
        return F.struct(F.lit(0).alias("_all")).alias(name)
    return F.struct(*[F.col(c).alias(c) for c in cols]).alias(name)


def unpack(cols: Sequence[str], name: str = "_g") -> list[Column]:
    return [F.col(f"{name}.`{c}`").alias(c) for c in cols]


def long_values(
    df: DataFrame,
    group: Sequence[str],
    values: Mapping[str, Column],
    extra: Sequence[Column] = (),
) -> DataFrame:
    """(g, metric, value [, extra]) with one row per input row and metric."""
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("metric"), c.cast("double").alias("value"))
            for name, c in values.items()
        ]
    )
    return df.select(key_struct(group), *extra, F.explode(pairs).alias("p")).select(
        "_g",
        *[F.col(_alias(c)) for c in extra],
        F.col("p.metric").alias("metric"),
        F.col("p.value").alias("value"),
    )


def _alias(c: Column) -> str:
    return c._jc.toString().rsplit(" AS ", 1)[-1].strip("`")


@dataclass(frozen=True)
class Ordered:
    """Compacted rows with buckets, and the running totals of the buckets."""

    rows: DataFrame  # _g, metric, bucket, value, cnt
    buckets: DataFrame  # _g, metric, bucket, held, offset, n, n_all, top

    def ranks(self) -> DataFrame:
        """One row per distinct value: g, metric, value, cnt, below, n, n_all.

        ``below`` counts the group's values smaller than this one; NULL values
        keep a row of their own with ``below`` NULL.
        """
        joined = self.rows.join(self.buckets.drop("held"), _KEY)
        return _with_below(joined).drop("bucket", "offset")

    def with_buckets(self, buckets: DataFrame) -> Ordered:
        """The same rows under buckets that carry more columns."""
        return Ordered(self.rows, buckets)

    def average_rank(self) -> DataFrame:
        r = self.ranks()
        return r.withColumn(
            "avg_rank", F.col("below") + (F.col("cnt") + F.lit(1)) / F.lit(2.0)
        )

    def at_ranks(self, wanted: Column, carry: Sequence[str] = ()) -> DataFrame:
        """Values found at 0-based ranks: g, metric, n, rank, value [, carry].

        ``wanted`` is an array<bigint> over the columns of :attr:`buckets`.
        Buckets that hold none of the wanted ranks are dropped before the join.
        """
        here = F.filter(
            F.array_distinct(wanted),
            lambda r: (r >= F.col("offset")) & (r < F.col("offset") + F.col("held")),
        )
        targets = self.buckets.withColumn(
            "wanted", F.when(F.col("bucket") >= 0, here)
        ).filter(F.size("wanted") > 0)
        hit = F.filter(
            F.col("wanted"),
            lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("cnt")),
        )
        return _with_below(self.rows.join(targets, _KEY)).select(
            "_g", "metric", "n", *carry, F.explode(hit).alias("rank"), "value"
        )


def _with_below(joined: DataFrame) -> DataFrame:
    inside = (
        Window.partitionBy(*_KEY)
        .orderBy("value")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.coalesce(F.sum("cnt").over(inside), F.lit(0))
    return joined.withColumn(
        "below", F.when(F.col("value").isNotNull(), F.col("offset") + before)
    )


def compact(long: DataFrame) -> DataFrame:
    """Count equal (g, metric, value) rows together; rows with a ``cnt`` are so already."""
    if "cnt" in long.columns:
        return long
    return long.groupBy("_g", "metric", "value").agg(F.count("*").alias("cnt"))


def ordered(long: DataFrame, splitters: int = SPLITTERS) -> Ordered:
    """Bucket (g, metric, value) rows for the rank operators of the result."""
    rows = compact(long)
    # Both the sizes and the sample use every column of the compacted rows, so
    # Spark runs the compaction once for all three uses.
    sizes = rows.groupBy("_g", "metric").agg(
        F.count("*").alias("size"), F.sum("cnt").alias("weight")
    )
    large = (
        sizes.filter(F.col("size") > ROWS_PER_SPLITTER)
        .orderBy(F.desc("size"), F.desc("weight"), F.xxhash64("_g", "metric"))
        .limit(splitters)
        .select("_g", "metric", F.lit(True).alias("large"))
    )
    # At most `splitters` rows: a proven bound for the broadcast.
    rows = rows.join(F.broadcast(large), ["_g", "metric"], "left")
    sampled = F.when(
        F.col("large") & F.col("value").isNotNull(),
        F.xxhash64("_g", "metric", "value", "cnt"),
    )
    sample = (
        rows.select("metric", "value", sampled.alias("h"))
        .filter(F.pmod("h", F.lit(ROWS_PER_SPLITTER)) == 0)
        .orderBy("h", "metric", "value")
        .limit(splitters)
    )
    # At most `splitters` values in all: again a proven bound.
    edges = sample.groupBy("metric").agg(
        F.sort_array(F.collect_set("value")).alias("edges")
    )
    steps = []
    while not steps or steps[-1] * 2 <= splitters:
        steps.append(2 ** len(steps))
    # Binary search: the number of edges below the value.
    position = F.aggregate(
        F.array(*[F.lit(s) for s in reversed(steps)]),
        F.lit(0),
        lambda at, step: F.when(
            (at + step <= F.size("edges"))
            & (F.try_element_at("edges", at + step) < F.col("value")),
            at + step,
        ).otherwise(at),
    )
    rows = rows.join(F.broadcast(edges), "metric", "left").select(
        "_g",
        "metric",
        F.coalesce(
            F.when(F.col("value").isNull(), -1)
            .when(F.col("large").isNull() | F.col("edges").isNull(), 0)
            .otherwise(position),
            F.lit(0),
        ).alias("bucket"),
        "value",
        "cnt",
    )
    held = rows.groupBy(*_KEY).agg(F.sum("cnt").alias("held"), F.max("value").alias("_top"))
    group = Window.partitionBy("_g", "metric")
    present = F.when(F.col("bucket") >= 0, F.col("held")).otherwise(F.lit(0))
    running = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = held.select(
        *_KEY,
        "held",
        F.coalesce(F.sum(present).over(running), F.lit(0)).alias("offset"),
        F.sum(present).over(group).alias("n"),
        F.sum("held").over(group).alias("n_all"),
        F.max("_top").over(group).alias("top"),
    )
    return Ordered(rows, buckets)


NEAREST, LINEAR = "nearest", "linear"


def quantile_points(
    data: Ordered,
    wanted: Mapping[str, Sequence[float]],
    interpolation: str = NEAREST,
) -> DataFrame:
    """(g, metric, n, q): ``q`` is the array of the metric's wanted quantiles.

    ``nearest`` takes element round((n-1)q) of the sorted non-NULL values,
    ``linear`` interpolates between its neighbours. Groups without a non-NULL
    value have no row.
    """
    level = F.create_map(
        *[
            x
            for name, qs in wanted.items()
            for x in (F.lit(name), F.array(*[F.lit(float(q)) for q in qs]))
        ]
    )
    qs = F.try_element_at(level, F.col("metric"))

    def place(q: Column) -> Column:
        return (F.col("n") - F.lit(1)).cast("double") * q

    if interpolation == NEAREST:
        ranks = F.transform(qs, lambda q: F.round(place(q)).cast("bigint"))
    elif interpolation == LINEAR:
        ranks = F.concat(
            F.transform(qs, lambda q: F.floor(place(q)).cast("bigint")),
            F.transform(qs, lambda q: F.ceil(place(q)).cast("bigint")),
        )
    else:
        raise ValueError(f"unknown interpolation {interpolation!r}")
    # At most two entries per wanted quantile and group.
    found = (
        data.at_ranks(ranks)
        .groupBy("_g", "metric", "n")
        .agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))
    )

    def read(q: Column) -> Column:
        if interpolation == NEAREST:
            return F.try_element_at("at", F.round(place(q)).cast("bigint"))
        low = F.try_element_at("at", F.floor(place(q)).cast("bigint"))
        high = F.try_element_at("at", F.ceil(place(q)).cast("bigint"))
        return low + (high - low) * (place(q) - F.floor(place(q)))

    return found.select("_g", "metric", "n", F.transform(qs, read).alias("q"))


def quantile_of(values: Column, q: float, interpolation: str = NEAREST) -> Column:
    """The quantile of a sorted array without NULLs, NULL if it is empty: as :func:`quantile_points`."""
    place = (F.size(values) - F.lit(1)).cast("double") * F.lit(float(q))

    def at(rank: Column) -> Column:
        return F.get(values, rank.cast("int"))

    if interpolation == NEAREST:
        found = at(F.round(place))
    else:
        low, high = at(F.floor(place)), at(F.ceil(place))
        found = low + (high - low) * (place - F.floor(place))
    return F.when(F.size(values) > 0, found)


def grouped_quantiles(
    df: DataFrame,
    group: Sequence[str],
    specs: Mapping[str, tuple[Column, float]],
    interpolation: str = NEAREST,
) -> DataFrame:
    """Wide table g + one column per spec ``name -> (value, q)``."""
    long = long_values(df, group, {n: c for n, (c, _) in specs.items()})
    points = quantile_points(
        ordered(long.filter("value IS NOT NULL")),
        {n: [q] for n, (_, q) in specs.items()},
        interpolation,
    )
    return wide_quantiles(points, list(specs))


def wide_quantiles(points: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per group, a column per metric."""
    return points.groupBy("_g").agg(
        *[
            F.max(F.when(F.col("metric") == n, F.col("q")[0])).alias(n)
            for n in names
        ]
    )


def median(df: DataFrame, group: Sequence[str], value: Column, name: str) -> DataFrame:
    return grouped_quantiles(df, group, {name: (value, 0.5)}, LINEAR)
