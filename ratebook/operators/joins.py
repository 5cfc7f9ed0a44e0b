"""Joins used everywhere: fact to lookup, with size checks where they matter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage

# Rows a lookup may have to be broadcast. A lookup row is a few hundred bytes.
BROADCAST_ROWS = 100_000


def small_enough(dim: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Counts at most ``max_rows + 1`` rows of ``dim``."""
    return dim.limit(max_rows + 1).count() <= max_rows


def attach(
    fact: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join a derived lookup table to a large one.

    The lookup is computed once and its size checked. A small one is broadcast,
    so the large side is not shuffled and a hot key costs nothing. A larger one
    goes through a sort-merge join without hint, where AQE splits skewed
    partitions of the large side.
    """
    dim = stage(dim)
    if small_enough(dim, max_rows):
        dim = F.broadcast(dim)
    return fact.join(dim, list(on), how)


def join_lookup(
    fact: DataFrame,
    dim: DataFrame,
    on: Sequence[tuple[str, str]],
    keep: Sequence[str],
    how: str = "left",
) -> DataFrame:
    """Left join on differently named or computed keys: ``(fact SQL, dim column)``.

    Keys are projected to temporary columns, so the join stays an equi-join even
    for a computed key such as ``at_bat_index + 1``. The strategy is Catalyst's.
    """
    names = [f"_k{i}" for i in range(len(on))]
    left = fact.withColumns({n: F.expr(f) for n, (f, _) in zip(names, on)})
    right = dim.select(
        *[F.col(d).alias(n) for n, (_, d) in zip(names, on)], *keep
    )
    return left.join(right, names, how).drop(*names)


def seen_keys(lookup: DataFrame, fact: DataFrame, on: Sequence[str]) -> DataFrame:
    """Lookup rows whose key occurs in the fact, without collecting the keys."""
    return lookup.join(fact.select(*on), list(on), "left_semi")
