"""Declarative filters, leaderboards and pages."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Condition = tuple[str, str, object]


def condition(column: str, op: str, value: object) -> Column:
    """One ``(column, operator, value)`` triple as a predicate.

    ``contains`` is a case-insensitive regular expression, ``between`` closed. The
    value may be another column, ``F.col(name)``; rows with a NULL on either side go.
    """
    c = F.col(column)
    if op in ("=", "=="):
        return c == value
    if op == "!=":
        return c != value
    if op == "<":
        return c < value
    if op == "<=":
        return c <= value
    if op == ">":
        return c > value
    if op == ">=":
        return c >= value
    if op == "between":
        low, high = value
        return c.between(low, high)
    if op == "in":
        return c.isin(list(value))
    if op == "not_in":
        return ~c.isin(list(value))
    if op == "contains":
        return c.rlike(f"(?i){value}")
    raise ValueError(f"unknown operator {op!r}")


def apply_filters(df: DataFrame, conditions: Iterable[Condition | Mapping[str, object]]) -> DataFrame:
    """AND of all conditions; accepts triples or ``{column, operator, value}``.

    A mapping may name ``other``, a column, in place of ``value``.
    """
    for item in conditions:
        if isinstance(item, Mapping):
            value = F.col(str(item["other"])) if "other" in item else item["value"]
            item = (str(item["column"]), str(item["operator"]), value)
        df = df.filter(condition(*item))
    return df


def filter_by_values(df: DataFrame, column: str, values: Sequence[object]) -> DataFrame:
    """Membership filter that an ``All`` among the values switches off."""
    if not values or "All" in values:
        return df
    return df.filter(F.col(column).isin(list(values)))


def at_least(df: DataFrame, column: str, minimum: float | None) -> DataFrame:
    return df if minimum is None else df.filter(F.col(column) >= minimum)


def leaderboard(
    df: DataFrame,
    headline: str,
    columns: Mapping[str, str],
    conditions: Iterable[Condition] = (),
    tie_break: Sequence[str] = (),
    top: int | None = None,
) -> DataFrame:
    """Filter, project with display names, order by the headline descending.

    ``columns`` maps source to display name. With ``top`` the plan is a
    TakeOrderedAndProject: each task keeps its own best rows only.
    """
    out = (
        apply_filters(df, conditions)
        .orderBy(F.col(headline).desc_nulls_last(), *[F.col(c) for c in tie_break])
        .select(*[F.col(c).alias(alias) for c, alias in columns.items()])
    )
    return out if top is None else out.limit(top)


def page(df: DataFrame, order: Sequence[Column], size: int | None, number: int = 1) -> DataFrame:
    """Page ``number`` (from 1) under a total order; without a size, all rows are one page."""
    if size is None:
        return df.orderBy(*order) if number == 1 else df.limit(0)
    return df.orderBy(*order).offset(size * (number - 1)).limit(size)
