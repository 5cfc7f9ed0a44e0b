"""NULL-careful column helpers shared by all operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den as double; NULL (never an ANSI error or NaN) when den is 0."""
    return F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))


def percent(num: Column | str, den: Column | str) -> Column:
    return F.lit(100.0) * ratio(num, den)


def clip(c: Column | str, low: float, high: float) -> Column:
    """Clamp to [low, high]; a NULL input stays NULL.

    ``least``/``greatest`` skip NULLs, so a bare nesting would return a bound.
    """
    c = as_col(c)
    return F.when(
        c.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c))
    )


def half_even(c: Column | str, places: int = 0) -> Column:
    return F.bround(as_col(c), places)


def mirror(c: Column | str, flip: Column) -> Column:
    """Negate ``c`` on rows where ``flip`` is true (NULL counts as false)."""
    c = as_col(c)
    return F.when(flip, -c).otherwise(c)


def glue(*parts: Column | str, sep: str = "") -> Column:
    """String concatenation that is NULL as soon as one part is NULL."""
    pieces: list[Column] = []
    for i, part in enumerate(parts):
        if i and sep:
            pieces.append(F.lit(sep))
        pieces.append(as_col(part).cast("string"))
    return F.concat(*pieces)


def recode(
    c: Column | str, mapping: Mapping[object, object], default: object = None
) -> Column:
    """Dictionary lookup as one map literal; misses and NULLs give ``default``."""
    flat = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*flat), as_col(c)), F.lit(default))


def first_match(rules: Sequence[tuple[Column, object]], default: object) -> Column:
    """Ordered rules, first true one wins."""
    chain: Column | None = None
    for condition, value in rules:
        value = F.lit(value)
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return F.lit(default) if chain is None else chain.otherwise(F.lit(default))


def finite_or(c: Column | str, fill: float = 0.0) -> Column:
    """Replace NULL, NaN-free infinities by ``fill``."""
    c = as_col(c).cast("double")
    infinite = c.isin(float("inf"), float("-inf"))
    return F.coalesce(F.when(~infinite, c), F.lit(float(fill)))


def spray_angle(dx: Column, dy: Column) -> Column:
    """Quadrant-aware field angle in degrees, narrowed by the 0.75 field factor."""
    return F.degrees(F.atan2(dx, dy)) * F.lit(0.75)


def spray_angle_simple(dx: Column, dy: Column) -> Column:
    """Single-quadrant variant; NULL when dx is NULL or dy is 0 or NULL."""
    # fixed value: the feed's own truncated pi
    factor = 180.0 / 3.14159265 * 0.75
    return F.atan(F.try_divide(dx, dy)) * F.lit(factor)


def numeric_code(c: Column | str) -> Column:
    """True for codes made of digits only (ids standing in for a team code)."""
    return as_col(c).rlike("^[0-9]+$")


def real_code(c: Column | str) -> Column:
    c = as_col(c)
    return c.isNotNull() & ~numeric_code(c)
