"""Sums of doubles that do not depend on the order of addition.

A double below 2^50 is cut at fixed binary places into five whole numbers: two groups of
bits before the point and three of 24 bits behind it. Each is added up as a long,
which is exact for up to 2^37 rows, so states merge in any order and at any grain to
the same total; carries are settled at the end, and one fixed formula makes the double.
Nothing is lost of values from 2^-20 to 2^50 and of 0; any others (very large, very
small, infinite, NaN) go to a sixth state, a plain sum of doubles, which covers the full
range with the rules of IEEE arithmetic; only there the last bits follow the order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import DataFrame

BITS = 24
STEP = 1 << BITS
LEAST, MOST = 2.0**-20, 2.0**50
PARTS = ("top", "whole", "high", "middle", "low", "beyond")


def names(text: str) -> tuple[str, str]:
    """Columns of a value and of its part that is cut exactly."""
    key = hashlib.md5(" ".join(text.split()).encode()).hexdigest()[:12]
    return f"_x{key}", f"_m{key}"


def prepared(df: DataFrame, texts: list[str]) -> DataFrame:
    """``df`` with the columns of :func:`names` for each value, given as SQL."""
    if not texts:
        return df
    pairs = [(t, *names(t)) for t in dict.fromkeys(" ".join(t.split()) for t in texts)]
    valued = df.selectExpr("*", *[f"CAST(({t}) AS DOUBLE) AS {x}" for t, x, _ in pairs])
    fits = f"CASE WHEN {{0}} = 0 OR abs({{0}}) >= {LEAST!r}D AND abs({{0}}) < {MOST!r}D THEN {{0}} WHEN {{0}} IS NOT NULL THEN 0D END"
    return valued.selectExpr("*", *[f"{fits.format(x)} AS {m}" for _, x, m in pairs])


def states(text: str) -> dict[str, str]:
    """The aggregates of a prepared value, by part."""
    x, m = names(text)
    fine = f"({m} - CAST({m} AS BIGINT)) * {1 << (2 * BITS)}D"
    return {
        "top": f"sum(CAST({m} AS BIGINT) div {STEP}L)",
        "whole": f"sum(CAST({m} AS BIGINT) % {STEP}L)",
        "high": f"sum(CAST({fine} AS BIGINT) div {STEP}L)",
        "middle": f"sum(CAST({fine} AS BIGINT) % {STEP}L)",
        "low": f"sum(CAST(({fine} - CAST({fine} AS BIGINT)) * {STEP}D AS BIGINT))",
        "beyond": f"sum(CASE WHEN {x} <> {m} THEN {x} END)",
    }


def total(part: Mapping[str, str]) -> str:
    """The sum as a double, from the (merged) columns of its parts."""
    middle = f"({part['middle']} + shiftright({part['low']}, {BITS}))"
    high = f"({part['high']} + shiftright({middle}, {BITS}))"
    whole = f"({part['whole']} + shiftright({high}, {BITS}))"
    top = f"({part['top']} + shiftright({whole}, {BITS}))"
    low = f"({part['low']} & {STEP - 1}L)"
    above = f"CAST({top} AS DOUBLE) * {STEP}D + CAST({whole} & {STEP - 1}L AS DOUBLE)"
    below = f"CAST({high} & {STEP - 1}L AS DOUBLE) * {2.0**-BITS!r}D + CAST({middle} & {STEP - 1}L AS DOUBLE) * {2.0 ** (-2 * BITS)!r}D"
    rest = f"CAST({low} AS DOUBLE) * {2.0 ** (-3 * BITS)!r}D"
    # Rounded once: what adding the two main parts loses is added with the smallest.
    bound = f"transform(array(named_struct('a', {above}, 'b', {below}, 'r', {rest})), v -> v.a + v.b + ((v.b - ((v.a + v.b) - v.a)) + v.r))"
    return f"({bound}[0] + coalesce({part['beyond']}, 0D))"


def exact_sum(text: str) -> str:
    """The whole aggregate of a prepared value."""
    return total(states(text))
