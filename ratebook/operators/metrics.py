"""Declarative metrics, all aggregated together.

A :class:`Metric` holds Spark SQL text. Additive metrics (rates, means, counts,
sums, maxima) are split into *states* that are shared between metrics, computed
in one hash aggregate with map-side combine, and can be rolled up from a finer
grain. Distinct counts and sorted lists share one pass over the rows, or are rolled up
from the :func:`cells` of a finer grain; exact quantiles are a pass of their own, or are
rolled up from :func:`histograms`. All results are keyed by the same struct ``g``, so
putting them together needs no reshuffle.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import half_even
from . import sums
from .ordered import (
    LINEAR,
    NEAREST,
    compact,
    grouped_quantiles,
    key_struct,
    long_values,
    ordered,
    quantile_of,
    quantile_points,
    unpack,
    wide_quantiles,
)
from .staging import lies_by, lying

# Names a spec may use instead of a predicate.
ALIASES = {"pitches": "*", "swings": "swing", "bbe": "bbe"}

ADDITIVE = {"count", "rate", "mean", "sum", "max"}
SETS = {"distinct", "list"}
KINDS = ADDITIVE | SETS | {"quantile", "derived"}


@dataclass(frozen=True)
class Metric:
    """One named statistic.

    ``num``/``den`` are predicates (``*`` counts rows), ``value`` an expression,
    ``where`` a predicate that limits ``value``, ``expr`` a formula over other
    metrics of the same list. ``parts`` also publishes ``_num``/``_den`` (rates)
    or ``_n`` (means, maxima, quantiles). Hidden metrics only feed ``derived``.
    """

    name: str
    kind: str
    num: str | None = None
    den: str | None = None
    value: str | None = None
    where: str | None = None
    q: float = 0.5
    interpolation: str = NEAREST
    scale: float = 1.0
    expr: str | None = None
    n: str | None = None
    sep: str = " | "
    count_null: bool = True
    parts: bool = False
    hidden: bool = False
    depends_on: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"{self.name}: unknown kind {self.kind!r}")
        needs = {"rate": "num", "count": "num", "derived": "expr"}.get(self.kind, "value")
        if getattr(self, needs) is None:
            raise ValueError(f"{self.name}: {self.kind} metric without {needs}")

    @property
    def measured(self) -> str:
        """The value as SQL, NULL outside ``where``."""
        if self.where is None:
            return f"({self.value})"
        return f"CASE WHEN {self.where} THEN {self.value} END"


def rate(name: str, num: str, den: str = "*", **kw: object) -> Metric:
    return Metric(name, "rate", num=num, den=den, scale=kw.pop("scale", 100.0), **kw)


def mean(name: str, value: str, where: str | None = None, **kw: object) -> Metric:
    return Metric(name, "mean", value=value, where=where, **kw)


def maximum(name: str, value: str, where: str | None = None, **kw: object) -> Metric:
    return Metric(name, "max", value=value, where=where, **kw)


def count(name: str, num: str = "*", **kw: object) -> Metric:
    return Metric(name, "count", num=num, **kw)


def total(name: str, value: str, **kw: object) -> Metric:
    return Metric(name, "sum", value=value, **kw)


def distinct(name: str, value: str, **kw: object) -> Metric:
    return Metric(name, "distinct", value=value, **kw)


def quantile(name: str, value: str, q: float, where: str | None = None, **kw: object) -> Metric:
    return Metric(name, "quantile", value=value, q=q, where=where, **kw)


def sorted_list(name: str, value: str, where: str | None = None, **kw: object) -> Metric:
    return Metric(name, "list", value=value, where=where, **kw)


def derived(name: str, expr: str, **kw: object) -> Metric:
    return Metric(name, "derived", expr=expr, **kw)


# --- specs ------------------------------------------------------------------


_LIST = re.compile(r"\b(?:is\s+)?(not\s+)?in\s*\[([^\[\]]*)\]", re.IGNORECASE)


def spec_predicate(text: object) -> str | None:
    """A spec's predicate as Spark SQL: aliases resolved, ``[is] [not] in [..]`` lists as IN.

    An empty list holds nothing. Brackets left over raise here, not when a plan is built.
    """
    if text is None:
        return None
    text = ALIASES.get(str(text), str(text))
    sql = _LIST.sub(lambda m: f"{m[1] or ''}IN ({m[2].strip() or 'NULL'})", text)
    unquoted = re.sub(r"'[^']*'|\"[^\"]*\"", "", sql)
    if re.search(r"[\[\]]", unquoted) or re.search(r"\bis\s+in\b", unquoted, re.IGNORECASE):
        raise ValueError(f"not a predicate: {text!r}")
    return sql


def metric_from_spec(spec: Mapping[str, object]) -> Metric:
    """One entry of a spec file; ``filter`` wins over ``sample_n``."""
    predicate = spec_predicate

    name, kind = str(spec["name"]), str(spec["kind"])
    if kind == "rate":
        return rate(name, predicate(spec["numerator"]), predicate(spec["denominator"]))
    if kind == "derived":
        parts = tuple(spec.get("depends_on", ()))
        return derived(name, str(spec.get("expr", " - ".join(parts))), depends_on=parts)
    where = predicate(spec.get("filter", spec.get("sample_n")))
    return Metric(
        name,
        kind,
        value=str(spec["value"]),
        where=None if where == "*" else where,
        q=float(spec.get("quantile", 0.5)),
        scale=float(spec.get("scale", 1.0)),
    )


def load_specs(path: str | Path) -> dict[str, list[Metric]]:
    """Dataset -> metrics from a YAML or JSON file, by suffix."""
    path = Path(path)
    text = path.read_text(encoding="utf-8")
    if path.suffix.lower() == ".json":
        raw = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as err:  # pragma: no cover
            raise RuntimeError("YAML specs need PyYAML; use JSON instead") from err
        raw = yaml.safe_load(text)
    return {
        dataset: [metric_from_spec(s) for s in specs]
        for dataset, specs in raw.get("stats", {}).items()
    }


# --- additive states --------------------------------------------------------


class States:
    """Shared aggregate states of a metric list, as SQL text.

    Text keeps plan building cheap: one parsed expression per output column.
    """

    def __init__(self, metrics: Iterable[Metric]) -> None:
        self._names: dict[tuple[str, str], str] = {}
        self.finals: list[str] = []
        for m in metrics:
            if m.kind in ADDITIVE:
                self.finals += self._finals(m)
            elif m.kind == "quantile" and m.parts:
                self.finals.append(f"{self._n(m)} AS `{m.name}_n`")

    @property
    def names(self) -> list[str]:
        return list(self._names.values())

    def _state(self, fn: str, text: str) -> str:
        # Named by content, so that lists with common metrics share partials.
        text = " ".join(text.split())
        name = "s" + hashlib.md5(f"{fn}:{text}".encode()).hexdigest()[:12]
        return self._names.setdefault((fn, text), name)

    def _count(self, predicate: str) -> str:
        return self._state("count", predicate)

    def _n(self, m: Metric) -> str:
        present = f"({m.measured}) IS NOT NULL"
        if m.kind == "mean":  # NaN is no value
            present += f" AND NOT isnan({m.measured})"
        return self._count(m.n or present)

    def first_pass(self) -> list[Column]:
        make = {"count": "count_if({})", "sum": "sum({})", "max": "max({})"}

        def sql(fn: str, text: str) -> str:
            if fn in sums.PARTS:
                return sums.states(text)[fn]
            return "count(*)" if (fn, text) == ("count", "*") else make[fn].format(text)

        return [F.expr(sql(fn, text)).alias(name) for (fn, text), name in self._names.items()]

    def prepared(self, df: DataFrame) -> DataFrame:
        """``df`` with the columns that exact sums are taken of."""
        return sums.prepared(df, [text for fn, text in self._names if fn == "whole"])

    def merge(self) -> list[Column]:
        return [
            (F.max(name) if fn == "max" else F.sum(name)).alias(name)
            for (fn, _), name in self._names.items()
        ]

    def _finals(self, m: Metric) -> list[str]:
        scale = "" if m.scale == 1.0 else f"{float(m.scale)!r}D * "
        if m.kind == "count":
            return [f"{self._count(m.num)} AS `{m.name}`"]
        if m.kind == "sum":
            return [f"{scale}coalesce({self._state('sum', m.measured)}, 0) AS `{m.name}`"]
        if m.kind == "rate":
            num, den = self._count(m.num), self._count(m.den)
            out = [f"{scale}{_ratio(num, den)} AS `{m.name}`"]
            if m.parts:
                out += [f"{num} AS `{m.name}_num`", f"{den} AS `{m.name}_den`"]
            return out
        if m.kind == "mean":
            n = self._n(replace(m, n=None))
            value = f"nullif(CAST(({m.measured}) AS DOUBLE), CAST('NaN' AS DOUBLE))"
            added = sums.total({part: self._state(part, value) for part in sums.PARTS})
            out = [f"{scale}{_ratio(added, n)} AS `{m.name}`"]
        else:
            out = [f"{scale}{self._state('max', m.measured)} AS `{m.name}`"]
        if m.parts:
            out.append(f"{self._n(m)} AS `{m.name}_n`")
        return out


def _ratio(num: str, den: str) -> str:
    return f"try_divide(CAST({num} AS DOUBLE), CAST({den} AS DOUBLE))"


def partials(df: DataFrame, keys: Sequence[str], metrics: Sequence[Metric]) -> DataFrame:
    """Additive states at the grain of ``keys``; input of :func:`roll_up`."""
    states = States(metrics)
    placed = lying(df, keys)
    if placed is not None:
        return states.prepared(placed).groupBy(*keys).agg(*states.first_pass())
    return (
        states.prepared(df).groupBy(key_struct(keys))
        .agg(*states.first_pass())
        .select(*unpack(keys), *states.names)
    )


def set_column(m: Metric) -> str:
    """The column of :func:`cells` that holds the values of a distinct count or list."""
    return "_d" + hashlib.md5(" ".join(m.measured.split()).encode()).hexdigest()[:12]


def cells(df: DataFrame, keys: Sequence[str], metrics: Sequence[Metric]) -> DataFrame:
    """Additive states by ``keys`` and by all values that are counted distinct or listed.

    One hash aggregate over the rows; every coarser grain follows from its result, sets
    too. Values stay rows: a fixed-size bitmap of 4 KB for each key and range of numbers
    would outweigh the few values most keys have, and a hot key's values stay spread.
    """
    found = {set_column(m): m.measured for m in metrics if m.kind in SETS}
    placed = lying(df, keys)
    rows = df if placed is None else placed
    valued = rows.selectExpr("*", *[f"{text} AS {name}" for name, text in found.items()])
    if placed is not None:
        lies_by(valued, keys, 0)
    return partials(valued, [*keys, *found], metrics)


def roll_up(parts: DataFrame, keys: Sequence[str], metrics: Sequence[Metric]) -> DataFrame:
    """Metrics at a coarser grain, without going back to the rows.

    From :func:`partials` the additive ones; from :func:`cells` distinct counts and
    lists as well.
    """
    states = States(metrics)
    merged = states.merge() or [F.count("*").alias("s")]
    wide = parts.groupBy(key_struct(keys)).agg(*merged).selectExpr("_g", *states.finals)
    sets = [m for m in metrics if m.kind in SETS]
    if sets:
        wide = wide.join(_sets(parts, keys, [(m, F.col(set_column(m))) for m in sets]), "_g", "left")
    return _publish(_derive(wide, metrics), keys, metrics)


def aggregate(
    df: DataFrame,
    keys: Sequence[str],
    metrics: Sequence[Metric],
    parts: DataFrame | None = None,
) -> DataFrame:
    """All metrics per key combination, columns in spec order.

    With ``parts`` (from :func:`partials` over these metrics or more) the
    additive metrics come from there; only distinct counts and lists (all in one
    pass) and quantiles read ``df``. Rows that lie by ``keys``
    (:func:`~ratebook.operators.staging.lying`) are grouped where they are instead.
    """
    placed = lying(df, keys)
    if placed is not None:
        return in_place(placed, keys, metrics)
    states = States(metrics)
    if parts is None:
        base = states.prepared(df).groupBy(key_struct(keys)).agg(*states.first_pass() or [F.count("*").alias("s")])
    else:
        base = parts.groupBy(key_struct(keys)).agg(*states.merge())
    wide = base.selectExpr("_g", *states.finals)
    sets = [m for m in metrics if m.kind in SETS]
    if sets:
        wide = wide.join(_sets(df, keys, [(m, F.expr(m.measured)) for m in sets]), "_g", "left")
    for interpolation in (NEAREST, LINEAR):
        wanted = {
            m.name: (F.expr(m.measured), m.q)
            for m in metrics
            if m.kind == "quantile" and m.interpolation == interpolation
        }
        if wanted:
            found = grouped_quantiles(df, keys, wanted, interpolation)
            wide = wide.join(found, "_g", "left")
    return _publish(_derive(wide, metrics), keys, metrics)


def in_place(
    df: DataFrame, keys: Sequence[str], metrics: Sequence[Metric], more: Mapping[str, Column] | None = None
) -> DataFrame:
    """:func:`aggregate` of rows that lie by ``keys``: one aggregate and no exchange.

    Such groups are small, so a group's distinct values and its values for quantiles are
    held together. ``more`` are further aggregates and columns of the result.
    """
    states = States(metrics)
    values: dict[str, Column] = {set_column(m): F.expr(m.measured) for m in metrics if m.kind in SETS}
    found = dict(zip(values, _as_text(df, list(values.values()))))
    held = {c: F.collect_set(c) for c in found} | {f"{c}_null": F.count_if(F.col(c).isNull()) for c in found}
    for m in metrics:
        if m.kind == "quantile":
            # -0.0 and 0.0 are one value, as they are where equal values are counted.
            found[_values_of(m)] = F.expr(m.measured).cast("double") + F.lit(0.0)
            held[_values_of(m)] = F.sort_array(F.collect_list(_values_of(m)))
    rows = states.prepared(df.select("*", *[c.alias(name) for name, c in found.items()]))
    beside = [c.alias(name) for name, c in [*held.items(), *(more or {}).items()]]
    grouped = rows.groupBy(*keys).agg(F.count("*").alias("_rows"), *states.first_pass(), *beside)
    out = [F.expr(text) for text in states.finals]
    for m in metrics:
        if m.kind in SETS:
            name = set_column(m)
            if m.kind == "list":
                out.append(F.array_join(F.sort_array(name), m.sep).alias(m.name))
            else:
                null = F.when(F.col(f"{name}_null") > 0, 1).otherwise(0) if m.count_null else F.lit(0)
                out.append((F.size(name) + null).cast("bigint").alias(m.name))
        elif m.kind == "quantile":
            out.append(quantile_of(F.col(_values_of(m)), m.q, m.interpolation).alias(m.name))
    wide = grouped.select(key_struct(keys), *out, *(more or {}))
    return _publish(_derive(wide, metrics), keys, metrics, list(more or {}))


def _values_of(m: Metric) -> str:
    return "_q" + hashlib.md5(" ".join(m.measured.split()).encode()).hexdigest()[:12]


def _as_text(df: DataFrame, values: Sequence[Column]) -> list[Column]:
    """Texts that are equal if and only if the values are."""
    out = []
    for value, kind in zip(values, df.select(*[v.alias(f"v{i}") for i, v in enumerate(values)]).dtypes):
        if kind[1] in ("double", "float"):
            value = F.when(value == 0, F.lit(0.0)).otherwise(value)
        elif kind[1].startswith(("array", "struct", "map", "binary")):
            value = F.to_json(F.struct(value.alias("v")))
        out.append(value.cast("string"))
    return out


def _sets(df: DataFrame, keys: Sequence[str], wanted: Sequence[tuple[Metric, Column]]) -> DataFrame:
    """Exact distinct counts and sorted lists of all ``wanted``, in one pass over ``df``.

    Each (group, value) is one row after the map side's share of the work, dealt by
    both, so a hot group is spread. NULL is one more value when ``count_null``.
    """
    texts = list(dict.fromkeys(set_column(m) for m, _ in wanted))
    values = {set_column(m): c for m, c in wanted}
    rows = df.select(
        key_struct(keys), F.posexplode(F.array(*_as_text(df, [values[t] for t in texts]))).alias("at", "d")
    ).distinct()
    aggs = []
    for m, _ in wanted:
        here = F.col("at") == texts.index(set_column(m))
        if m.kind == "list":
            found = F.sort_array(F.collect_list(F.when(here, F.col("d"))))
            aggs.append(F.array_join(found, m.sep).alias(m.name))
        else:
            aggs.append(F.count_if(here if m.count_null else here & F.col("d").isNotNull()).alias(m.name))
    return rows.groupBy("_g").agg(*aggs)


def _derive(wide: DataFrame, metrics: Sequence[Metric]) -> DataFrame:
    """Add derived metrics; those that use other derived ones come after them."""
    for m in metrics:
        if m.kind == "derived":
            wide = wide.withColumn(m.name, F.expr(m.expr))
    return wide


def _publish(
    wide: DataFrame, keys: Sequence[str], metrics: Sequence[Metric], more: Sequence[str] = ()
) -> DataFrame:
    present = set(wide.columns)
    out: list[str] = []
    for m in metrics:
        if m.hidden:
            continue
        names = [m.name]
        if m.parts:
            names += [f"{m.name}_num", f"{m.name}_den", f"{m.name}_n"]
        out += [n for n in names if n in present]
    return wide.select(*unpack(keys), *out, *more)


def histograms(df: DataFrame, keys: Sequence[str], metrics: Sequence[Metric]) -> DataFrame:
    """keys, metric, value, cnt: how often each value occurs, for all quantile metrics.

    One pass over the rows; merged upwards by :func:`roll_up_quantiles`. NULL is no value.
    """
    found = {m.name: F.expr(m.measured) for m in metrics if m.kind == "quantile"}
    placed = lying(df, keys)
    if placed is not None:
        # Grouped by the plain keys, where the rows are.
        long = long_values(placed, keys, found, [F.col(k) for k in keys]).where("value IS NOT NULL")
        return long.groupBy(*keys, "metric", "value").agg(F.count("*").alias("cnt"))
    counts = compact(long_values(df, keys, found).where("value IS NOT NULL"))
    return counts.select(*unpack(keys), "metric", "value", "cnt")


def roll_up_quantiles(counts: DataFrame, keys: Sequence[str], metrics: Sequence[Metric]) -> DataFrame:
    """Exact quantiles at a coarser grain from :func:`histograms`; groups without values have no row."""
    placed = lying(counts, keys)
    if placed is not None:
        return _quantiles_in_place(placed, keys, [m for m in metrics if m.kind == "quantile"])
    merged = counts.groupBy(key_struct(keys), "metric", "value").agg(F.sum("cnt").alias("cnt"))
    out = None
    for interpolation in (NEAREST, LINEAR):
        wanted = {m.name: m.q for m in metrics if m.kind == "quantile" and m.interpolation == interpolation}
        if wanted:
            rows = merged.where(F.col("metric").isin(list(wanted)))
            table = wide_quantiles(quantile_points(ordered(rows), {n: [q] for n, q in wanted.items()}, interpolation), list(wanted))
            out = table if out is None else out.join(table, "_g", "full")
    names = [m.name for m in metrics if m.kind == "quantile"]
    return out.select(*unpack(keys), *names)


def _quantiles_in_place(counts: DataFrame, keys: Sequence[str], metrics: Sequence[Metric]) -> DataFrame:
    """:func:`roll_up_quantiles` of counts that lie by ``keys``; a group's values are held together."""
    pair = F.struct("value", "cnt")
    held = {f"_v{i}": F.collect_list(F.when(F.col("metric") == m.name, pair)) for i, m in enumerate(metrics)}
    known = counts.where(F.col("metric").isin([m.name for m in metrics]))
    grouped = known.groupBy(*keys).agg(*[c.alias(name) for name, c in held.items()])

    def values(name: str) -> Column:
        each = F.transform(F.col(name), lambda p: F.array_repeat(p["value"], p["cnt"].cast("int")))
        return F.sort_array(F.flatten(each))

    sorted_values = grouped.select(*keys, *[values(name).alias(name) for name in held])
    found = [quantile_of(F.col(name), m.q, m.interpolation).alias(m.name) for name, m in zip(held, metrics)]
    return sorted_values.select(*keys, *found)


def round_floats(df: DataFrame, places: int = 1) -> DataFrame:
    """Half-even rounding of every float column."""
    return df.select(
        *[
            half_even(F.col(f"`{c}`"), places).alias(c)
            if t in ("double", "float")
            else F.col(f"`{c}`")
            for c, t in df.dtypes
        ]
    )
