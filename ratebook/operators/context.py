"""Per-entity context brought back to the rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.domain import PRIMARY_TAGS
from ..functions.scalar import percent, ratio
from .joins import attach
from .ordered import key_struct
from .staging import stage

PITCHER_SEASON = ["pitcher_mlbid", "level_id", "season"]
HITTER_SEASON = ["batter_mlbid", "level_id", "season"]

# Context column -> measured column.
PITCHER_AVERAGES = {
    "avg_release_z": "release_z",
    "avg_release_x": "release_x",
    "avg_ext": "ext",
    "avg_arm_angle": "arm_angle",
}
PRIMARY_AVERAGES = {
    "primary_velo": "pitch_velo",
    "primary_vbreak": "vbreak",
    "primary_hbreak": "hbreak",
    "primary_vaa": "vaa",
    "primary_loc_adj_vaa": "loc_adj_vaa",
    "primary_z_release": "z_angle_release",
    "primary_x_release": "x_angle_release",
    "primary_rpm": "rpm",
    "primary_axis": "axis",
}


def group_means(
    df: DataFrame, keys: Sequence[str], columns: Mapping[str, str]
) -> DataFrame:
    """Each row plus its group's means; groups are aggregated map-side first."""
    means = df.groupBy(*keys).agg(*[F.avg(c).alias(n) for n, c in columns.items()])
    return attach(df, means, keys)


def add_pitcher_context(df: DataFrame) -> DataFrame:
    return group_means(df, PITCHER_SEASON, PITCHER_AVERAGES)


MOST_FREQUENT, FIRST_NAME = "most_frequent", "first_alpha"


def primary_category(
    df: DataFrame,
    keys: Sequence[str],
    category: str,
    allowed: Sequence[str],
    mode: str = MOST_FREQUENT,
) -> DataFrame:
    """keys + ``primary_tag``: the group's main category among ``allowed``.

    ``most_frequent`` takes the largest count, ties to the smaller name;
    ``first_alpha`` the alphabetically first category that occurs.
    """
    seen = df.filter(F.col(category).isin(list(allowed)))
    if mode == FIRST_NAME:
        return seen.groupBy(*keys).agg(F.min(category).alias("primary_tag"))
    if mode != MOST_FREQUENT:
        raise ValueError(f"unknown mode {mode!r}")
    counts = seen.groupBy(*keys, category).agg(F.count("*").alias("n"))
    best = F.min_by(category, F.struct((-F.col("n")).alias("less"), category))
    return counts.groupBy(*keys).agg(best.alias("primary_tag"))


def primary_context(
    df: DataFrame,
    keys: Sequence[str],
    category: str,
    allowed: Sequence[str],
    columns: Mapping[str, str],
    mode: str = MOST_FREQUENT,
) -> DataFrame:
    """Rows plus the primary category of their group and its mean measures.

    Per-category sums are taken once; the primary category and its means both
    come from that small table, so the rows are read twice and joined once.
    """
    per_tag = (
        df.filter(F.col(category).isin(list(allowed)))
        .groupBy(*keys, category)
        .agg(F.count("*").alias("n"), *[F.avg(c).alias(n) for n, c in columns.items()])
    )
    first = F.struct(category) if mode == FIRST_NAME else F.struct((-F.col("n")).alias("less"), category)
    row = F.struct(F.col(category).alias("primary_tag"), *columns)
    best = per_tag.groupBy(*keys).agg(F.min_by(row, first).alias("p")).select(*keys, "p.*")
    return attach(df, best, keys)


def add_primary_pitch_context(df: DataFrame, mode: str = MOST_FREQUENT) -> DataFrame:
    return primary_context(
        df, [*PITCHER_SEASON, "stands"], "pitch_tag", PRIMARY_TAGS, PRIMARY_AVERAGES, mode
    )


PITCH_GROUP = [*PITCHER_SEASON, "stands"]


def pitch_contexts(df: DataFrame, mode: str = MOST_FREQUENT) -> DataFrame:
    """``_g`` (PITCH_GROUP) with the columns of both contexts of a pitch.

    Sums by pitcher, season, side and category are taken in one pass over the rows; the
    pitcher's averages, the primary category and its means all come from that small table.
    As in a join, a NULL pitcher, level or season has no context and a NULL side no
    primary pitch.
    """
    measured = {**PITCHER_AVERAGES, **PRIMARY_AVERAGES}
    per_tag = (
        df.where(" AND ".join(f"{k} IS NOT NULL" for k in PITCHER_SEASON))
        .groupBy(*PITCH_GROUP, "pitch_tag")
        .agg(
            F.count("*").alias("n"),
            *[F.sum(F.col(c).cast("double")).alias(f"_s_{n}") for n, c in measured.items()],
            *[F.count(c).alias(f"_n_{n}") for n, c in measured.items()],
        )
    )
    sides = per_tag.groupBy(*PITCH_GROUP).agg(
        *[F.sum(f"_{p}_{n}").alias(f"_{p}_{n}") for n in PITCHER_AVERAGES for p in "sn"],
        F.min_by(_primary_row(), _primary_first(mode)).alias("p"),
    )
    # A pitcher's season has a row for each side, so these windows hold a few rows.
    season = Window.partitionBy(*PITCHER_SEASON)
    known = F.col("stands").isNotNull()
    return sides.select(
        key_struct(PITCH_GROUP),
        *[ratio(F.sum(f"_s_{n}").over(season), F.sum(f"_n_{n}").over(season)).alias(n) for n in PITCHER_AVERAGES],
        *[F.when(known, F.col(f"p.{n}")).alias(n) for n in ["primary_tag", *PRIMARY_AVERAGES]],
    )


def _primary_row() -> Column:
    means = [ratio(F.col(f"_s_{n}"), F.col(f"_n_{n}")).alias(n) for n in PRIMARY_AVERAGES]
    return F.struct(F.col("pitch_tag").alias("primary_tag"), *means)


def _primary_first(mode: str, n: str = "n") -> Column:
    if mode not in (MOST_FREQUENT, FIRST_NAME):
        raise ValueError(f"unknown mode {mode!r}")
    order = F.struct("pitch_tag") if mode == FIRST_NAME else F.struct((-F.col(n)).alias("less"), "pitch_tag")
    return F.when(F.col("pitch_tag").isin(list(PRIMARY_TAGS)), order)


def attach_contexts(df: DataFrame, contexts: DataFrame) -> DataFrame:
    """Rows plus the :func:`pitch_contexts` of their group, by one join."""
    return attach(df.withColumn("_g", key_struct(PITCH_GROUP)), contexts, ["_g"]).drop("_g")


def add_pitch_contexts(df: DataFrame, mode: str = MOST_FREQUENT) -> DataFrame:
    """Both contexts: :func:`add_pitcher_context`, then :func:`add_primary_pitch_context`.

    The rows are read twice and joined once, in place of four reads and two joins.
    """
    return attach_contexts(df, pitch_contexts(df, mode))


# Rows from which a pitcher's season is taken out of the exchange by season.
HOT_ROWS = 1 << 20
# Rows from which a season is too large for its values to be held together.
HELD_ROWS = 1 << 18
# One row in this many is counted to find such seasons.
COUNTED = 64


def season_contexts(
    df: DataFrame,
    mode: str = MOST_FREQUENT,
    measured: Callable[[DataFrame], DataFrame] = lambda df: df,
    placed: bool = False,
) -> DataFrame:
    """Rows plus both contexts of a pitch, by one exchange of the rows.

    The rows of a pitcher's season meet in one task, where windows give the averages, the
    primary category and its means, so that no states and no second copy of the rows are
    exchanged. ``df`` has PITCHER_SEASON, none of them NULL; ``measured`` keeps its columns
    and adds the measured ones behind the exchange, so that they do not travel. Rows that are
    ``placed`` (bucketed by PITCHER_SEASON) are not exchanged.
    """
    names = df.columns
    rows = measured(df if placed else df.repartition(*PITCHER_SEASON))
    season, side = Window.partitionBy(*PITCHER_SEASON), Window.partitionBy(*PITCH_GROUP)
    tag = Window.partitionBy(*PITCH_GROUP, "pitch_tag")

    def mean(c: str, window: Window) -> Column:
        return ratio(F.sum(F.col(c).cast("double")).over(window), F.count(c).over(window))

    of_tag = F.struct(F.col("pitch_tag").alias("primary_tag"), *[mean(c, tag).alias(n) for n, c in PRIMARY_AVERAGES.items()])
    tagged = rows.select("*", F.count("*").over(tag).alias("_n"), of_tag.alias("_tag"))
    sided = tagged.select("*", F.min_by("_tag", _primary_first(mode, "_n")).over(side).alias("_p"))
    known = F.col("stands").isNotNull()
    return sided.select(
        *names,
        *[mean(c, season).alias(n) for n, c in PITCHER_AVERAGES.items()],
        *[F.when(known, F.col(f"_p.{n}")).alias(n) for n in ["primary_tag", *PRIMARY_AVERAGES]],
    )


def hot_seasons(
    df: DataFrame, rows: int = HOT_ROWS, counted: int = COUNTED, keys: Sequence[str] = PITCHER_SEASON
) -> DataFrame:
    """PITCHER_SEASON (or other ``keys``) of the seasons with about ``rows`` rows or more.

    A sample is counted: it decides only how a season's contexts are found, not what they are.
    """
    some = df.select(*keys) if counted == 1 else df.select(*keys).sample(1.0 / counted, 7)
    return some.groupBy(*keys).count().filter(F.col("count") * counted >= rows).drop("count")


def add_season_contexts(
    df: DataFrame,
    mode: str = MOST_FREQUENT,
    measured: Callable[[DataFrame], DataFrame] = lambda df: df,
    hot: DataFrame | None = None,
    placed: bool = False,
) -> DataFrame:
    """:func:`add_pitch_contexts` by one exchange of the rows and none of their states.

    Very large seasons (``hot``, at most one in HOT_ROWS rows) and rows without a pitcher,
    level or season stay where they are: their contexts are attached.
    """
    names = df.columns
    hot = stage(hot_seasons(df) if hot is None else hot).withColumn("_hot", F.lit(True))
    marked = df.join(F.broadcast(hot), PITCHER_SEASON, "left")
    alone = "_hot IS NULL AND " + " AND ".join(f"{k} IS NOT NULL" for k in PITCHER_SEASON)
    rows = season_contexts(marked.filter(alone).select(*names), mode, measured, placed)
    crowd = measured(marked.filter(f"NOT ({alone})").select(*names))
    return rows.unionByName(attach_contexts(crowd, pitch_contexts(crowd, mode)).select(*rows.columns))


def usage_share(
    table: DataFrame, owner: Sequence[str], rows: str = "pitches", name: str = "pct"
) -> DataFrame:
    """Share of each category row in its owner's total, as a percentage.

    ``table`` is already aggregated (a few categories per owner).
    """
    whole = F.sum(rows).over(Window.partitionBy(*owner))
    return table.withColumn(name, percent(F.col(rows), whole))


def against_baseline(
    table: DataFrame,
    group: Sequence[str],
    num: Column,
    den: Column,
    name: str,
) -> DataFrame:
    """100 * (num/den - group's pooled num/den), the league baseline removed."""
    baseline = table.groupBy(*group).agg(ratio(F.sum(num), F.sum(den)).alias("_base"))
    return (
        attach(table, baseline, group)
        .withColumn(name, F.lit(100.0) * (ratio(num, den) - F.col("_base")))
        .drop("_base")
    )
