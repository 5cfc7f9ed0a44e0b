"""The published tables of the full fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.domain import POSITIONS, pitch_tag, position_label
from ..functions.scalar import real_code
from ..operators.grades import apply_grades, grade_thresholds, with_composite
from ..operators.metrics import (
    ADDITIVE,
    SETS,
    Metric,
    aggregate,
    cells,
    histograms,
    in_place,
    partials,
    roll_up,
    roll_up_quantiles,
)
from ..operators.ordered import key_struct
from ..operators.percentiles import percentile_table
from ..operators.staging import lying, stage, stage_beside
from . import specs as S


HITTING_GRAIN = [*S.HITTER_KEYS, "hitting_code"]
PITCHING_GRAIN = [*S.PITCHER_KEYS, "pitch_tag", "pitching_code"]


def position_counts(pitch: DataFrame) -> DataFrame:
    """Plate appearances per fielding position, one column per position.

    The positions are listed, so the pivot needs no extra pass to find them.
    """
    return (
        pitch.select(
            key_struct(S.HITTER_KEYS),
            position_label("batter_position").alias("position"),
            "pa_id",
        )
        .distinct()
        .groupBy("_g")
        .pivot("position", POSITIONS)
        .count()
        .na.fill(0, subset=POSITIONS)
    )


def hitters(pitch: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    placed = lying(pitch, S.HITTER_KEYS)
    if placed is not None:
        return _hitters_in_place(placed)
    table = aggregate(pitch, S.HITTER_KEYS, S.HITTERS, parts)
    return (
        table.withColumn("_g", key_struct(S.HITTER_KEYS))
        .join(position_counts(pitch), "_g", "left")
        .drop("_g")
    )


def _hitters_in_place(pitch: DataFrame) -> DataFrame:
    """:func:`hitters` of rows that lie by hitter: the appearances by position in the same pass."""
    appearance = F.struct(position_label("batter_position").alias("position"), "pa_id")
    table = in_place(pitch, S.HITTER_KEYS, S.HITTERS, {"_seen": F.collect_set(appearance)})

    def at(position: str) -> Column:
        seen = F.filter("_seen", lambda a: a["position"] == position)
        return F.size(seen).cast("bigint").alias(position)

    return table.select("*", *[at(p) for p in POSITIONS]).drop("_seen")


def pitchers(pitch: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    return aggregate(pitch, S.PITCHER_KEYS, S.PITCHERS, parts)


def _tagged(pitch: DataFrame) -> DataFrame:
    return pitch if "pitch_tag" in pitch.columns else pitch.withColumn("pitch_tag", pitch_tag())


def pitch_types(pitch: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    return aggregate(_tagged(pitch), S.PITCH_TYPE_KEYS, S.PITCH_TYPES, parts)


def _coded(df: DataFrame, code: str, numeric_codes: bool) -> DataFrame:
    return df if numeric_codes else df.filter(real_code(code))


def team_hitting(
    pitch: DataFrame, parts: DataFrame | None = None, numeric_codes: bool = False
) -> DataFrame:
    keys = ["hitting_code", "level_id", "season"]
    rows = _coded(pitch, "hitting_code", numeric_codes)
    if parts is not None:
        parts = _coded(parts, "hitting_code", numeric_codes)
    return aggregate(rows, keys, S.TEAM_HITTING, parts)


def league_hitting(pitch: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    return aggregate(pitch, S.LEAGUE_KEYS, S.LEAGUE_HITTING, parts)


def team_pitching(
    pitch: DataFrame, parts: DataFrame | None = None, numeric_codes: bool = False
) -> DataFrame:
    keys = ["pitching_code", "level_id", "season"]
    rows = _coded(pitch, "pitching_code", numeric_codes)
    if parts is not None:
        parts = _coded(parts, "pitching_code", numeric_codes)
    return aggregate(rows, keys, S.TEAM_PITCHING, parts)


def league_pitching(pitch: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    return aggregate(pitch, S.LEAGUE_KEYS, S.LEAGUE_PITCHING, parts)


def hitting_partials(pitch: DataFrame, metrics: list[Metric] | None = None) -> DataFrame:
    """Additive hitting states by player and team: the source of every roll-up."""
    return partials(pitch, HITTING_GRAIN, metrics or [*S.HITTERS, *S.TEAM_HITTING])


def pitching_partials(pitch: DataFrame, metrics: list[Metric] | None = None) -> DataFrame:
    return partials(_tagged(pitch), PITCHING_GRAIN, metrics or [*S.PITCHERS, *S.PITCH_TYPES, *S.TEAM_PITCHING])


def additive(metrics: list[Metric]) -> list[Metric]:
    """The metrics a roll-up of partials can produce, derived ones included if complete."""
    return _complete(metrics, ADDITIVE)


def rolled_up(metrics: list[Metric]) -> list[Metric]:
    """The metrics a roll-up of cells can produce, derived ones included if complete."""
    return _complete(metrics, ADDITIVE | SETS)


def _complete(metrics: list[Metric], kinds: set[str]) -> list[Metric]:
    names = {m.name for m in metrics if m.kind in kinds}
    return [
        m
        for m in metrics
        if m.name in names or (m.kind == "derived" and _uses_only(m, names))
    ]


def _uses_only(m: Metric, names: set[str]) -> bool:
    import re

    words = set(re.findall(r"[A-Za-z_]\w*", m.expr or "")) - {"try_divide", "bround", "D"}
    return words <= names


def multi_grain(pitch: DataFrame, grains: dict[str, list[str]], metrics: list[Metric]) -> DataFrame:
    """Several grains from one scan of the rows: all but quantiles, rolled up from the finest.

    Distinct counts and lists add their values to the keys of the written cells, which
    are read again for each grain in place of the rows; without them nothing is written.
    Result: ``grain`` name, all key columns (NULL where a grain lacks them) and
    the metrics.
    """
    finest = _finest(grains)
    wanted = rolled_up(metrics)
    if any(m.kind in SETS for m in wanted):
        parts = stage_beside(cells(pitch, finest, wanted), lying(pitch, finest))
    else:
        parts = partials(pitch, finest, wanted)
    return _stacked({name: roll_up(parts, keys, wanted) for name, keys in grains.items()})


def multi_grain_quantiles(pitch: DataFrame, grains: dict[str, list[str]], metrics: list[Metric]) -> DataFrame:
    """Exact quantiles at several grains from one scan: value counts of the finest, merged upwards."""
    finest = _finest(grains)
    counts = stage_beside(histograms(pitch, finest, metrics), lying(pitch, finest))
    return _stacked({name: roll_up_quantiles(counts, keys, metrics) for name, keys in grains.items()})


def _finest(grains: dict[str, list[str]]) -> list[str]:
    return list(dict.fromkeys(k for keys in grains.values() for k in keys))


def _stacked(tables: dict[str, DataFrame]) -> DataFrame:
    out: DataFrame | None = None
    for name, table in tables.items():
        table = table.withColumn("grain", F.lit(name))
        out = table if out is None else out.unionByName(table, allowMissingColumns=True)
    return out


def raw_scores(pitch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pitch_tag, stuff_raw (mean) and pitches: input of team/league grades."""
    return (
        _tagged(pitch)
        .groupBy(*keys, "pitch_tag")
        .agg(F.avg("stuff_raw").alias("stuff_raw"), F.count("*").alias("pitches"))
    )


def major_thresholds(pitch: DataFrame, min_pitches: int = 50, min_entities: int = 10) -> DataFrame:
    return grade_thresholds(
        _tagged(pitch),
        level=F.col("level_id") == 1,
        min_rows=min_pitches,
        min_entities=min_entities,
    )


def graded_pitching(
    pitch: DataFrame, min_pitches: int = 50, min_entities: int = 10
) -> dict[str, DataFrame]:
    """Pitch types, pitchers, teams and league with their grades."""
    placed = lying(pitch, S.PITCHER_KEYS)
    # States of rows that lie by pitcher need no exchange: they are not written.
    parts = stage(pitching_partials(pitch)) if placed is None else pitching_partials(pitch)
    limits = stage(major_thresholds(pitch, min_pitches, min_entities))
    types = stage_beside(apply_grades(pitch_types(pitch, parts), limits), placed)
    out = {"pitch_types": types}
    out["pitchers"] = with_composite(
        pitchers(pitch, parts), types, ["pitcher_mlbid", "season", "level_id"]
    )
    for name, table, keys in (
        ("team_pitching", team_pitching(pitch, parts), ["pitching_code", "season", "level_id"]),
        ("league_pitching", league_pitching(pitch, parts), ["season", "level_id"]),
    ):
        out[name] = with_composite(table, apply_grades(raw_scores(pitch, keys), limits), keys)
    return out


def hitter_percentiles(table: DataFrame, mode: str = "quantile_bin", min_pa: float = 200) -> DataFrame:
    return percentile_table(
        table, S.HITTER_KEYS, ["season", "level_id"], S.HITTER_PERCENTILES, mode,
        F.col("PA") >= min_pa,
    )


def pitcher_percentiles(table: DataFrame, mode: str = "quantile_bin", min_ip: float = 40) -> DataFrame:
    return percentile_table(
        table, S.PITCHER_KEYS, ["season", "level_id"], S.PITCHER_PERCENTILES, mode,
        F.col("IP") >= min_ip,
    )


def pitch_type_percentiles(
    table: DataFrame, mode: str = "quantile_bin", min_pitches: float = 100
) -> DataFrame:
    return percentile_table(
        table, S.PITCH_TYPE_KEYS, ["season", "level_id", "pitch_tag"],
        S.PITCH_TYPE_PERCENTILES, mode, F.col("pitches") >= min_pitches,
    )


def all_tables(pitch: DataFrame) -> dict[str, DataFrame]:
    """The ten published tables; ``pitch`` is the written fact.

    Hitters, teams and the league are rolled up from hitter-by-team states, and
    pitchers, teams and the league from pitcher-by-team-and-type states, so the
    wide metric columns of the fact are read once per side.
    """
    parts = stage(hitting_partials(pitch))
    bat = stage(hitters(pitch, parts))
    graded = graded_pitching(pitch)
    graded["pitchers"] = stage(graded["pitchers"])
    return {
        "hitters": bat,
        "pitchers": graded["pitchers"],
        "pitch_types": graded["pitch_types"],
        "team_hitting": team_hitting(pitch, parts),
        "team_pitching": graded["team_pitching"],
        "league_hitting": league_hitting(pitch, parts),
        "league_pitching": graded["league_pitching"],
        "hitter_pctiles": hitter_percentiles(bat),
        "pitcher_pctiles": pitcher_percentiles(graded["pitchers"]),
        "pitch_type_pctiles": pitch_type_percentiles(graded["pitch_types"]),
    }


# Columns a split may be asked for by its published name.
SPLITS = {"hand": "pitcher_hand", "side": "batter_hand", "half": "half_inning", "month": "CAST(month(game_date) AS BIGINT)"}


def splits(pitch: DataFrame, keys: list[str], by: str, metrics: list[Metric]) -> DataFrame:
    """The same metrics with one more group column, ``by``: a name of SPLITS or a column."""
    if by in SPLITS:
        pitch = pitch.withColumn(by, F.expr(SPLITS[by]))
    return aggregate(pitch, [*keys, by], metrics)
