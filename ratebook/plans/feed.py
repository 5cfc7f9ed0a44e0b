"""The published tables of the light feed.

Team and league rows are unweighted means over player rows here, unlike the
pooled tables of the full fact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.domain import POSITIONS
from ..operators.context import against_baseline, usage_share
from ..operators.metrics import (
    Metric,
    aggregate,
    count,
    derived,
    distinct,
    maximum,
    mean,
    quantile,
    rate,
    total,
)
from ..operators.ordered import key_struct
from ..operators.percentiles import percentile_table
from ..operators.relational import ensure_columns, project
from ..operators.staging import stage
from ..operators.sums import exact_sum, prepared

HITTER_KEYS = ["batter_mlbid", "hitter_name", "level_id", "hitting_code", "season"]
PITCHER_KEYS = [
    "pitcher_mlbid", "pitcher_name", "level_id", "season", "pitching_code", "pitcher_hand",
]
PITCH_TYPE_KEYS = [*PITCHER_KEYS, "pitch_tag"]
POSITION_COLUMNS = [p for p in POSITIONS if p != "NA"]
# Scores of models the feed does not have.
ABSENT = ["std.ZQ", "std.DMG", "std.NRV"]

_MEASURED = "is_in_play AND exit_velo > 0"

HITTERS: list[Metric] = [
    count("pitches"),
    distinct("PA", "pa_id"),
    count("bbe", "is_in_play"),
    rate("damage_rate", "damage", "is_in_play"),
    quantile("EV90th", "exit_velo", 0.9, _MEASURED),
    maximum("max_EV", "exit_velo", _MEASURED),
    rate("pull_FB_pct", "is_in_play AND launch_angle > 20 AND spray_angle_adj < -15", "is_in_play"),
    derived("SEAGER", "selection_skill - hittable_pitches_taken"),
    rate("selection_skill", "NOT swing AND decision_value > 0", "decision_value > 0"),
    rate("hittable_pitches_taken", "NOT swing AND decision_value < 0", "NOT swing"),
    rate("chase", "swing AND NOT is_inzone", "NOT is_inzone"),
    rate("z_con", "swing AND is_inzone AND is_contact", "swing AND is_inzone"),
    rate("secondary_whiff_pct", "whiff AND pitch_group <> 'FA'", "swing AND pitch_group <> 'FA'"),
    count("contact_ct", "is_contact"),
    count("swing_ct", "swing"),
]

_OUTCOMES = [
    rate("SwStr", "whiff"),
    rate("Ball_pct", "is_ball"),
    rate("Z_Contact", "swing AND is_inzone AND is_contact", "swing AND is_inzone"),
    rate("Chase", "swing AND NOT is_inzone", "NOT is_inzone"),
    # whiffs and called strikes never overlap
    rate("CSW", "whiff OR called_strike"),
]

PITCHERS: list[Metric] = [
    distinct("TBF", "pa_id"),
    distinct("G", "game_pk", hidden=True),
    derived("TBF_per_G", "try_divide(TBF, G)"),
    count("pitches"),
    total("outs", "outs_on_play", hidden=True),
    derived("IP", "outs / 3D"),
    mean("fastball_velo", "pitch_velo", "pitch_group = 'FA'"),
    maximum("max_velo", "pitch_velo"),
    *_OUTCOMES,
    mean("rel_z", "release_pos_z"),
    mean("rel_x", "release_pos_x"),
    mean("ext", "release_extension"),
]

PITCH_TYPES: list[Metric] = [
    count("pitches"),
    mean("velo", "pitch_velo"),
    maximum("max_velo", "pitch_velo"),
    mean("ivb", "ivb"),
    mean("hb", "hb"),
    *_OUTCOMES,
    rate("Zone", "is_inzone"),
]


def hitter_table(feed: DataFrame, positions: DataFrame | None = None) -> DataFrame:
    """Hitter rows; contact is measured against the league's pooled contact."""
    base = aggregate(feed, HITTER_KEYS, HITTERS)
    base = against_baseline(
        base, ["season", "level_id"], F.col("contact_ct"), F.col("swing_ct"), "contact_vs_avg"
    )
    if positions is not None:
        base = base.join(positions, "batter_mlbid", "left")
    missing = {c: F.lit(0) for c in POSITION_COLUMNS if c not in base.columns}
    base = base.withColumns(missing) if missing else base
    shown = [m.name for m in HITTERS if m.name not in ("contact_ct", "swing_ct")]
    return base.select(*POSITION_COLUMNS, *HITTER_KEYS, *shown, "contact_vs_avg")


def mean_of_players(
    table: DataFrame, keys: Sequence[str], sums: Sequence[str], means: Sequence[str]
) -> DataFrame:
    """Sums of volume columns, unweighted means of the others."""
    return (
        prepared(table, [f"`{c}`" for c in means])
        .groupBy(key_struct(keys))
        .agg(
            *[F.sum(f"`{c}`").alias(c) for c in sums],
            *[F.expr(f"try_divide({exact_sum(f'`{c}`')}, CAST(count(`{c}`) AS DOUBLE))").alias(c) for c in means],
        )
        .select("_g.*", *[f"`{c}`" for c in [*sums, *means]])
    )


_TEAM_MEANS = [
    "damage_rate", "EV90th", "pull_FB_pct", "SEAGER", "selection_skill",
    "hittable_pitches_taken", "chase", "z_con", "contact_vs_avg",
]
_PITCHING_MEANS = ["fastball_velo", "fastball_vaa", "SwStr", "Ball_pct", "Z_Contact", "Chase", "CSW"]


def team_hitting(hitters: DataFrame) -> DataFrame:
    keys = ["hitting_code", "level_id", "season"]
    return mean_of_players(hitters, keys, ["PA", "bbe"], [*_TEAM_MEANS, "secondary_whiff_pct"])


def league_hitting(hitters: DataFrame) -> DataFrame:
    return mean_of_players(hitters, ["level_id", "season"], ["PA", "bbe"], _TEAM_MEANS)


def pitcher_table(feed: DataFrame) -> DataFrame:
    base = aggregate(feed, PITCHER_KEYS, PITCHERS)
    base = ensure_columns(base, {c: "double" for c in [*ABSENT, "fastball_vaa"]})
    return project(
        base,
        [
            "level_id", "TBF_per_G", "pitcher_hand", "pitcher_mlbid", "pitcher_name",
            "season", "pitching_code", "pitches", "TBF", "IP", *ABSENT, "fastball_velo",
            "max_velo", "fastball_vaa", "SwStr", "Ball_pct", "Z_Contact", "Chase", "CSW",
            "rel_z", "rel_x", "ext",
        ],
        {"pitcher_name": "name"},
    )


def team_pitching(pitchers: DataFrame) -> DataFrame:
    keys = ["level_id", "season", "pitching_code"]
    return mean_of_players(pitchers, keys, ["IP"], [*ABSENT, *_PITCHING_MEANS])


def league_pitching(pitchers: DataFrame) -> DataFrame:
    return mean_of_players(pitchers, ["level_id", "season"], [], _PITCHING_MEANS)


def pitch_type_table(feed: DataFrame) -> DataFrame:
    """Pitch types with their true usage share of the pitcher's season."""
    base = aggregate(feed, PITCH_TYPE_KEYS, PITCH_TYPES)
    base = usage_share(base, ["pitcher_mlbid", "level_id", "season"])
    base = ensure_columns(base, {c: "double" for c in [*ABSENT, "vaa", "haa"]})
    return project(
        base,
        [
            "pitcher_name", "level_id", "pitcher_mlbid", "pitcher_hand", "pitching_code",
            "season", "pitches", "pitch_tag", "pct", *ABSENT, "velo", "max_velo", "vaa",
            "haa", "ivb", "hb", "SwStr", "Z_Contact", "Ball_pct", "Zone", "Chase", "CSW",
        ],
        {"pitcher_name": "name"},
    )


HITTER_METRICS = [
    "SEAGER", "selection_skill", "hittable_pitches_taken", "damage_rate", "EV90th",
    "max_EV", "pull_FB_pct", "chase", "z_con", "secondary_whiff_pct", "contact_vs_avg",
]
PITCHER_METRICS = [
    *ABSENT, "fastball_velo", "max_velo", "fastball_vaa", "SwStr", "Ball_pct",
    "Z_Contact", "Chase", "CSW", "rel_z", "rel_x", "ext",
]
PITCH_TYPE_METRICS = [
    "pct", *ABSENT, "velo", "max_velo", "vaa", "haa", "ivb", "hb", "SwStr", "Ball_pct",
    "Zone", "Z_Contact", "Chase", "CSW",
]


def hitter_pctiles(hitters: DataFrame) -> DataFrame:
    keys = HITTER_KEYS
    out = percentile_table(
        hitters, keys, ["season", "level_id"], HITTER_METRICS, "average_rank"
    )
    return project(
        out,
        [
            "batter_mlbid", "hitter_name", "season", "level_id", "hitting_code",
            *[f"{m}_pctile" for m in HITTER_METRICS], "pitches", "bbe", "PA",
        ],
        {
            "selection_skill_pctile": "selection_pctile",
            "hittable_pitches_taken_pctile": "hittable_pitches_pctile",
            "damage_rate_pctile": "damage_pctile",
            "EV90th_pctile": "EV90_pctile",
            "max_EV_pctile": "max_pctile",
            "pull_FB_pct_pctile": "pfb_pctile",
            "secondary_whiff_pct_pctile": "sec_whiff_pctile",
            "contact_vs_avg_pctile": "c_vs_avg_pctile",
        },
    )


# Published names of percentile columns that differ from metric + "_pctile".
_SHORT = {
    "std.ZQ_pctile": "PQ_pctile",
    "std.DMG_pctile": "DMG_pctile",
    "std.NRV_pctile": "NRV_pctile",
    "Ball_pct_pctile": "Ball_pctile",
    "Z_Contact_pctile": "Z_con_pctile",
}


def pitcher_pctiles(pitchers: DataFrame) -> DataFrame:
    keys = ["pitcher_mlbid", "name", "level_id", "season", "pitching_code", "pitcher_hand"]
    out = percentile_table(
        pitchers, keys, ["season", "level_id"], PITCHER_METRICS, "average_rank"
    )
    return project(
        out,
        [
            "pitcher_mlbid", "name", "season", "level_id", "pitching_code",
            *[f"{m}_pctile" for m in PITCHER_METRICS], "TBF", "IP",
        ],
        {
            **_SHORT,
            "fastball_velo_pctile": "FA_velo_pctile",
            "max_velo_pctile": "FA_max_pctile",
            "fastball_vaa_pctile": "FA_vaa_pctile",
            "rel_z_pctile": "rZ_pctile",
            "rel_x_pctile": "rX_pctile",
        },
    )


def pitch_type_pctiles(types: DataFrame) -> DataFrame:
    keys = [
        "pitcher_mlbid", "name", "level_id", "season", "pitching_code", "pitcher_hand",
        "pitch_tag",
    ]
    out = percentile_table(
        types, keys, ["season", "level_id", "pitch_tag"], PITCH_TYPE_METRICS, "average_rank"
    )
    return project(
        out,
        [
            "pitcher_mlbid", "name", "season", "level_id", "pitching_code", "pitch_tag",
            "pitcher_hand", *[f"{m}_pctile" for m in PITCH_TYPE_METRICS], "pitches",
        ],
        {**_SHORT, "pct_pctile": "usage_pctile", "Zone_pctile": "zone_pctile"},
    )


def feed_outputs(feed: DataFrame, positions: DataFrame | None = None) -> dict[str, DataFrame]:
    """Ten tables by name, ready for ``sources.tables.publish``."""
    bat = stage(hitter_table(feed, positions))
    arm = stage(pitcher_table(feed))
    kinds = stage(pitch_type_table(feed))
    return {
        "hitters": bat,
        "team_hitting": team_hitting(bat),
        "hitting_league": league_hitting(bat),
        "pitchers": arm,
        "team_pitching": team_pitching(arm),
        "pitching_league": league_pitching(arm),
        "pitch_types": kinds,
        "hitter_pctiles": hitter_pctiles(bat),
        "pitcher_pctiles": pitcher_pctiles(arm),
        "pitch_type_pctiles": pitch_type_pctiles(kinds),
    }
