"""Published metric lists.

Flags (``swing``, ``whiff``, ``bbe``) are booleans; ``is_inzone_pi`` may be NULL
and then counts neither as inside nor outside. Boundaries differ on purpose
between the tables: ground balls are ``< 0`` for hitters, teams and leagues but
``<= 0`` for pitchers.
"""

from __future__ import annotations

from ..operators.metrics import (
    Metric,
    count,
    derived,
    distinct,
    maximum,
    mean,
    quantile,
    rate,
    sorted_list,
    total,
)

IN_PLAY = "is_in_play"
INSIDE = "is_inzone_pi"
OUTSIDE = "NOT is_inzone_pi"
FAIR = "spray_angle_adj BETWEEN -50 AND 50"
SECONDARY = "pi_pitch_group <> 'FA'"
REAL_CODE = "{0} IS NOT NULL AND NOT {0} RLIKE '^[0-9]+$'"
LOOKING = "pitch_outcome = 'S' AND NOT swing"

HITTER_KEYS = ["batter_mlbid", "hitter_name", "level_id", "season"]
PITCHER_KEYS = ["pitcher_mlbid", "name", "season", "level_id", "pitcher_hand"]
PITCH_TYPE_KEYS = ["name", "level_id", "pitcher_mlbid", "pitcher_hand", "season", "pitch_tag"]
LEAGUE_KEYS = ["level_id", "season"]


def _batted(parts: bool, ground: str) -> list[Metric]:
    return [
        rate("LA_lte_0", f"{IN_PLAY} AND launch_angle {ground} 0", IN_PLAY, parts=parts),
        rate("LD_pct", f"{IN_PLAY} AND launch_angle BETWEEN 0 AND 20", IN_PLAY, parts=parts),
        rate("LA_gte_20", f"{IN_PLAY} AND launch_angle >= 20", IN_PLAY, parts=parts),
    ]


def _plate(z_contact: str, chase: str, parts: bool) -> list[Metric]:
    return [
        rate(chase, f"swing AND {OUTSIDE}", OUTSIDE, parts=parts),
        rate(z_contact, f"swing AND NOT whiff AND {INSIDE}", f"swing AND {INSIDE}", parts=parts),
    ]


def hitting(parts: bool) -> list[Metric]:
    """Rates shared by hitters, teams and leagues."""
    return [
        rate(
            "pull_FB_pct",
            f"{IN_PLAY} AND launch_angle >= 20 AND spray_angle_adj < -15",
            IN_PLAY,
            parts=parts,
        ),
        *_plate("z_con", "chase", parts),
        rate("secondary_whiff_pct", f"whiff AND {SECONDARY}", f"swing AND {SECONDARY}", parts=parts),
        rate("whiffs_vs_95", "whiff AND pitch_velo >= 95", "swing AND pitch_velo >= 95", parts=parts),
        rate(
            "damage_rate",
            f"{IN_PLAY} AND exit_velo >= damage_pred AND launch_angle > 0 AND {FAIR}",
            IN_PLAY,
            parts=parts,
        ),
        rate("selection_skill", "NOT swing AND decision_value > 0", "decision_value > 0", parts=parts),
        rate("hittable_pitches_taken", "NOT swing AND decision_value < 0", "NOT swing", parts=parts),
        mean("pred_whiff_loc_mean", "pred_whiff_loc", "swing", n="swing", parts=parts, hidden=not parts),
        count("whiff_rate_num", "whiff", hidden=not parts),
        count("whiff_rate_den", "swing", hidden=not parts),
        derived(
            "contact_vs_avg",
            "100D * (pred_whiff_loc_mean - try_divide(whiff_rate_num, whiff_rate_den))",
        ),
        *_batted(parts, "<"),
        derived("SEAGER", "selection_skill - hittable_pitches_taken"),
    ]


HITTERS: list[Metric] = [
    count("pitches"),
    distinct("PA", "pa_id"),
    count("bbe", "bbe"),
    quantile("EV90th", "exit_velo", 0.9, n=IN_PLAY, parts=True),
    maximum("max_EV", "exit_velo", n=IN_PLAY, parts=True),
    *hitting(parts=True),
    *[mean(c, c, parts=True) for c in ("bat_speed", "swing_length", "attack_angle", "swing_path_tilt")],
    sorted_list("team", "hitting_code", REAL_CODE.format("hitting_code")),
]

TEAM_HITTING: list[Metric] = [
    distinct("PA", "pa_id"),
    count("bbe", "bbe"),
    quantile("EV90th", "exit_velo", 0.9),
    *hitting(parts=False),
]
LEAGUE_HITTING = TEAM_HITTING

_CALLED_OR_SWINGING = f"whiff OR ({LOOKING})"


def _outcomes(parts: bool) -> list[Metric]:
    return [
        rate("SwStr", "whiff", parts=parts),
        rate("Ball_pct", "is_ball", parts=parts),
        *_plate("Z_Contact", "Chase", parts),
        rate("CSW", _CALLED_OR_SWINGING, parts=parts),
    ]


_OUTS = total("outs", "outs_recorded", hidden=True)
_IP = derived("IP", "bround(outs / 3D, 1)")

PITCHERS: list[Metric] = [
    count("pitches"),
    distinct("TBF", "pa_id"),
    _OUTS,
    _IP,
    distinct("games", "game_pk", hidden=True),
    derived("TBF_per_G", "try_divide(TBF, games)"),
    *_outcomes(parts=True),
    mean("pWhiff", "pred_whiff_base", scale=100.0, parts=True),
    rate("FA_pct", "pitch_group = 'FA'", parts=True),
    mean("BB_rpm", "rpm", "pitch_group = 'BR'", parts=True),
    mean("FA_spin_eff", "spin_efficiency", "pitch_group = 'FA'", parts=True),
    *_batted(True, "<="),
    mean("fastball_velo", "primary_velo", parts=True),
    maximum("max_velo", "pitch_velo", parts=True),
    mean("fastball_vaa", "primary_vaa", parts=True),
    mean("stuff_raw", "stuff_raw", parts=True),
    mean("rel_z", "release_z", parts=True),
    mean("rel_x", "release_x", parts=True),
    mean("ext", "ext", parts=True),
    mean("arm_angle", "arm_angle", parts=True),
    sorted_list("primary_pitches", "primary_tag", sep=", "),
    sorted_list("team", "pitching_code", REAL_CODE.format("pitching_code")),
]

_SHAPE = {
    "stuff_raw": "stuff_raw",
    "velo": "pitch_velo",
    "vaa": "vaa",
    "haa": "haa",
    "vbreak": "vbreak",
    "hbreak": "hbreak",
    "loc_adj_vaa": "loc_adj_vaa",
    "rpm": "rpm",
    "axis": "axis",
    "spin_efficiency": "spin_efficiency",
    "primary_loc_adj_vaa": "primary_loc_adj_vaa",
    "primary_velo": "primary_velo",
    "primary_rpm": "primary_rpm",
    "primary_axis": "primary_axis",
    "primary_hbreak": "primary_hbreak",
    "primary_vbreak": "primary_vbreak",
    "primary_z_release": "primary_z_release",
    "primary_x_release": "primary_x_release",
}

PITCH_TYPES: list[Metric] = [
    count("pitches"),
    # Share as published: rows over the sum of the within-at-bat sequence number.
    total("sequence", "pitch_of_ab", hidden=True),
    derived("pct", "100D * try_divide(pitches, sequence)"),
    *[mean(name, value, parts=True) for name, value in _SHAPE.items()],
    maximum("max_velo", "pitch_velo", parts=True),
    *_outcomes(parts=True),
    mean("pred_whiff_pct", "pred_whiff_base", "swing", scale=100.0, parts=True),
    sorted_list("primary_pitches", "primary_tag", sep=", "),
    sorted_list("team", "pitching_code", REAL_CODE.format("pitching_code")),
]

TEAM_PITCHING: list[Metric] = [
    distinct("TBF", "pa_id"),
    _OUTS,
    _IP,
    count("bbe", "bbe"),
    count("pitches"),
    mean("stuff_raw", "stuff_raw"),
    *_outcomes(parts=False),
    rate("FA_pct", "pitch_group = 'FA'"),
    mean("pWhiff", "pred_whiff_base", scale=100.0),
    *_batted(False, "<"),
    mean("fastball_velo", "primary_velo"),
    mean("fastball_vaa", "primary_vaa"),
]
LEAGUE_PITCHING = TEAM_PITCHING

HITTER_PERCENTILES = [
    "SEAGER", "selection_skill", "hittable_pitches_taken", "damage_rate", "EV90th",
    "max_EV", "pull_FB_pct", "chase", "z_con", "secondary_whiff_pct", "whiffs_vs_95",
    "contact_vs_avg",
]
PITCHER_PERCENTILES = [
    "stuff", "fastball_velo", "max_velo", "fastball_vaa", "SwStr", "Ball_pct",
    "Z_Contact", "Chase", "CSW", "rel_z", "rel_x", "ext",
]
PITCH_TYPE_PERCENTILES = [
    "pct", "stuff", "velo", "max_velo", "vaa", "haa", "vbreak", "hbreak", "SwStr",
    "Ball_pct", "Z_Contact", "Chase", "CSW",
]


# --- lists used for stability and shrinkage ---------------------------------
# Here batted-ball denominators are the bbe flag and line drives are open.

_REG_BATTED = [
    rate("LA_lte_0", "launch_angle <= 0", "bbe"),
    rate("LD_pct", "launch_angle > 0 AND launch_angle < 20", "bbe"),
    rate("LA_gte_20", "launch_angle >= 20", "bbe"),
]
_REG_OUTCOMES = [
    rate("SwStr", "whiff"),
    rate("Ball_pct", "is_ball"),
    rate("Z_Contact", f"NOT whiff AND {INSIDE} AND swing", f"{INSIDE} AND swing"),
    rate("Chase", f"swing AND {OUTSIDE}", OUTSIDE),
    rate("CSW", _CALLED_OR_SWINGING),
]

REGRESSED: dict[str, list[Metric]] = {
    "hitters": [
        rate("pull_FB_pct", "launch_angle >= 20 AND spray_angle_adj < -15", "bbe"),
        rate("chase", f"swing AND {OUTSIDE}", OUTSIDE),
        rate("z_con", f"swing AND {INSIDE} AND NOT whiff", f"swing AND {INSIDE}"),
        rate("secondary_whiff_pct", f"whiff AND {SECONDARY}", f"swing AND {SECONDARY}"),
        rate("whiffs_vs_95", "whiff AND pitch_velo >= 95", "swing AND pitch_velo >= 95"),
        rate(
            "damage_rate",
            f"exit_velo >= damage_pred AND {IN_PLAY} AND launch_angle > 0 AND {FAIR}",
            "bbe",
        ),
        rate("selection_skill", "NOT swing AND decision_value > 0", "decision_value > 0"),
        rate("hittable_pitches_taken", "NOT swing AND decision_value < 0", "NOT swing"),
        mean("pred_whiff_loc_mean", "pred_whiff_loc", "swing", scale=100.0),
        *_REG_BATTED,
        quantile("EV90th", "exit_velo", 0.9, "bbe"),
        maximum("max_EV", "exit_velo", "bbe"),
        *[mean(c, c, "swing") for c in ("bat_speed", "swing_length", "attack_angle", "swing_path_tilt")],
        derived(
            "SEAGER",
            "selection_skill - hittable_pitches_taken",
            depends_on=("selection_skill", "hittable_pitches_taken"),
        ),
    ],
    "pitchers": [
        *_REG_OUTCOMES,
        mean("pWhiff", "pred_whiff_base", "swing", scale=100.0),
        rate("FA_pct", "pi_pitch_group = 'FA'"),
        *_REG_BATTED,
        mean("BB_rpm", "rpm", "pi_pitch_group IN ('CU', 'SL')"),
        mean("FA_spin_eff", "spin_efficiency", "pi_pitch_group = 'FA'"),
        mean("fastball_velo", "primary_velo", "pi_pitch_group = 'FA'"),
        maximum("max_velo", "pitch_velo"),
        mean("fastball_vaa", "primary_vaa", "pi_pitch_group = 'FA'"),
        mean("stuff_raw", "stuff_raw"),
        mean("rel_z", "release_z"),
        mean("rel_x", "release_x"),
        mean("ext", "ext"),
        mean("arm_angle", "arm_angle"),
    ],
    "pitch_types": [
        *_REG_OUTCOMES,
        mean("pred_whiff_pct", "pred_whiff_base", "swing", scale=100.0),
        *[mean(name, value) for name, value in _SHAPE.items()],
        maximum("max_velo", "pitch_velo"),
    ],
}

REGRESSED_KEYS = {
    "hitters": ["batter_mlbid", "season", "level_id"],
    "pitchers": ["pitcher_mlbid", "season", "level_id"],
    "pitch_types": ["pitcher_mlbid", "season", "level_id", "pitch_tag"],
}
REGRESSED_META = {
    "hitters": ["hitter_name"],
    "pitchers": ["name", "pitcher_hand"],
    "pitch_types": ["name", "pitcher_hand"],
}
# Means that are proportions and published as percentages.
PERCENT_MEANS = {"pWhiff", "pred_whiff_pct", "pred_whiff_loc_mean"}
