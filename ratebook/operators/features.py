"""Row features of the two input layouts: the full fact and the light feed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import domain as D
from ..functions.scalar import clip, glue, mirror, ratio, spray_angle, spray_angle_simple

# Model outputs; NULL until a model fills them.
MODEL_OUTPUTS = [
    "xwt", "xgb_woba", "damage_pred", "decision_value",
    "pred_whiff_loc", "pred_whiff_base", "stuff_raw",
]

# Sensor value -> source columns, best first.
SENSOR_LADDER = {
    "x": ["px_corr", "px_adj", "px_orig"],
    "z": ["pz_corr", "pz_adj", "pz_orig"],
    "haa": ["x_angle_plate_adj", "x_angle_plate_corr"],
    "vaa": ["z_angle_plate_adj", "z_angle_plate_corr"],
    "pitch_velo": ["start_speed_55_corr", "start_speed_55_adj", "start_speed_orig"],
    "end_velo": ["end_speed_orig", "end_speed_adj", "end_speed_corr"],
    "plate_time": ["plate_time_orig"],
    "x_angle_release": ["x_angle_release_adj", "x_angle_release_corr"],
    "z_angle_release": ["z_angle_release_adj", "z_angle_release_corr"],
    "ext": ["extension_orig", "60.5D - y_release_adj", "60.5D - y_release_corr"],
    "rpm": ["obs_spin_rate_orig", "obs_spin_rate_corr"],
    "inf_rpm": ["inf_spin_rate_corr", "inf_spin_rate_adj", "inf_spin_rate_orig"],
    "pfx_x_short": ["pfx_x_corr", "pfx_x_adj"],
    "pfx_z_short": ["pfx_z_corr", "pfx_z_adj"],
    "x55": ["x55_corr", "x55_adj"],
    "z55": ["z55_corr", "z55_adj"],
    "release_x": ["x_release_corr", "x_release_adj"],
    "release_z": ["z_release_corr", "z_release_adj"],
    "axis": ["obs_spin_axis_orig", "obs_spin_axis_corr"],
    "inf_axis": ["inf_spin_axis_corr", "inf_spin_axis_adj", "inf_spin_axis_orig"],
    "ax": ["ax_adj", "ax_corr"],
    "ay": ["ay_adj", "ay_corr"],
    "az": ["az_adj", "az_corr"],
}


def first_sensor(name: str, ladder: Mapping[str, Sequence[str]] = SENSOR_LADDER) -> Column:
    return F.coalesce(*[F.expr(source) for source in ladder[name]]).alias(name)


def read_sensors(df: DataFrame, ladder: Mapping[str, Sequence[str]] = SENSOR_LADDER) -> DataFrame:
    """Replace the sensor source columns by their first non-NULL value."""
    sources = {s for rungs in ladder.values() for s in rungs}
    kept = [F.col(c) for c in df.columns if c not in sources and c not in ladder]
    return df.select(*kept, *[first_sensor(n, ladder) for n in ladder])


def _team(side_is_home: Column) -> Column:
    home = F.coalesce("home_team", F.col("home_mlbid").cast("string"))
    away = F.coalesce("away_team", F.col("away_mlbid").cast("string"))
    return F.when(side_is_home, home).otherwise(away)


def add_features(df: DataFrame) -> DataFrame:
    """All derived columns of the full fact, in two projections.

    Flags are booleans and FALSE where their inputs are missing.
    """
    left = F.col("batter_hand") == "L"
    bottom = F.coalesce(F.col("half_inning") == "bottom", F.lit(False))
    swing = F.coalesce(F.col("swing_type") == "swing", F.lit(False))
    flag = lambda c: F.coalesce(c, F.lit(False))
    batter = glue("batter_name_first", "batter_name_last", sep=" ")
    pitcher = glue("pitcher_name_first", "pitcher_name_last", sep=" ")
    features = {
        "hc_x_adj": F.col("hc_x") - D.HOME_X,
        "hc_y_adj": F.lit(D.HOME_Y) - F.col("hc_y"),
        "spray_angle_adj": mirror(
            spray_angle(F.col("hc_x") - D.HOME_X, F.lit(D.HOME_Y) - F.col("hc_y")), left
        ),
        "hitter_name": batter,
        "pitcher_name": pitcher,
        "name": pitcher,
        "x_adj": mirror("x", left),
        "release_x_adj": mirror("release_x", left),
        "haa_adj": mirror("haa", left),
        "pfx_x_short_adj": mirror("pfx_x_short", left),
        "pitch_group": D.coarse_group("pi_pitch_group"),
        "pitch_tag": D.pitch_tag(),
        "hitting_code": _team(bottom),
        "pitching_code": _team(~bottom),
        "balls": F.col("balls_before"),
        "strikes": F.col("strikes_before"),
        "throws": F.col("pitcher_hand"),
        "stands": F.col("batter_hand"),
        "outs_recorded": F.col("outs_end") - F.col("outs_start"),
        "swing": swing,
        "is_swing": swing,
        "whiff": flag(~F.col("is_contact") & (F.col("swing_type") == "swing")),
        "bbe": flag(F.col("is_in_play")),
        "bb": flag((F.col("pitch_outcome") == "B") & (F.col("balls_before") == 3)),
        "k": flag((F.col("pitch_outcome") == "S") & (F.col("strikes_before") == 2)),
        "vbreak": F.lit(D.BREAK_SCALE) * F.col("pfx_z_short"),
        "hbreak": F.lit(D.BREAK_SCALE) * F.col("pfx_x_short"),
        "pa_id": glue("game_pk", "at_bat_index", sep="_"),
        "count": glue("balls_before", "strikes_before", sep="-"),
        "spin_efficiency": clip(ratio("inf_rpm", "rpm"), 0, 1),
    }
    empty = {
        c: F.lit(None).cast("double") for c in MODEL_OUTPUTS if c not in df.columns
    }
    return df.withColumns({**features, **empty})


# Columns the light feed must have; the reader adds absent ones as NULL.
FEED_COLUMNS = {
    "game_pk": "bigint", "game_date": "string", "game_type": "string",
    "inning_topbot": "string", "home_team": "string", "away_team": "string",
    "batter": "bigint", "pitcher": "bigint", "stand": "string", "p_throws": "string",
    "events": "string", "description": "string", "type": "string",
    "launch_speed": "double", "launch_angle": "double", "hc_x": "double",
    "hc_y": "double", "plate_x": "double", "plate_z": "double", "sz_top": "double",
    "sz_bot": "double", "pitch_type": "string", "release_speed": "double",
    "release_pos_x": "double", "release_pos_z": "double",
    "release_extension": "double", "pfx_x": "double", "pfx_z": "double",
    "outs_on_play": "bigint", "at_bat_number": "bigint", "player_name": "string",
    "batter_name": "string",
}


def add_feed_features(
    df: DataFrame, season: int | Column, level_id: int | Column = 1, damage_ev: float = 95.0
) -> DataFrame:
    """Derived columns of the light feed."""
    left = F.col("stand") == "L"
    home_bats = F.coalesce(F.col("inning_topbot") == "Bot", F.lit(False))
    swing = F.col("description").isin(*D.FOULS, *D.SWINGING_STRIKES, *D.IN_PLAY)
    contact = F.col("description").isin(*D.FOULS, *D.IN_PLAY)
    dx, dy = F.col("hc_x") - D.HOME_X, F.lit(D.HOME_Y) - F.col("hc_y")
    spray = spray_angle_simple(F.when(F.col("hc_y").isNotNull(), dx), dy)
    fair = mirror(spray, left).between(-50, 50)
    tag = D.feed_tag("pitch_type")
    as_lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    out = {
        "game_date": F.try_to_date(F.col("game_date"), "yyyy-MM-dd"),
        "batter_hand": F.col("stand"),
        "pitcher_hand": F.col("p_throws"),
        "batter_mlbid": F.col("batter"),
        "pitcher_mlbid": F.col("pitcher"),
        "exit_velo": F.col("launch_speed"),
        "pitch_velo": F.col("release_speed"),
        "hitting_code": F.when(home_bats, F.col("home_team")).otherwise(F.col("away_team")),
        "pitching_code": F.when(home_bats, F.col("away_team")).otherwise(F.col("home_team")),
        "hitter_name": F.coalesce("batter_name", F.col("batter").cast("string")),
        "pitcher_name": F.coalesce("player_name", F.col("pitcher").cast("string")),
        "level_id": as_lit(level_id),
        "season": as_lit(season),
        "spray_angle": spray,
        "spray_angle_adj": mirror(spray, left),
        "is_in_play": F.col("description").isin(*D.IN_PLAY),
        "swing": swing,
        "is_contact": contact,
        "whiff": swing & ~contact,
        "called_strike": F.col("description").isin(*D.CALLED_STRIKES),
        "is_ball": F.col("type") == "B",
        "is_inzone": D.in_zone("plate_x", "plate_z", "sz_bot", "sz_top"),
        "pitch_tag": tag,
        "pitch_group": D.coarse_group_of_tag(tag),
        "damage": (F.col("launch_speed") >= damage_ev) & (F.col("launch_angle") > 0) & fair,
        "ivb": F.lit(D.BREAK_SCALE) * F.col("pfx_z"),
        "hb": F.lit(D.BREAK_SCALE) * F.col("pfx_x"),
        "hb_orig": F.lit(D.BREAK_SCALE) * F.col("pfx_x"),
        "pa_id": glue("game_pk", "at_bat_number", sep="-"),
    }
    if "decision_value" not in df.columns:
        out["decision_value"] = F.lit(None).cast("double")
    return df.withColumns(out)


def pitch_group_from(
    df: DataFrame, sources: Sequence[str], groups: Mapping[str, Sequence[str]], default: str
) -> DataFrame:
    """``pitch_group`` from the first of ``sources`` that exists."""
    found = next((c for c in sources if c in df.columns), None)
    if found is None:
        raise ValueError(f"none of the columns {list(sources)} exists")
    chain = F.when(F.lit(False), F.lit(default))
    for group, codes in groups.items():
        chain = chain.when(F.col(found).isin(list(codes)), F.lit(group))
    return df.withColumn("pitch_group", chain.otherwise(F.lit(default)))
