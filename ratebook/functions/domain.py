"""Fixed vocabularies of the pitch domain and the columns derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import as_col, first_match, recode

# --- fixed values -----------------------------------------------------------
# Field position number -> published label.
POSITION_LABELS = {
    1: "P", 2: "C", 3: "X1B", 4: "X2B", 5: "X3B", 6: "SS",
    7: "OF", 8: "OF", 9: "OF", 10: "UT", 11: "UT", 12: "UT",
}
POSITIONS = ["UT", "C", "X1B", "X2B", "X3B", "SS", "OF", "P", "NA"]

# Feed pitch code -> pitch tag.
FEED_TAGS = {
    "SI": "SI", "FC": "HC", "FS": "FS", "FF": "FA", "FA": "FA", "FT": "FA",
    "SL": "SL", "ST": "SL", "SV": "SL", "CU": "CU", "KC": "CU", "CS": "CU",
    "CH": "CH",
}
# Pitch group code -> coarse group.
COARSE_BY_CODE = {"FA": "FA", "SL": "BR", "CU": "BR", "CH": "OFF"}
# Pitch tag -> coarse group.
COARSE_BY_TAG = {
    "FA": "FA", "SI": "FA", "HC": "FA", "SL": "BR", "SW": "BR", "CU": "BR",
    "CH": "OFF", "FS": "OFF",
}
PRIMARY_TAGS = ["FA", "SI", "HC", "SP"]

# Pitch descriptions in the feed.
IN_PLAY = ["hit_into_play", "hit_into_play_no_out", "hit_into_play_score"]
FOULS = ["foul", "foul_tip", "foul_bunt", "foul_pitchout"]
SWINGING_STRIKES = [
    "swinging_strike", "swinging_strike_blocked", "swinging_strike_pitchout",
]
CALLED_STRIKES = ["called_strike", "called_strike_pitchout"]

LEVELS = {"MLB": 1, "Triple-A": 11, "Low-A": 14, "Low Minors": 16}

# Plate and field geometry.
HALF_PLATE = 0.83
HOME_X, HOME_Y = 125.42, 198.27
BREAK_SCALE = 1.8
# --- end of fixed values ----------------------------------------------------


def position_label(code: Column | str) -> Column:
    return recode(as_col(code).cast("int"), POSITION_LABELS, "NA")


def pitch_tag(
    group: Column | str = "pi_pitch_group",
    kind: Column | str = "pi_pitch_type",
    sub: Column | str = "pi_pitch_sub_type",
) -> Column:
    """Nine ordered rules over three source codes, else ``XX``."""
    group, kind, sub = as_col(group), as_col(kind), as_col(sub)
    return first_match(
        [
            (sub == "SW", "SW"),
            (sub == "SP", "SP"),
            (kind == "SI", "SI"),
            ((group == "FA") & (kind == "FC"), "HC"),
            (kind == "FS", "FS"),
            (kind == "FA", "FA"),
            (group == "SL", "SL"),
            (kind == "CH", "CH"),
            (group == "CU", "CU"),
        ],
        "XX",
    )


def feed_tag(code: Column | str) -> Column:
    return recode(code, FEED_TAGS, "XX")


def coarse_group(code: Column | str) -> Column:
    return recode(code, COARSE_BY_CODE, "XX")


def coarse_group_of_tag(tag: Column | str) -> Column:
    return recode(tag, COARSE_BY_TAG, "OTHER")


def in_zone(px: Column | str, pz: Column | str, bottom: Column | str, top: Column | str) -> Column:
    """Box test that is FALSE (not NULL) when any of the four inputs is missing."""
    px, pz, bottom, top = map(as_col, (px, pz, bottom, top))
    inside = (F.abs(px) <= HALF_PLATE) & pz.between(bottom, top)
    return F.coalesce(inside, F.lit(False))


def two_way_code(c: Column | str) -> Column:
    """Handedness as 0/1 in label order (L, R); missing means R."""
    return F.when(F.coalesce(as_col(c), F.lit("R")) == "L", 0).otherwise(1)
