"""DuckDB SQL with the same results as the registered queries.

Written from the definitions, independently of the Spark plans: quantiles by
sorted lists, ranks by window functions, one CTE per step.
"""

from __future__ import annotations

from ratebook.plans.boards import BOARDS, HITTER_FEATURES, PITCHER_FEATURES

from .fixtures import FEED_RAW, OBS, OFF_HALF, PITCH_RAW, WIDE_RANGE

ORACLE: dict[str, str] = {}

WITH_OBS = f"WITH obs AS ({OBS})"
ENT = "entity_id, season, level_id"


def r(expr: str, places: int = 6) -> str:
    """Rounded like ``queries.rounded``: halves moved off the rounding boundary."""
    return f"round(CAST({expr} AS DOUBLE) + {OFF_HALF:.13f}::DOUBLE, {places})"


def cnt(pred: str) -> str:
    return "count(*)" if pred == "*" else f"count(*) FILTER (WHERE {pred})"


def frac(num: str, den: str = "*") -> str:
    return f"({cnt(num)} / nullif({cnt(den)}, 0)::DOUBLE)"


def pct(num: str, den: str = "*") -> str:
    return f"(100e0 * {frac(num, den)})"


def where(value: str, pred: str | None) -> str:
    return value if pred is None else f"(CASE WHEN {pred} THEN {value} END)"


def exact(v: str, pred: str | None = None) -> str:
    """A mean of an exact sum: parts of 24 bits added as whole doubles, carries settled at the end."""
    v = where(v, pred)
    m = f"(CASE WHEN abs({v}) < 1125899906842624 AND (abs({v}) >= 9.5367431640625e-7 OR {v} = 0) THEN {v} ELSE 0e0 END)"
    fine = f"(({m} - trunc({m})) * 281474976710656e0)"
    high = f"trunc(trunc({fine}) / 16777216e0)"
    above = f"trunc(trunc({m}) / 16777216e0)"
    top, l0, l1 = f"sum({above})", f"sum(trunc({m}) - {above} * 16777216e0)", f"sum({high})"
    l2, l3 = f"sum(trunc({fine}) - {high} * 16777216e0)", f"sum(trunc(({fine} - trunc({fine})) * 16777216e0))"
    s2 = f"({l2} + floor({l3} / 16777216e0))"
    s1 = f"({l1} + floor({s2} / 16777216e0))"
    s0 = f"({l0} + floor({s1} / 16777216e0))"
    st = f"({top} + floor({s0} / 16777216e0))"
    rest = [f"({s} - floor({s} / 16777216e0) * 16777216e0)" for s in (l3, s2, s1, s0)]
    beyond = f"coalesce(sum({v}) FILTER (WHERE {v} <> {m}), 0e0)"
    parts = f"{{'a': {st} * 16777216e0 + {rest[3]}, 'b': {rest[2]} * {2.0**-24!r} + {rest[1]} * {2.0**-48!r}, 'r': {rest[0]} * {2.0**-72!r}}}"
    added = f"(list_transform([{parts}], lambda v: v.a + v.b + ((v.b - ((v.a + v.b) - v.a)) + v.r))[1] + {beyond})"
    return f"({added} / nullif(count({v}), 0))"


def nearest(v: str, q: float) -> str:
    return (
        f"(list_sort(list({v}) FILTER (WHERE {v} IS NOT NULL)))"
        f"[CAST(round((count({v}) - 1) * {q}::DOUBLE) AS BIGINT) + 1]"
    )


def sig(expr: str) -> str:
    """Ten significant digits: K has no fixed scale (up to variance / 1e-8)."""
    return f"CAST(printf('%.9e', CAST({expr} AS DOUBLE)) AS DOUBLE)"


def items(pairs: list[tuple[str, str]]) -> str:
    return ", ".join(f"{sig(e) if n in WIDE_RANGE else r(e)} AS {n}" for n, e in pairs)


# --- aggregates -----------------------------------------------------------------

ORACLE["entity_rates"] = f"""{WITH_OBS}
SELECT {ENT}, count(*) AS pitches,
  {r(pct('miss', 'attempt'))} AS miss_rate, {cnt('miss')} AS miss_rate_num, {cnt('attempt')} AS miss_rate_den,
  {r(pct('attempt AND NOT in_zone', 'NOT in_zone'))} AS chase,
  {cnt('attempt AND NOT in_zone')} AS chase_num, {cnt('NOT in_zone')} AS chase_den,
  {r('avg(v1) FILTER (WHERE attempt)')} AS v1_mean, count(v1) FILTER (WHERE attempt) AS v1_mean_n,
  {r('max(v2)')} AS v2_max
FROM obs GROUP BY ALL"""

_V2A = where("v2", "attempt")
ORACLE["entity_quantile_nearest"] = f"""{WITH_OBS}
SELECT {ENT}, {r(nearest('v1', 0.9))} AS v1_q90, count(v1) AS v1_q90_n, {r(nearest(_V2A, 0.1))} AS v2_q10
FROM obs GROUP BY ALL"""

ORACLE["group_quantiles"] = f"""{WITH_OBS}
SELECT level_id, {r(nearest('v2', 0.9))} AS v2_near, {r('quantile_cont(v2, 0.95)')} AS v2_lin,
  {r('median(v1)')} AS v1_median FROM obs GROUP BY ALL"""

ORACLE["entity_values"] = f"""{WITH_OBS}
SELECT {ENT}, {r('coalesce(sum(v1), 0)')} AS v1_sum, {r('avg(v1)')} AS v1_mean, {r('max(v2)')} AS v2_max,
  count(v1) AS v1_n, {r('var_samp(v1)')} AS v1_var, {r('stddev_samp(v1)')} AS v1_std,
  {r('stddev_pop(v1)')} AS v1_std_pop FROM obs GROUP BY ALL"""

ORACLE["distinct_with_null"] = f"""{WITH_OBS}, z AS (SELECT *, CASE WHEN in_zone THEN side END AS zone FROM obs)
SELECT team, level_id, count(DISTINCT unit_id) AS units,
  count(DISTINCT zone) + max(CASE WHEN zone IS NULL THEN 1 ELSE 0 END)::BIGINT AS zones,
  count(DISTINCT zone) AS zones_known FROM z GROUP BY ALL"""

ORACLE["distinct_ratio"] = f"""{WITH_OBS}
SELECT {ENT}, count(DISTINCT unit_id) AS units, count(DISTINCT game_id) AS games,
  {r('count(DISTINCT unit_id) / count(DISTINCT game_id)::DOUBLE')} AS units_per_game FROM obs GROUP BY ALL"""

_TAGS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD", "ABSENT"]
ORACLE["entity_categories_pivot"] = f"""{WITH_OBS}
SELECT entity_id, season, {', '.join(f"count(DISTINCT unit_id) FILTER (WHERE tag_src = '{t}') AS {t}" for t in _TAGS)}
FROM obs GROUP BY ALL"""

ORACLE["entity_team_list"] = f"""{WITH_OBS}, c AS (SELECT *, replace(team, 'Brand#1', '') AS code FROM obs)
SELECT entity_id, season, coalesce(string_agg(DISTINCT code, ' | ' ORDER BY code)
  FILTER (WHERE code IS NOT NULL AND NOT regexp_matches(code, '^[0-9]+$')), '') AS teams
FROM c GROUP BY ALL"""

_OBS_COLS = f"""count(*) AS pitches,
  {r(pct('miss', 'attempt'))} AS miss_rate, {cnt('miss')} AS miss_rate_num, {cnt('attempt')} AS miss_rate_den,
  {r(pct('attempt AND NOT in_zone', 'NOT in_zone'))} AS chase,
  {cnt('attempt AND NOT in_zone')} AS chase_num, {cnt('NOT in_zone')} AS chase_den,
  {r('avg(v1) FILTER (WHERE attempt)')} AS v1_mean, count(v1) FILTER (WHERE attempt) AS v1_mean_n,
  {r('max(v2)')} AS v2_max"""
ORACLE["group_rollup_pooled"] = f"{WITH_OBS} SELECT team, season, {_OBS_COLS} FROM obs GROUP BY ALL"

_ENTITY_TABLE = f"""SELECT {ENT}, count(*) AS pitches, {pct('miss', 'attempt')} AS miss_rate,
  {cnt('miss')} AS miss_rate_num, {cnt('attempt')} AS miss_rate_den,
  {pct('attempt AND NOT in_zone', 'NOT in_zone')} AS chase,
  avg(v1) FILTER (WHERE attempt) AS v1_mean, max(v2) AS v2_max FROM obs GROUP BY ALL"""
WITH_TABLE = f"{WITH_OBS}, t AS ({_ENTITY_TABLE})"

ORACLE["group_rollup_mean_of_entities"] = f"""{WITH_TABLE}
SELECT season, level_id, sum(pitches)::BIGINT AS pitches, {r('avg(miss_rate)')} AS miss_rate,
  {r('avg(chase)')} AS chase, {r('avg(v1_mean)')} AS v1_mean FROM t GROUP BY ALL"""

_SCALE = "CASE seq % 5 WHEN 0 THEN 1e-300 WHEN 1 THEN 1e-13 WHEN 2 THEN 1e0 WHEN 3 THEN 1e17 ELSE 1e300 END"
ORACLE["mean_exact"] = f"""{WITH_OBS}
SELECT team, seq % 5 AS scale, {sig(f'avg(v1 / 1000e0 * {_SCALE})')} AS mean_wide, count(v1) AS mean_wide_n,
  {r("avg(CASE WHEN seq = 7 AND team < 'Brand#3' THEN 'inf'::DOUBLE ELSE v1 END)")} AS mean_mixed, {r('avg(v1 - 100)')} AS mean_signed
FROM obs GROUP BY ALL"""

ORACLE["multi_grain"] = f"""{WITH_OBS}
SELECT CASE WHEN grouping(entity_id) = 0 THEN 'entity' WHEN grouping(team) = 0 THEN 'team'
            WHEN grouping(season) = 0 THEN 'league' ELSE 'all' END AS grain,
  entity_id, team, season, {_OBS_COLS}
FROM obs GROUP BY GROUPING SETS ((entity_id, season), (team, season), (season), ())"""

ORACLE["tag_table_usage"] = f"""{WITH_OBS}
SELECT entity_id, season, tag_src, count(*) AS pitches,
  {r('100e0 * count(*) / sum(count(*)) OVER (PARTITION BY entity_id, season)')} AS pct
FROM obs GROUP BY entity_id, season, tag_src"""

ORACLE["weighted_mean"] = f"""{WITH_OBS}
SELECT team, {r('sum(v1 * seq) / sum(seq)')} AS kept_weight,
  {r('sum(v1 * seq) / sum(seq) FILTER (WHERE v1 IS NOT NULL)')} AS dropped_weight FROM obs GROUP BY ALL"""

# --- the full fact ----------------------------------------------------------------

_ANGLE = "degrees(atan2(hc_x - 125.42, 198.27 - hc_y)) * 0.75"


def _mirror(c: str) -> str:
    return f"CASE WHEN batter_hand = 'L' THEN -({c}) ELSE {c} END"


_TAG = """CASE WHEN pi_pitch_sub_type = 'SW' THEN 'SW' WHEN pi_pitch_sub_type = 'SP' THEN 'SP'
  WHEN pi_pitch_type = 'SI' THEN 'SI' WHEN pi_pitch_group = 'FA' AND pi_pitch_type = 'FC' THEN 'HC'
  WHEN pi_pitch_type = 'FS' THEN 'FS' WHEN pi_pitch_type = 'FA' THEN 'FA'
  WHEN pi_pitch_group = 'SL' THEN 'SL' WHEN pi_pitch_type = 'CH' THEN 'CH'
  WHEN pi_pitch_group = 'CU' THEN 'CU' ELSE 'XX' END"""
_HOME = "coalesce(home_team, CAST(home_mlbid AS VARCHAR))"
_AWAY = "coalesce(away_team, CAST(away_mlbid AS VARCHAR))"

_FEATURES = f"""SELECT *, {_mirror(_ANGLE)} AS spray_angle_adj,
  batter_name_first || ' ' || batter_name_last AS hitter_name,
  pitcher_name_first || ' ' || pitcher_name_last AS name,
  {_mirror('x')} AS x_adj, {_mirror('release_x')} AS release_x_adj, {_mirror('haa')} AS haa_adj,
  {_mirror('pfx_x_short')} AS pfx_x_short_adj,
  CASE WHEN pi_pitch_group = 'FA' THEN 'FA' WHEN pi_pitch_group IN ('SL', 'CU') THEN 'BR'
       WHEN pi_pitch_group = 'CH' THEN 'OFF' ELSE 'XX' END AS pitch_group,
  {_TAG} AS pitch_tag,
  CASE WHEN half_inning = 'bottom' THEN {_HOME} ELSE {_AWAY} END AS hitting_code,
  CASE WHEN half_inning = 'bottom' THEN {_AWAY} ELSE {_HOME} END AS pitching_code,
  balls_before AS balls, strikes_before AS strikes, pitcher_hand AS throws, batter_hand AS stands,
  outs_end - outs_start AS outs_recorded,
  swing_type = 'swing' AS swing,
  coalesce(swing_type = 'swing' AND NOT is_contact, FALSE) AS whiff,
  coalesce(is_in_play, FALSE) AS bbe,
  coalesce(pitch_outcome = 'B' AND balls_before = 3, FALSE) AS bb,
  coalesce(pitch_outcome = 'S' AND strikes_before = 2, FALSE) AS k,
  1.8e0 * pfx_z_short AS vbreak, 1.8e0 * pfx_x_short AS hbreak,
  CAST(game_pk AS VARCHAR) || '_' || CAST(at_bat_index AS VARCHAR) AS pa_id,
  CAST(balls_before AS VARCHAR) || '-' || CAST(strikes_before AS VARCHAR) AS count,
  CASE WHEN inf_rpm / nullif(rpm, 0) > 1 THEN 1 WHEN inf_rpm / nullif(rpm, 0) < 0 THEN 0
       ELSE inf_rpm / nullif(rpm, 0) END AS spin_efficiency,
  CASE WHEN batter_position IN (1) THEN 'P' WHEN batter_position = 2 THEN 'C'
       WHEN batter_position = 3 THEN 'X1B' WHEN batter_position = 4 THEN 'X2B'
       WHEN batter_position = 5 THEN 'X3B' WHEN batter_position = 6 THEN 'SS'
       WHEN batter_position BETWEEN 7 AND 9 THEN 'OF' WHEN batter_position BETWEEN 10 AND 12 THEN 'UT'
       ELSE 'NA' END AS position
FROM raw"""

_PRIMARY = {
    "primary_velo": "pitch_velo", "primary_vbreak": "vbreak", "primary_hbreak": "hbreak",
    "primary_vaa": "vaa", "primary_loc_adj_vaa": "loc_adj_vaa",
    "primary_z_release": "z_angle_release", "primary_x_release": "x_angle_release",
    "primary_rpm": "rpm", "primary_axis": "axis",
}
_OWNER = "pitcher_mlbid, level_id, season, stands"


def with_pitch(adjusted: str = "vaa") -> str:
    means = ", ".join(f"avg({v}) AS {k}" for k, v in _PRIMARY.items())
    same = " AND ".join(f"f.{k} = b.{k}" for k in _OWNER.split(", "))
    return f"""WITH raw AS ({PITCH_RAW}), feat0 AS ({_FEATURES}),
feat AS (SELECT *, {adjusted} AS loc_adj_vaa FROM feat0),
kinds AS (SELECT {_OWNER}, pitch_tag, count(*) AS n, {means} FROM feat
  WHERE pitch_tag IN ('FA', 'SI', 'HC', 'SP') GROUP BY {_OWNER}, pitch_tag),
best AS (SELECT * FROM kinds QUALIFY row_number() OVER (PARTITION BY {_OWNER} ORDER BY n DESC, pitch_tag) = 1),
pitch AS (SELECT f.*, b.pitch_tag AS primary_tag, {', '.join('b.' + k for k in _PRIMARY)}
  FROM feat f LEFT JOIN best b ON {same})"""


WITH_PITCH = with_pitch()

IP, INZ, OUTZ = "is_in_play", "is_inzone_pi", "NOT is_inzone_pi"
_LOOK = "whiff OR (pitch_outcome = 'S' AND NOT swing)"
_BATTED = lambda low: [
    ("LA_lte_0", f"{IP} AND launch_angle {low} 0", IP),
    ("LD_pct", f"{IP} AND launch_angle >= 0 AND launch_angle <= 20", IP),
    ("LA_gte_20", f"{IP} AND launch_angle >= 20", IP),
]
_DAMAGE = f"{IP} AND exit_velo >= damage_pred AND launch_angle > 0 AND spray_angle_adj >= -50 AND spray_angle_adj <= 50"
_HIT_RATES = [
    ("pull_FB_pct", f"{IP} AND launch_angle >= 20 AND spray_angle_adj < -15", IP),
    ("chase", f"swing AND {OUTZ}", OUTZ),
    ("z_con", f"swing AND NOT whiff AND {INZ}", f"swing AND {INZ}"),
    ("secondary_whiff_pct", "whiff AND pi_pitch_group <> 'FA'", "swing AND pi_pitch_group <> 'FA'"),
    ("whiffs_vs_95", "whiff AND pitch_velo >= 95", "swing AND pitch_velo >= 95"),
    ("damage_rate", _DAMAGE, IP),
    ("selection_skill", "decision_value > 0 AND NOT swing", "decision_value > 0"),
    ("hittable_pitches_taken", "decision_value < 0 AND NOT swing", "NOT swing"),
    *_BATTED("<"),
]
_LOC = exact("pred_whiff_loc", "swing")
_CONTACT = f"100e0 * ({_LOC} - {frac('whiff', 'swing')})"
_SEAGER = (
    f"{pct('decision_value > 0 AND NOT swing', 'decision_value > 0')} - "
    f"{pct('decision_value < 0 AND NOT swing', 'NOT swing')}"
)


def _rates(rates, rd, parts=True):
    out = []
    for n, a, b in rates:
        e = pct(a, b)
        out.append(f"{r(e) if rd else e} AS {n}")
        if parts:
            out += [f"{cnt(a)} AS {n}_num", f"{cnt(b)} AS {n}_den"]
    return out


def _means(pairs, rd, parts=True):
    out = []
    for n, v, p, scale in pairs:
        e = f"{scale}e0 * {exact(v, p)}"
        out.append(f"{r(e) if rd else e} AS {n}")
        if parts:
            out.append(f"count({where(v, p)}) AS {n}_n")
    return out


def _list(v: str, sep: str, real: bool) -> str:
    keep = f"{v} IS NOT NULL" + (f" AND NOT regexp_matches({v}, '^[0-9]+$')" if real else "")
    return f"coalesce(string_agg(DISTINCT {v}, '{sep}' ORDER BY {v}) FILTER (WHERE {keep}), '')"


HKEYS = "batter_mlbid, hitter_name, level_id, season"
_POS = ["UT", "C", "X1B", "X2B", "X3B", "SS", "OF", "P", "NA"]


def hitters_sql(rd: bool = True) -> str:
    w = (lambda e: r(e)) if rd else (lambda e: e)
    cols = [
        "count(*) AS pitches", "count(DISTINCT pa_id) AS PA", f"{cnt('bbe')} AS bbe",
        f"{w(nearest('exit_velo', 0.9))} AS EV90th", f"{w('max(exit_velo)')} AS max_EV",
        f"{cnt(IP)} AS EV90th_n", f"{cnt(IP)} AS max_EV_n",
        *_rates(_HIT_RATES, rd),
        f"{w(_LOC)} AS pred_whiff_loc_mean", f"{cnt('swing')} AS pred_whiff_loc_mean_n",
        f"{cnt('whiff')} AS whiff_rate_num", f"{cnt('swing')} AS whiff_rate_den",
        f"{w(_CONTACT)} AS contact_vs_avg", f"{w(_SEAGER)} AS SEAGER",
        *_means([(c, c, None, 1) for c in ("bat_speed", "swing_length", "attack_angle", "swing_path_tilt")], rd),
        f"{_list('hitting_code', ' | ', True)} AS team",
        *[f"count(DISTINCT pa_id) FILTER (WHERE position = '{p}') AS {p}" for p in _POS],
    ]
    return f"SELECT {HKEYS}, {', '.join(cols)} FROM pitch GROUP BY {HKEYS}"


PKEYS = "pitcher_mlbid, name, season, level_id, pitcher_hand"
_OUT = [
    ("SwStr", "whiff", "*"), ("Ball_pct", "is_ball", "*"),
    ("Z_Contact", f"swing AND NOT whiff AND {INZ}", f"swing AND {INZ}"),
    ("Chase", f"swing AND {OUTZ}", OUTZ), ("CSW", _LOOK, "*"),
]
_FA = [("FA_pct", "pitch_group = 'FA'", "*")]
_IPX = "round_even(coalesce(sum(outs_recorded), 0) / 3e0, 1)"


def pitchers_sql(rd: bool = True) -> str:
    w = (lambda e: r(e)) if rd else (lambda e: e)
    cols = [
        "count(*) AS pitches", "count(DISTINCT pa_id) AS TBF", f"{w(_IPX)} AS IP",
        f"{w('count(DISTINCT pa_id) / count(DISTINCT game_pk)::DOUBLE')} AS TBF_per_G",
        *_rates(_OUT + _FA + _BATTED("<="), rd),
        *_means(
            [
                ("pWhiff", "pred_whiff_base", None, 100), ("BB_rpm", "rpm", "pitch_group = 'BR'", 1),
                ("FA_spin_eff", "spin_efficiency", "pitch_group = 'FA'", 1),
                ("fastball_velo", "primary_velo", None, 1), ("fastball_vaa", "primary_vaa", None, 1),
                ("stuff_raw", "stuff_raw", None, 1), ("rel_z", "release_z", None, 1),
                ("rel_x", "release_x", None, 1), ("ext", "ext", None, 1), ("arm_angle", "arm_angle", None, 1),
            ],
            rd,
        ),
        f"{w('max(pitch_velo)')} AS max_velo", "count(pitch_velo) AS max_velo_n",
        f"{_list('primary_tag', ', ', False)} AS primary_pitches",
        f"{_list('pitching_code', ' | ', True)} AS team",
    ]
    return f"SELECT {PKEYS}, {', '.join(cols)} FROM pitch GROUP BY {PKEYS}"


TKEYS = "name, level_id, pitcher_mlbid, pitcher_hand, season, pitch_tag"
_SHAPE = [
    ("stuff_raw", "stuff_raw"), ("velo", "pitch_velo"), ("vaa", "vaa"), ("haa", "haa"), ("vbreak", "vbreak"),
    ("hbreak", "hbreak"), ("loc_adj_vaa", "loc_adj_vaa"), ("rpm", "rpm"), ("axis", "axis"),
    ("spin_efficiency", "spin_efficiency"), ("primary_loc_adj_vaa", "primary_loc_adj_vaa"),
    ("primary_velo", "primary_velo"), ("primary_rpm", "primary_rpm"), ("primary_axis", "primary_axis"),
    ("primary_hbreak", "primary_hbreak"), ("primary_vbreak", "primary_vbreak"),
    ("primary_z_release", "primary_z_release"), ("primary_x_release", "primary_x_release"),
]


def pitch_types_sql(rd: bool = True) -> str:
    w = (lambda e: r(e)) if rd else (lambda e: e)
    cols = [
        "count(*) AS pitches", f"{w('100e0 * (count(*) / sum(pitch_of_ab)::DOUBLE)')} AS pct",
        *_means([(n, v, None, 1) for n, v in _SHAPE], rd),
        f"{w('max(pitch_velo)')} AS max_velo", "count(pitch_velo) AS max_velo_n",
        *_rates(_OUT, rd), *_means([("pred_whiff_pct", "pred_whiff_base", "swing", 100)], rd),
        f"{_list('primary_tag', ', ', False)} AS primary_pitches",
        f"{_list('pitching_code', ' | ', True)} AS team",
    ]
    return f"SELECT {TKEYS}, {', '.join(cols)} FROM pitch GROUP BY {TKEYS}"


_GRAINS = ("((pitcher_mlbid, pitching_code, level_id, season), (pitching_code, level_id, season), (level_id, season))")
_GRAIN = """CASE WHEN grouping(pitcher_mlbid) = 0 THEN 'player' WHEN grouping(pitching_code) = 0 THEN 'team' ELSE 'league' END AS grain,
  pitcher_mlbid, pitching_code, level_id, season"""
_PA_WITH_NULL = "(count(DISTINCT pa_id) + max(CASE WHEN pa_id IS NULL THEN 1 ELSE 0 END))::BIGINT"
ORACLE["multi_grain_sets"] = f"""{WITH_PITCH}
SELECT {_GRAIN}, count(*) AS pitches, {_PA_WITH_NULL} AS TBF, count(DISTINCT game_pk) AS games,
  count(DISTINCT CASE WHEN swing THEN pa_id END) AS swung_PA,
  {r(f'{_PA_WITH_NULL} / count(DISTINCT game_pk)::DOUBLE')} AS TBF_per_G, {r(exact('pitch_velo'))} AS velo,
  coalesce(string_agg(DISTINCT pitch_tag, ', ' ORDER BY pitch_tag), '') AS tags
FROM pitch GROUP BY GROUPING SETS {_GRAINS}"""
_EV_UP = where("exit_velo", "launch_angle > 0")
ORACLE["multi_grain_quantiles"] = f"""{WITH_PITCH}
SELECT {_GRAIN}, {r(nearest('pitch_velo', 0.9))} AS velo_q90, {r('median(pitch_velo)')} AS velo_median,
  {r(nearest(_EV_UP, 0.9))} AS exit_q90, {r('quantile_cont(stuff_raw, 0.1)')} AS stuff_q10
FROM pitch GROUP BY GROUPING SETS {_GRAINS}
HAVING count(pitch_velo) + count({_EV_UP}) + count(stuff_raw) > 0"""

ORACLE["hitters"] = f"{WITH_PITCH} {hitters_sql()}"
ORACLE["pitchers"] = f"{WITH_PITCH} {pitchers_sql()}"
ORACLE["pitch_types"] = f"{WITH_PITCH} {pitch_types_sql()}"


def group_hitting_sql(keys: str, code: str | None, quantile: bool = True) -> str:
    cols = [
        "count(DISTINCT pa_id) AS PA", f"{cnt('bbe')} AS bbe", *_rates(_HIT_RATES, True, False),
        f"{r(_CONTACT)} AS contact_vs_avg", f"{r(_SEAGER)} AS SEAGER",
    ]
    if quantile:
        cols.append(f"{r(nearest('exit_velo', 0.9))} AS EV90th")
    real = f"WHERE {code} IS NOT NULL AND NOT regexp_matches({code}, '^[0-9]+$')" if code else ""
    return f"SELECT {keys}, {', '.join(cols)} FROM pitch {real} GROUP BY {keys}"


def group_pitching_sql(keys: str, code: str | None, rd: bool = True) -> str:
    w = (lambda e: r(e)) if rd else (lambda e: e)
    cols = [
        "count(DISTINCT pa_id) AS TBF", f"{w(_IPX)} AS IP", f"{cnt('bbe')} AS bbe", "count(*) AS pitches",
        *_means([("stuff_raw", "stuff_raw", None, 1), ("pWhiff", "pred_whiff_base", None, 100),
                 ("fastball_velo", "primary_velo", None, 1), ("fastball_vaa", "primary_vaa", None, 1)], rd, False),
        *_rates(_OUT + _FA + _BATTED("<"), rd, False),
    ]
    real = f"WHERE {code} IS NOT NULL AND NOT regexp_matches({code}, '^[0-9]+$')" if code else ""
    return f"SELECT {keys}, {', '.join(cols)} FROM pitch {real} GROUP BY {keys}"


ORACLE["team_hitting"] = f"{WITH_PITCH} {group_hitting_sql('hitting_code, level_id, season', 'hitting_code')}"
ORACLE["team_hitting_all_codes"] = f"{WITH_PITCH} {group_hitting_sql('hitting_code, level_id, season', None)}"
ORACLE["league_hitting"] = f"{WITH_PITCH} {group_hitting_sql('level_id, season', None)}"
ORACLE["team_pitching"] = f"{WITH_PITCH} {group_pitching_sql('pitching_code, level_id, season', 'pitching_code')}"
ORACLE["league_pitching"] = f"{WITH_PITCH} {group_pitching_sql('level_id, season', None)}"
ORACLE["split_by_hand"] = f"{WITH_PITCH} {group_hitting_sql('level_id, season, pitcher_hand', None, False)}"
for _by, _column in (("side", "batter_hand"), ("half", "half_inning"), ("month", "month(game_date)")):
    _split = group_hitting_sql(f"level_id, season, {_by}", None, False).replace("FROM pitch", "FROM parted")
    ORACLE[f"split_by_{_by}"] = f"{WITH_PITCH}, parted AS (SELECT *, {_column} AS {_by} FROM pitch) {_split}"
ORACLE["league_pitch_types"] = f"""{WITH_PITCH}
SELECT season, level_id, pitch_tag, count(*) AS pitches,
  {', '.join(_means([(n, v, None, 1) for n, v in _SHAPE], True))},
  {r('max(pitch_velo)')} AS max_velo, count(pitch_velo) AS max_velo_n, {', '.join(_rates(_OUT, True))},
  {', '.join(_means([("pred_whiff_pct", "pred_whiff_base", "swing", 100)], True))}
FROM pitch GROUP BY season, level_id, pitch_tag"""

# --- the light feed ---------------------------------------------------------------

_SPRAY = "atan((hc_x - 125.42) / nullif(198.27 - hc_y, 0)) * (180e0 / 3.14159265e0 * 0.75e0)"
_FEED_FEATURES = f"""SELECT *, CAST(game_date AS DATE) AS day,
  CASE WHEN inning_topbot = 'Bot' THEN home_team ELSE away_team END AS hitting_code,
  CASE WHEN inning_topbot = 'Bot' THEN away_team ELSE home_team END AS pitching_code,
  coalesce(batter_name, CAST(batter AS VARCHAR)) AS hitter_name,
  coalesce(player_name, CAST(pitcher AS VARCHAR)) AS pitcher_name,
  1 AS level_id, feed_season AS season, batter AS batter_mlbid, pitcher AS pitcher_mlbid,
  p_throws AS pitcher_hand, launch_speed AS exit_velo, release_speed AS pitch_velo,
  {_SPRAY} AS spray_angle, CASE WHEN stand = 'L' THEN -({_SPRAY}) ELSE {_SPRAY} END AS spray_angle_adj,
  description IN ('hit_into_play', 'hit_into_play_no_out', 'hit_into_play_score') AS is_in_play,
  description IN ('foul', 'foul_tip', 'foul_bunt', 'foul_pitchout', 'swinging_strike',
    'swinging_strike_blocked', 'swinging_strike_pitchout', 'hit_into_play', 'hit_into_play_no_out',
    'hit_into_play_score') AS swing,
  description IN ('foul', 'foul_tip', 'foul_bunt', 'foul_pitchout', 'hit_into_play',
    'hit_into_play_no_out', 'hit_into_play_score') AS is_contact,
  description IN ('called_strike', 'called_strike_pitchout') AS called_strike, type = 'B' AS is_ball,
  coalesce(abs(plate_x) <= 0.83 AND plate_z >= sz_bot AND plate_z <= sz_top, FALSE) AS is_inzone,
  CASE WHEN pitch_type = 'SI' THEN 'SI' WHEN pitch_type = 'FC' THEN 'HC' WHEN pitch_type = 'FS' THEN 'FS'
       WHEN pitch_type IN ('FF', 'FA', 'FT') THEN 'FA' WHEN pitch_type IN ('SL', 'ST', 'SV') THEN 'SL'
       WHEN pitch_type IN ('CU', 'KC', 'CS') THEN 'CU' WHEN pitch_type = 'CH' THEN 'CH' ELSE 'XX' END AS pitch_tag,
  1.8e0 * pfx_z AS ivb, 1.8e0 * pfx_x AS hb,
  CAST(game_pk AS VARCHAR) || '-' || CAST(at_bat_number AS VARCHAR) AS pa_id FROM raw"""
WITH_FEED = f"""WITH raw AS ({FEED_RAW}), f0 AS ({_FEED_FEATURES}),
feed AS (SELECT *, CASE WHEN pitch_tag IN ('FA', 'SI', 'HC') THEN 'FA' WHEN pitch_tag IN ('SL', 'SW', 'CU') THEN 'BR'
   WHEN pitch_tag IN ('CH', 'FS') THEN 'OFF' ELSE 'OTHER' END AS pitch_group,
  exit_velo >= 95 AND launch_angle > 0 AND spray_angle_adj >= -50 AND spray_angle_adj <= 50 AS damage,
  swing AND NOT is_contact AS whiff FROM f0)"""

_FH = "batter_mlbid, hitter_name, level_id, hitting_code, season"
_FEV = where("exit_velo", "is_in_play AND exit_velo > 0")
_FSEL = pct("decision_value > 0 AND NOT swing", "decision_value > 0")
_FBAD = pct("decision_value < 0 AND NOT swing", "NOT swing")
_FEED_HITTERS = f"""SELECT {_FH}, count(*) AS pitches, count(DISTINCT pa_id) AS PA, {cnt('is_in_play')} AS bbe,
  {pct('damage', 'is_in_play')} AS damage_rate, {nearest(_FEV, 0.9)} AS EV90th, max({_FEV}) AS max_EV,
  {pct('launch_angle > 20 AND spray_angle_adj < -15 AND is_in_play', 'is_in_play')} AS pull_FB_pct,
  {_FSEL} - {_FBAD} AS SEAGER, {_FSEL} AS selection_skill, {_FBAD} AS hittable_pitches_taken,
  {pct('swing AND NOT is_inzone', 'NOT is_inzone')} AS chase,
  {pct('swing AND is_inzone AND is_contact', 'swing AND is_inzone')} AS z_con,
  {pct("whiff AND pitch_group <> 'FA'", "swing AND pitch_group <> 'FA'")} AS secondary_whiff_pct,
  {cnt('is_contact')} AS cc, {cnt('swing')} AS sc FROM feed GROUP BY {_FH}"""
_FH_METRICS = [
    "damage_rate", "EV90th", "max_EV", "pull_FB_pct", "SEAGER", "selection_skill", "hittable_pitches_taken",
    "chase", "z_con", "secondary_whiff_pct", "contact_vs_avg",
]
WITH_FH = f"""{WITH_FEED}, h0 AS ({_FEED_HITTERS}),
h AS (SELECT *, 100e0 * (cc / nullif(sc, 0)::DOUBLE
  - sum(cc) OVER (PARTITION BY season, level_id) / sum(sc) OVER (PARTITION BY season, level_id)::DOUBLE) AS contact_vs_avg
  FROM h0)"""
_ZERO = ", ".join(f"0 AS {p}" for p in _POS if p != "NA")
ORACLE["feed_hitters"] = f"""{WITH_FH} SELECT {_ZERO}, {_FH}, pitches, PA, bbe,
  {', '.join(f'{r(m)} AS {m}' for m in _FH_METRICS)} FROM h"""
ORACLE["feed_hitters_with_positions"] = f"""{WITH_FH}
SELECT h.batter_mlbid, hitter_name, season, hitting_code, pitches, 0 AS UT, 0 AS X1B, 0 AS X2B, 0 AS X3B,
  0 AS SS, CAST(s_nationkey AS BIGINT) AS "OF", 0 AS P, CASE WHEN s_suppkey IS NOT NULL THEN 1 END AS C
FROM h LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 3 <> 0) s ON h.batter_mlbid = s.s_suppkey"""
_TM = ["damage_rate", "EV90th", "pull_FB_pct", "SEAGER", "selection_skill", "hittable_pitches_taken", "chase",
       "z_con", "contact_vs_avg"]


def _mean_of(src: str, keys: str, sums: list[str], means: list[str]) -> str:
    return (
        f"SELECT {keys}, " + ", ".join(
            [f"sum({s})::BIGINT AS {s}" if s != "IP" else f"{r('sum(IP)')} AS IP" for s in sums]
            + [f"{r(f'avg({m})')} AS {m}" for m in means]
        ) + f" FROM {src} GROUP BY {keys}"
    )


ORACLE["feed_team_hitting"] = f"{WITH_FH} " + _mean_of(
    "h", "hitting_code, level_id, season", ["PA", "bbe"], [*_TM, "secondary_whiff_pct"])
ORACLE["feed_league_hitting"] = f"{WITH_FH} " + _mean_of("h", "level_id, season", ["PA", "bbe"], _TM)

_FP = "pitcher_mlbid, pitcher_name, level_id, season, pitching_code, pitcher_hand"
_FOUT = [
    ("SwStr", "whiff", "*"), ("Ball_pct", "is_ball", "*"),
    ("Z_Contact", "swing AND is_inzone AND is_contact", "swing AND is_inzone"),
    ("Chase", "swing AND NOT is_inzone", "NOT is_inzone"),
]
_FCSW = pct("whiff OR called_strike")
_ABSENT = 'CAST(NULL AS DOUBLE) AS "std.ZQ", CAST(NULL AS DOUBLE) AS "std.DMG", CAST(NULL AS DOUBLE) AS "std.NRV"'
_FEED_PITCHERS = f"""SELECT level_id, pitcher_hand, pitcher_mlbid, pitcher_name AS name, season, pitching_code,
  count(DISTINCT pa_id) / count(DISTINCT game_pk)::DOUBLE AS TBF_per_G, count(*) AS pitches,
  count(DISTINCT pa_id) AS TBF, sum(outs_on_play) / 3e0 AS IP, {_ABSENT},
  {exact('pitch_velo', "pitch_group = 'FA'")} AS fastball_velo, max(pitch_velo) AS max_velo,
  CAST(NULL AS DOUBLE) AS fastball_vaa, {', '.join(_rates(_FOUT, False, False))}, {_FCSW} AS CSW,
  {exact('release_pos_z')} AS rel_z, {exact('release_pos_x')} AS rel_x, {exact('release_extension')} AS ext
FROM feed GROUP BY {_FP}"""
WITH_FP = f"{WITH_FEED}, p AS ({_FEED_PITCHERS})"
_FPM = ["TBF_per_G", "IP", '"std.ZQ"', '"std.DMG"', '"std.NRV"', "fastball_velo", "max_velo", "fastball_vaa",
        "SwStr", "Ball_pct", "Z_Contact", "Chase", "CSW", "rel_z", "rel_x", "ext"]
ORACLE["feed_pitchers"] = f"""{WITH_FP} SELECT level_id, pitcher_hand, pitcher_mlbid, name, season, pitching_code,
  pitches, TBF, {', '.join(f'{r(m)} AS {m}' for m in _FPM)} FROM p"""
_PM = ["fastball_velo", "fastball_vaa", "SwStr", "Ball_pct", "Z_Contact", "Chase", "CSW"]
ORACLE["feed_team_pitching"] = f"{WITH_FP} " + _mean_of(
    "p", "level_id, season, pitching_code", ["IP"], ['"std.ZQ"', '"std.DMG"', '"std.NRV"', *_PM])
ORACLE["feed_league_pitching"] = f"{WITH_FP} " + _mean_of("p", "level_id, season", [], _PM)

_FEED_TYPES = f"""SELECT pitcher_name AS name, level_id, pitcher_mlbid, pitcher_hand, pitching_code, season, pitch_tag,
  count(*) AS pitches,
  100e0 * count(*) / sum(count(*)) OVER (PARTITION BY pitcher_mlbid, level_id, season) AS pct, {_ABSENT},
  {exact('pitch_velo')} AS velo, max(pitch_velo) AS max_velo, CAST(NULL AS DOUBLE) AS vaa, CAST(NULL AS DOUBLE) AS haa,
  {exact('ivb')} AS ivb, {exact('hb')} AS hb, {', '.join(_rates(_FOUT, False, False))}, {_FCSW} AS CSW,
  {pct('is_inzone')} AS Zone FROM feed GROUP BY {_FP}, pitch_tag"""
WITH_FT = f"{WITH_FEED}, ty AS ({_FEED_TYPES})"
_FTM = ["pct", '"std.ZQ"', '"std.DMG"', '"std.NRV"', "velo", "max_velo", "vaa", "haa", "ivb", "hb", "SwStr",
        "Z_Contact", "Ball_pct", "Zone", "Chase", "CSW"]
ORACLE["feed_pitch_types"] = f"""{WITH_FT} SELECT name, level_id, pitcher_mlbid, pitcher_hand, pitching_code,
  season, pitches, pitch_tag, {', '.join(f'{r(m)} AS {m}' for m in _FTM)} FROM ty"""

# --- percentiles ------------------------------------------------------------------


def avg_rank_pct(m: str, group: str) -> str:
    """Average rank over the group, 0-100 by the number of all its rows."""
    rank = (
        f"(rank() OVER (PARTITION BY {group} ORDER BY {m} NULLS LAST)"
        f" + (count(*) OVER (PARTITION BY {group}, {m}) - 1) / 2e0)"
    )
    n = f"count(*) OVER (PARTITION BY {group})"
    return f"CASE WHEN {n} > 1 THEN CASE WHEN {m} IS NOT NULL THEN 100e0 * ({rank} - 1) / ({n} - 1) END ELSE 100 END"


def bins_sql(src: str, keys: str, group: str, metrics: list[str], qualified: str) -> str:
    """1-100 bins by the distinct linear quantile edges of the qualified rows."""
    gs = [g.strip() for g in group.split(",")]
    lists = ", ".join(f"list_sort(list({m}) FILTER (WHERE {m} IS NOT NULL)) AS v_{m}" for m in metrics)
    edge = lambda m: (
        f"list_distinct([v_{m}[CAST(floor((len(v_{m}) - 1) * (i / 100e0)) AS BIGINT) + 1]"
        f" + (v_{m}[CAST(ceil((len(v_{m}) - 1) * (i / 100e0)) AS BIGINT) + 1]"
        f" - v_{m}[CAST(floor((len(v_{m}) - 1) * (i / 100e0)) AS BIGINT) + 1])"
        f" * ((len(v_{m}) - 1) * (i / 100e0) - floor((len(v_{m}) - 1) * (i / 100e0)))"
        f" for i in range(101)]) AS e_{m}"
    )
    present = " AND ".join(f"{g} IS NOT NULL" for g in gs)
    same = " AND ".join(f"t.{g} = e.{g}" for g in gs)
    out = ", ".join(
        f"CASE WHEN {qualified} AND t.{m} IS NOT NULL AND len(e_{m}) > 1 THEN"
        f" greatest(1, len(list_filter(e_{m}, lambda x: x < t.{m}))) END AS {m}_pctile"
        for m in metrics
    )
    return f""", pool AS (SELECT * FROM {src} WHERE {qualified} AND {present}),
lists AS (SELECT {group}, {lists} FROM pool GROUP BY {group}),
edges AS (SELECT {group}, {', '.join(edge(m) for m in metrics)} FROM lists)
SELECT {', '.join('t.' + k.strip() for k in keys.split(','))}, {out} FROM {src} t LEFT JOIN edges e ON {same}"""


ORACLE["pctile_avg_rank"] = f"""{WITH_TABLE}
SELECT {ENT}, {', '.join(f"{r(avg_rank_pct(m, 'season, level_id'))} AS {m}_pctile" for m in ('miss_rate', 'chase', 'v2_max'))}
FROM t"""


def _pct_rank(m: str) -> str:
    return (
        f"CASE WHEN pitches >= 40 AND {m} IS NOT NULL THEN 100e0 *"
        f" (rank() OVER (PARTITION BY season, level_id, pitches >= 40 ORDER BY {m} NULLS LAST)"
        f" + (count(*) OVER (PARTITION BY season, level_id, pitches >= 40, {m}) - 1) / 2e0)"
        f" / count({m}) OVER (PARTITION BY season, level_id, pitches >= 40) END"
    )


ORACLE["pctile_pct_rank_qualified"] = f"""{WITH_TABLE}
SELECT {ENT}, {r(_pct_rank('miss_rate'))} AS miss_rate_pctile, {r(_pct_rank('v1_mean'))} AS v1_mean_pctile FROM t"""
ORACLE["pctile_qcut"] = f"{WITH_TABLE}" + bins_sql(
    "t", ENT, "season, level_id", ["miss_rate", "v2_max"], "pitches >= 40")
ORACLE["hitter_pctiles"] = f"{WITH_PITCH}, h AS ({hitters_sql(False)})" + bins_sql(
    "h", HKEYS, "season, level_id",
    ["SEAGER", "selection_skill", "hittable_pitches_taken", "damage_rate", "EV90th", "max_EV", "pull_FB_pct",
     "chase", "z_con", "secondary_whiff_pct", "whiffs_vs_95", "contact_vs_avg"], "PA >= 40")

_FHP = {"selection_skill": "selection", "hittable_pitches_taken": "hittable_pitches", "damage_rate": "damage",
        "EV90th": "EV90", "max_EV": "max", "pull_FB_pct": "pfb", "secondary_whiff_pct": "sec_whiff",
        "contact_vs_avg": "c_vs_avg"}
ORACLE["feed_hitter_pctiles"] = f"""{WITH_FH} SELECT batter_mlbid, hitter_name, season, level_id, hitting_code,
  {', '.join(f"{r(avg_rank_pct(m, 'season, level_id'))} AS {_FHP.get(m, m)}_pctile" for m in _FH_METRICS)},
  pitches, bbe, PA FROM h"""
_PSHORT = {'"std.ZQ"': "PQ", '"std.DMG"': "DMG", '"std.NRV"': "NRV", "Ball_pct": "Ball", "Z_Contact": "Z_con"}
_FPP = {**_PSHORT, "fastball_velo": "FA_velo", "max_velo": "FA_max", "fastball_vaa": "FA_vaa", "rel_z": "rZ", "rel_x": "rX"}
ORACLE["feed_pitcher_pctiles"] = f"""{WITH_FP} SELECT pitcher_mlbid, name, season, level_id, pitching_code,
  {', '.join(f"{r(avg_rank_pct(m, 'season, level_id'))} AS {_FPP.get(m, m)}_pctile" for m in _FPM[2:])},
  TBF, {r('IP')} AS IP FROM p"""
_FTP = {**_PSHORT, "pct": "usage", "Zone": "zone"}
ORACLE["feed_pitch_type_pctiles"] = f"""{WITH_FT} SELECT pitcher_mlbid, name, season, level_id, pitching_code,
  pitch_tag, pitcher_hand,
  {', '.join(f"{r(avg_rank_pct(m, 'season, level_id, pitch_tag'))} AS {_FTP.get(m, m)}_pctile" for m in _FTM)},
  pitches FROM ty"""

# --- grades -------------------------------------------------------------------------


def limits_sql(min_rows: int, min_entities: int) -> str:
    q = lambda p, v: nearest(v, p)
    return f""", avgs AS (SELECT season, pitcher_mlbid, pitch_tag, avg(stuff_raw) AS s, count(*) AS n FROM pitch
  WHERE level_id = 1 GROUP BY ALL HAVING count(*) >= {min_rows}),
bys AS (SELECT season, pitch_tag, {q(0.01, 's')} AS lo, {q(0.99, 's')} AS hi, count(*) AS ents FROM avgs GROUP BY ALL),
bya AS (SELECT pitch_tag, {q(0.01, 's')} AS alo, {q(0.99, 's')} AS ahi FROM avgs GROUP BY ALL),
limits AS (SELECT season, bys.pitch_tag, CASE WHEN ents >= {min_entities} THEN lo ELSE alo END AS lo,
  CASE WHEN ents >= {min_entities} THEN hi ELSE ahi END AS hi FROM bys LEFT JOIN bya ON bys.pitch_tag = bya.pitch_tag)"""


def grade_of(raw: str) -> str:
    return (
        f"CASE WHEN {raw} IS NOT NULL AND lo IS NOT NULL AND hi IS NOT NULL AND lo <> hi THEN"
        f" CAST(round_even(greatest(20e0, least(80e0, 80e0 - 60e0 * ({raw} - lo) / (hi - lo))), 0) AS BIGINT) END"
    )


def graded_sql(min_rows: int, min_entities: int) -> str:
    join = "LEFT JOIN limits l ON x.season = l.season AND x.pitch_tag = l.pitch_tag"
    raw = "SELECT {k}, pitch_tag, avg(stuff_raw) AS stuff_raw, count(*) AS pitches FROM pitch GROUP BY {k}, pitch_tag"
    comp = "SELECT {k}, coalesce(sum(stuff * pitches), 0) / sum(pitches)::DOUBLE AS stuff FROM {s} GROUP BY {k}"
    return f"""{WITH_PITCH}{limits_sql(min_rows, min_entities)},
t0 AS ({pitch_types_sql(False)}), ty AS (SELECT x.*, {grade_of('stuff_raw')} AS stuff FROM t0 x {join}),
g1 AS ({comp.format(k='pitcher_mlbid, season, level_id', s='ty')}),
a0 AS ({pitchers_sql(False)}),
arms AS (SELECT a0.*, g1.stuff FROM a0 LEFT JOIN g1 USING (pitcher_mlbid, season, level_id)),
tr AS ({raw.format(k='pitching_code, season, level_id')}),
tg AS (SELECT x.*, {grade_of('stuff_raw')} AS stuff FROM tr x {join}),
g2 AS ({comp.format(k='pitching_code, season, level_id', s='tg')}),
lr AS ({raw.format(k='season, level_id')}),
lg AS (SELECT x.*, {grade_of('stuff_raw')} AS stuff FROM lr x {join}),
g3 AS ({comp.format(k='season, level_id', s='lg')})"""


ORACLE["grade_thresholds"] = f"{WITH_PITCH}{limits_sql(10, 20)} SELECT season, pitch_tag, {r('lo')} AS lo, {r('hi')} AS hi FROM limits"
_G = graded_sql(10, 20)
ORACLE["grade_20_80"] = f"{_G} SELECT {TKEYS}, {r('stuff_raw')} AS stuff_raw, stuff FROM ty"
ORACLE["grade_composite_pitchers"] = f"{_G} SELECT {PKEYS}, pitches, {r('stuff_raw')} AS stuff_raw, {r('stuff')} AS stuff FROM arms"
ORACLE["grade_composite_teams"] = f"""{_G} SELECT t.pitching_code, t.season, t.level_id, t.pitches, {r('g2.stuff')} AS stuff
FROM ({group_pitching_sql('pitching_code, level_id, season', 'pitching_code', False)}) t
LEFT JOIN g2 USING (pitching_code, season, level_id)"""
ORACLE["grade_composite_league"] = f"""{_G} SELECT t.season, t.level_id, t.pitches, {r('g3.stuff')} AS stuff
FROM ({group_pitching_sql('level_id, season', None, False)}) t LEFT JOIN g3 USING (season, level_id)"""
_G2 = graded_sql(10, 5)
ORACLE["pitcher_pctiles"] = _G2 + bins_sql(
    "arms", PKEYS, "season, level_id",
    ["stuff", "fastball_velo", "max_velo", "fastball_vaa", "SwStr", "Ball_pct", "Z_Contact", "Chase", "CSW",
     "rel_z", "rel_x", "ext"], "IP >= 2")
ORACLE["pitch_type_pctiles"] = _G2 + bins_sql(
    "ty", TKEYS, "season, level_id, pitch_tag",
    ["pct", "stuff", "velo", "max_velo", "vaa", "haa", "vbreak", "hbreak", "SwStr", "Ball_pct", "Z_Contact",
     "Chase", "CSW"], "pitches >= 5")
ORACLE["grade_z"] = f"""{WITH_OBS}, e AS (SELECT entity_id, season, level_id, tag_src, avg(v2) AS stuff_raw FROM obs GROUP BY ALL),
s AS (SELECT season, tag_src, avg(stuff_raw) AS m, stddev_samp(stuff_raw) AS d FROM e WHERE level_id = 1 GROUP BY ALL),
z AS (SELECT e.*, CASE WHEN d > 0 THEN (stuff_raw - m) / d END AS stuff_z FROM e LEFT JOIN s USING (season, tag_src))
SELECT entity_id, season, level_id, tag_src, {r('stuff_raw')} AS stuff_raw, {r('stuff_z')} AS stuff_z,
  {r('CASE WHEN stuff_z IS NOT NULL THEN greatest(20, least(80, 50 - 10 * stuff_z)) END')} AS stuff FROM z"""
ORACLE["grade_rows"] = f"""{WITH_PITCH}, limits AS (SELECT season, pitch_tag, {nearest('stuff_raw', 0.2)} AS lo,
  {nearest('stuff_raw', 0.8)} AS hi FROM pitch WHERE level_id = 1 GROUP BY ALL),
g AS (SELECT x.season, x.level_id, x.pitch_tag, {grade_of('stuff_raw')} AS stuff
  FROM pitch x LEFT JOIN limits l ON x.season = l.season AND x.pitch_tag = l.pitch_tag)
SELECT season, level_id, pitch_tag, stuff, count(*) AS rows FROM g GROUP BY ALL"""

# --- stability and shrinkage -----------------------------------------------------------

_POINTS = "K * 0.5e0 / 0.5e0 AS n_50, K * 0.7e0 / 0.3e0 AS n_70, K * 0.8e0 / 0.2e0 AS n_80"


def rate_const_sql(samples: str, by: str, min_players: int = 10) -> str:
    """samples: by..., num, den."""
    sel = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT *, {_POINTS} FROM (SELECT *, CASE WHEN var_true IS NOT NULL
    THEN greatest(0e0, mu * (1 - mu) / var_true - 1) END AS K FROM (
  SELECT *, CASE WHEN var_obs IS NOT NULL THEN greatest(1e-8, var_obs - var_within) END AS var_true FROM (
    SELECT {sel}count(*) AS n_players, avg(num / den::DOUBLE) AS mu, var_samp(num / den::DOUBLE) AS var_obs,
      avg(num / den::DOUBLE) * (1 - avg(num / den::DOUBLE)) * avg(1e0 / den) AS var_within
    FROM ({samples}) {group} HAVING count(*) >= {min_players})))"""


def mean_const_sql(samples: str, by: str, min_players: int = 10) -> str:
    """samples: by..., val, var, n."""
    return f"""SELECT *, {_POINTS} FROM (SELECT *, CASE WHEN var_between IS NOT NULL
    THEN greatest(0e0, var_within / var_between) END AS K FROM (
  SELECT *, CASE WHEN var_obs - var_within * inv IS NOT NULL
      THEN greatest(1e-8, var_obs - var_within * inv) END AS var_between FROM (
    SELECT {by}, count(*) AS n_players, avg(val) AS mu, var_samp(val) AS var_obs, avg(1e0 / n) AS inv,
      sum(CASE WHEN n > 1 THEN var * (n - 1) END) / nullif(sum(CASE WHEN n > 1 THEN n - 1 END), 0) AS var_within
    FROM ({samples}) GROUP BY {by} HAVING count(*) >= {min_players})))"""


_RC = ["mu", "var_obs", "var_within", "var_true", "K", "n_50", "n_70", "n_80"]
_MC = ["mu", "var_obs", "var_within", "var_between", "K", "n_50", "n_70", "n_80"]
_OBS_RATES = [("miss_rate", "miss", "attempt"), ("chase", "attempt AND NOT in_zone", "NOT in_zone")]


def _rate_samples(src, keys, rates, min_den):
    return " UNION ALL ".join(
        f"SELECT {keys}, '{n}' AS stat, {cnt(a)} AS num, {cnt(b)} AS den FROM {src} GROUP BY {keys} HAVING {cnt(b)} >= {min_den}"
        for n, a, b in rates
    )


def _value_samples(src, keys, values, min_n):
    return " UNION ALL ".join(
        f"SELECT {keys}, '{n}' AS stat, avg({where(v, p)}) AS val, var_samp({where(v, p)}) AS var,"
        f" count({where(v, p)}) AS n FROM {src} GROUP BY {keys} HAVING count({where(v, p)}) >= {min_n}"
        for n, v, p in values
    )


ORACLE["rate_constants"] = f"""{WITH_OBS}, c AS ({rate_const_sql(_rate_samples('obs', ENT, _OBS_RATES, 20), 'level_id, stat')})
SELECT level_id, stat, n_players, {items([(c, c) for c in _RC])} FROM c"""
ORACLE["mean_constants"] = f"""{WITH_OBS}, c AS ({mean_const_sql(
    _value_samples('obs', ENT, [('v1_mean', 'v1', None), ('v2_swing', 'v2', 'attempt')], 20), 'season, level_id, stat')})
SELECT season, level_id, stat, n_players, {items([(c, c) for c in _MC])} FROM c"""

# Exact law of a resample's maximum, from the distinct values of each entity.
_MAX_VAR = f"""d AS (SELECT {ENT}, v2, count(*) AS c FROM obs WHERE v2 IS NOT NULL GROUP BY ALL),
k AS (SELECT *, sum(c) OVER (PARTITION BY {ENT} ORDER BY v2) AS upto, sum(c) OVER (PARTITION BY {ENT}) AS n,
  max(v2) OVER (PARTITION BY {ENT}) AS top FROM d),
m AS (SELECT *, pow(upto / n::DOUBLE, n) - pow((upto - c) / n::DOUBLE, n) AS p FROM k WHERE n >= 20),
pl AS (SELECT {ENT}, max(v2) AS val, max(n) AS n, sum(p * (v2 - top) * (v2 - top)) - pow(sum(p * (v2 - top)), 2) AS vw
  FROM m GROUP BY ALL)"""
ORACLE["max_constants_exact"] = f"""{WITH_OBS}, {_MAX_VAR},
gr AS (SELECT level_id, count(*) AS n_players, avg(val) AS mu, var_samp(val) AS var_obs, avg(vw) AS var_within FROM pl GROUP BY ALL),
gb AS (SELECT *, CASE WHEN var_obs IS NOT NULL THEN greatest(1e-8, var_obs - var_within) END AS var_between FROM gr),
kk AS (SELECT pl.level_id, median(pl.n * (1 - var_between / (var_between + vw)) / (var_between / (var_between + vw))) AS K
  FROM pl JOIN gb USING (level_id) GROUP BY ALL),
c AS (SELECT gb.*, K, {_POINTS} FROM gb JOIN kk USING (level_id) WHERE n_players >= 10)
SELECT level_id, n_players, {items([(c, c) for c in _MC])} FROM c"""


def quantile_law_sql(src, keys, value, q, cond=None, min_n=20):
    """CTEs up to qpl(keys, val, n, vw): each pair of order statistics with its chance."""
    # A resample's r-th and next smallest: tails of the binomial, pairs i < j by products.
    log = "lgamma(n + 1) - lgamma({m} + 1) - lgamma(n - {m} + 1)"
    tail = f"list_sum([exp({log.format(m='m')} + m * ln({{0}} / n::DOUBLE) + (n - m) * ln(1 - {{0}} / n::DOUBLE)) for m in range(r, n + 1)])"
    upto = f"CASE WHEN upto = n THEN 1e0 ELSE {tail.format('upto')} END"
    below = f"CASE WHEN upto = c THEN 0e0 ELSE {tail.format('(upto - c)')} END"
    return f"""qd AS (SELECT {keys}, {value} AS v, count(*) AS c FROM {src} WHERE {value} IS NOT NULL{f' AND ({cond})' if cond else ''} GROUP BY ALL),
qk AS (SELECT *, CAST(sum(c) OVER (PARTITION BY {keys} ORDER BY v) AS BIGINT) AS upto, CAST(sum(c) OVER (PARTITION BY {keys}) AS BIGINT) AS n FROM qd),
qr AS (SELECT *, CAST(floor({q!r}e0 * (n - 1)) AS BIGINT) + 1 AS r, {q!r}e0 * (n - 1) - floor({q!r}e0 * (n - 1)) AS p FROM qk WHERE n >= {min_n}),
qc AS (SELECT *, min(CASE WHEN upto >= r THEN v END) OVER (PARTITION BY {keys}) AS low,
  min(CASE WHEN upto >= least(r + 1, n) THEN v END) OVER (PARTITION BY {keys}) AS high FROM qr),
qm AS (SELECT *, v - low AS x, {upto} - {below} AS mass,
  exp({log.format(m='r')}) * (pow(upto / n::DOUBLE, r) - pow((upto - c) / n::DOUBLE, r)) AS alpha,
  pow(1 - (upto - c) / n::DOUBLE, n - r) - pow(1 - upto / n::DOUBLE, n - r) AS beta,
  pow(1 - upto / n::DOUBLE, n - r) AS beyond FROM qc),
qs AS (SELECT {keys}, x AS s, mass - alpha * beyond AS w FROM qm
  UNION ALL SELECT {', '.join(f'i.{k}' for k in keys.split(', '))}, i.x + i.p * (j.x - i.x), i.alpha * j.beta
  FROM qm i JOIN qm j ON {' AND '.join(f'i.{k} IS NOT DISTINCT FROM j.{k}' for k in keys.split(', '))} AND i.v < j.v),
qv AS (SELECT {keys}, sum(w * s * s) - pow(sum(w * s), 2) AS vw FROM qs GROUP BY ALL),
qpl AS (SELECT {', '.join(f'm.{k}' for k in keys.split(', '))}, max(m.n) AS n, max(m.low + (m.high - m.low) * m.p) AS val, max(qv.vw) AS vw
  FROM qm m JOIN qv ON {' AND '.join(f'm.{k} IS NOT DISTINCT FROM qv.{k}' for k in keys.split(', '))} GROUP BY ALL)"""


ORACLE["quantile_constants_boot"] = f"""{WITH_OBS}, {quantile_law_sql('obs', ENT, 'v2', 0.9)},
gr AS (SELECT level_id, count(*) AS n_players, avg(val) AS mu, var_samp(val) AS var_obs, avg(vw) AS var_within FROM qpl GROUP BY ALL),
gb AS (SELECT *, CASE WHEN var_obs IS NOT NULL THEN greatest(1e-8, var_obs - var_within) END AS var_between FROM gr),
kk AS (SELECT level_id, median(n * vw / var_between) AS K FROM qpl JOIN gb USING (level_id) GROUP BY ALL),
c AS (SELECT gb.*, K, {_POINTS} FROM gb JOIN kk USING (level_id) WHERE n_players >= 10)
SELECT level_id, n_players, {', '.join(f'{sig(c) if c in WIDE_RANGE else r(c, 3)} AS {c}' for c in _MC)} FROM c"""

_REG_HIT_RATES = [
    ("pull_FB_pct", "launch_angle >= 20 AND spray_angle_adj < -15", "bbe"),
    ("chase", f"swing AND {OUTZ}", OUTZ),
    ("z_con", f"swing AND {INZ} AND NOT whiff", f"swing AND {INZ}"),
    ("secondary_whiff_pct", "whiff AND pi_pitch_group <> 'FA'", "swing AND pi_pitch_group <> 'FA'"),
    ("whiffs_vs_95", "whiff AND pitch_velo >= 95", "swing AND pitch_velo >= 95"),
    ("damage_rate", _DAMAGE, "bbe"),
    ("selection_skill", "NOT swing AND decision_value > 0", "decision_value > 0"),
    ("hittable_pitches_taken", "NOT swing AND decision_value < 0", "NOT swing"),
    ("LA_lte_0", "launch_angle <= 0", "bbe"), ("LD_pct", "launch_angle > 0 AND launch_angle < 20", "bbe"),
    ("LA_gte_20", "launch_angle >= 20", "bbe"),
]
_REG_HIT_MEANS = [("pred_whiff_loc_mean", "pred_whiff_loc", "swing")] + [
    (c, c, "swing") for c in ("bat_speed", "swing_length", "attack_angle", "swing_path_tilt")
]
_HK = "batter_mlbid, season, level_id"
_ALLC = ["mu", "var_obs", "var_within", "var_true", "var_between", "K", "n_50", "n_70", "n_80"]


def constants_sql(dataset, src, keys, by, rates, means, min_den=20, min_players=10):
    return f"""SELECT '{dataset}' AS dataset, 'rate' AS kind, {by}, stat, n_players, mu, var_obs, var_within, var_true,
  CAST(NULL AS DOUBLE) AS var_between, K, n_50, n_70, n_80
FROM ({rate_const_sql(_rate_samples(src, keys, rates, min_den), by + ', stat', min_players)})
UNION ALL SELECT '{dataset}', 'mean', {by}, stat, n_players, mu, var_obs, var_within, CAST(NULL AS DOUBLE), var_between,
  K, n_50, n_70, n_80
FROM ({mean_const_sql(_value_samples(src, keys, means, min_den), by + ', stat', min_players)})"""


_HIT_CONST = constants_sql("hitters", "pitch", _HK, "level_id", _REG_HIT_RATES, _REG_HIT_MEANS)
ORACLE["hitter_constants"] = f"""{WITH_PITCH}, c AS ({_HIT_CONST})
SELECT dataset, kind, level_id, stat, n_players, {items([(c, c) for c in _ALLC])} FROM c"""

_USE = "K IS NULL OR mu IS NULL OR K = 0"


def shrunk(cells: str, const: str, on: str, percent: str = "FALSE") -> str:
    """cells: keys, stat, num, n, value -> plus mu, K, raw, reg (rates in percent)."""
    return f"""SELECT x.*, mu, K,
  CASE WHEN num IS NOT NULL THEN 100e0 * num / n WHEN {percent} THEN 100e0 * value ELSE value END AS raw,
  CASE WHEN num IS NOT NULL THEN CASE WHEN {_USE} THEN 100e0 * num / n ELSE 100e0 * (num + K * mu) / (n + K) END
       ELSE (CASE WHEN {percent} THEN 100e0 ELSE 1e0 END) * CASE WHEN {_USE} THEN value
            ELSE (value * n + K * mu) / (n + K) END END AS reg
FROM ({cells}) x LEFT JOIN ({const}) c ON {on}"""


def _cells(src, keys, rates, values, quants=(), maxes=()):
    parts = [
        f"SELECT {keys}, '{n}' AS stat, {cnt(a)}::DOUBLE AS num, {cnt(b)} AS n, NULL::DOUBLE AS value FROM {src} GROUP BY {keys} HAVING {cnt(b)} > 0"
        for n, a, b in rates
    ]
    for kind, group in (("avg", values), ("max", maxes), ("q", quants)):
        for n, v, p in group:
            e = where(v, p)
            agg = nearest(e, 0.9) if kind == "q" else f"{kind}({e})"
            parts.append(
                f"SELECT {keys}, '{n}', NULL, count({e}), {agg} FROM {src} GROUP BY {keys} HAVING count({e}) > 0"
            )
    return " UNION ALL ".join(parts)


_OBS_CONST = constants_sql("obs", "obs", ENT, "level_id", _OBS_RATES, [("v1_mean", "v1", "attempt")])
_ON = "x.level_id = c.level_id AND x.stat = c.stat"
_LONG = items([(c, c) for c in ("raw", "reg", "mu", "K")])
ORACLE["shrink_rate"] = f"""{WITH_OBS}, s AS ({shrunk(_cells('obs', ENT, _OBS_RATES, []), _OBS_CONST, _ON)})
SELECT {ENT}, stat, {r('num')} AS num, n, {_LONG} FROM s"""
_OBS_CELLS = _cells("obs", ENT, _OBS_RATES, [("v1_mean", "v1", "attempt")], maxes=[("v2_max", "v2", None)])
ORACLE["shrink_value"] = f"""{WITH_OBS}, s AS ({shrunk(f'SELECT * FROM ({_OBS_CELLS}) WHERE num IS NULL', _OBS_CONST, _ON)})
SELECT {ENT}, stat, n, {_LONG} FROM s"""
ORACLE["shrink_without_context"] = f"""{WITH_OBS}, s AS ({shrunk(
    _cells('obs', ENT, _OBS_RATES, []), rate_const_sql(_rate_samples('obs', ENT, _OBS_RATES, 20), 'stat'), 'x.stat = c.stat')})
SELECT {ENT}, stat, {r('num')} AS num, n, {_LONG} FROM s"""

_HIT_CELLS = _cells(
    "pitch", _HK, [*_REG_HIT_RATES, ("whiff_rate", "whiff", "swing")], _REG_HIT_MEANS,
    [("EV90th", "exit_velo", "bbe")], [("max_EV", "exit_velo", "bbe")])
_LOCPCT = "x.stat = 'pred_whiff_loc_mean'"


def _wide(stats_rate, stats_value, seager_extra=""):
    p = lambda s, c: f"max(CASE WHEN stat = '{s}' THEN {c} END)"
    cols = []
    for s in stats_rate:
        cols += [f"{r(p(s, 'num'))} AS {s}_num", f"{p(s, 'n')} AS {s}_n", f"{r(p(s, 'raw'))} AS {s}_raw", f"{r(p(s, 'reg'))} AS {s}_reg"]
    for s in stats_value:
        cols += [f"{p(s, 'n')} AS {s}_n", f"{r(p(s, 'raw'))} AS {s}_raw", f"{r(p(s, 'reg'))} AS {s}_reg"]
    return p, cols


_p, _cols = _wide([n for n, *_ in _REG_HIT_RATES], [n for n, *_ in _REG_HIT_MEANS] + ["EV90th", "max_EV"])
for _k in ("raw", "reg"):
    _cols.append(f"{r(_p('selection_skill', _k) + ' - ' + _p('hittable_pitches_taken', _k))} AS SEAGER_{_k}")
    _cols.append(f"{r(_p('pred_whiff_loc_mean', _k) + ' - ' + _p('whiff_rate', _k))} AS contact_vs_avg_{_k}")
ORACLE["regressed_hitters"] = f"""{WITH_PITCH}, s AS ({shrunk(_HIT_CELLS, _HIT_CONST, _ON, _LOCPCT)}),
names AS (SELECT {_HK}, min(hitter_name) AS hitter_name FROM pitch GROUP BY {_HK})
SELECT {_HK}, any_value(hitter_name) AS hitter_name, {', '.join(_cols)}
FROM names LEFT JOIN s USING ({_HK}) GROUP BY {_HK}"""

_TAB_RATES = ["pull_FB_pct", "chase", "z_con", "secondary_whiff_pct", "whiffs_vs_95", "damage_rate", "selection_skill",
              "hittable_pitches_taken", "LA_lte_0", "LD_pct", "LA_gte_20"]
_TAB_VALUES = ["pred_whiff_loc_mean", "EV90th", "max_EV", "bat_speed", "swing_length", "attack_angle", "swing_path_tilt"]
_TAB_CELLS = " UNION ALL ".join(
    [f"SELECT {HKEYS}, '{s}' AS stat, {s}_num::DOUBLE AS num, {s}_den AS n, NULL::DOUBLE AS value FROM h WHERE {s}_den > 0"
     for s in [*_TAB_RATES, "whiff_rate"]]
    + [f"SELECT {HKEYS}, '{s}', NULL, {s}_n, {s} FROM h WHERE {s}_n > 0" for s in _TAB_VALUES])
_p, _cols = _wide([], [*_TAB_RATES, *_TAB_VALUES])
for _k in ("raw", "reg"):
    _cols.append(f"{r(_p('selection_skill', _k) + ' - ' + _p('hittable_pitches_taken', _k))} AS SEAGER_{_k}")
    _cols.append(
        f"{r(_p('pred_whiff_loc_mean', _k) + ' - ' + _p('whiff_rate', _k) + ' - max(base)')} AS contact_vs_avg_{_k}")
ORACLE["regressed_hitters_from_table"] = f"""{WITH_PITCH}, h AS ({hitters_sql(False)}),
lgb AS (SELECT season, level_id, 100e0 * sum(pred_whiff_loc_mean * pred_whiff_loc_mean_n) / sum(pred_whiff_loc_mean_n)
  - 100e0 * sum(whiff_rate_num) / sum(whiff_rate_den) AS base FROM h GROUP BY ALL),
s AS ({shrunk(_TAB_CELLS, _HIT_CONST, _ON, _LOCPCT)})
SELECT s.batter_mlbid, s.hitter_name, s.level_id, s.season, {r('max(base)')} AS lg_contact_baseline, {', '.join(_cols)}
FROM s LEFT JOIN lgb USING (season, level_id) GROUP BY ALL"""

# --- regressed pitch types and the long table --------------------------------------------

_REG_OUT = [
    ("SwStr", "whiff", "*"), ("Ball_pct", "is_ball", "*"),
    ("Z_Contact", f"NOT whiff AND {INZ} AND swing", f"{INZ} AND swing"),
    ("Chase", f"swing AND {OUTZ}", OUTZ), ("CSW", _LOOK, "*"),
]
_REG_BATTED = [
    ("LA_lte_0", "launch_angle <= 0", "bbe"), ("LD_pct", "launch_angle > 0 AND launch_angle < 20", "bbe"),
    ("LA_gte_20", "launch_angle >= 20", "bbe"),
]
_REG_ARM_RATES = [*_REG_OUT, ("FA_pct", "pi_pitch_group = 'FA'", "*"), *_REG_BATTED]
_REG_ARM_MEANS = [
    ("pWhiff", "pred_whiff_base", "swing"), ("BB_rpm", "rpm", "pi_pitch_group IN ('CU', 'SL')"),
    ("FA_spin_eff", "spin_efficiency", "pi_pitch_group = 'FA'"),
    ("fastball_velo", "primary_velo", "pi_pitch_group = 'FA'"),
    ("fastball_vaa", "primary_vaa", "pi_pitch_group = 'FA'"), ("stuff_raw", "stuff_raw", None),
    ("rel_z", "release_z", None), ("rel_x", "release_x", None), ("ext", "ext", None), ("arm_angle", "arm_angle", None),
]
_REG_TYPE_MEANS = [("pred_whiff_pct", "pred_whiff_base", "swing"), *[(n, v, None) for n, v in _SHAPE]]
_TOP = [("max_velo", "pitch_velo", None)]
_AK, _TK = "pitcher_mlbid, season, level_id", "pitcher_mlbid, season, level_id, pitch_tag"
_ON_TAG = _ON + " AND x.pitch_tag = c.pitch_tag"
_TYPE_CONST = constants_sql("pitch_types", "pitch", _TK, "level_id, pitch_tag", _REG_OUT, _REG_TYPE_MEANS, 5, 3)
_TYPE_CELLS = _cells("pitch", _TK, _REG_OUT, _REG_TYPE_MEANS, maxes=_TOP)
_PCTTYPE = "x.stat = 'pred_whiff_pct'"
_p, _cols = _wide([n for n, *_ in _REG_OUT], [n for n, *_ in _REG_TYPE_MEANS] + ["max_velo"])
ORACLE["regressed_pitch_types"] = f"""{WITH_PITCH}, s AS ({shrunk(_TYPE_CELLS, _TYPE_CONST, _ON_TAG, _PCTTYPE)}),
names AS (SELECT {_TK}, min(name) AS name, min(pitcher_hand) AS pitcher_hand FROM pitch GROUP BY {_TK})
SELECT {_TK}, any_value(name) AS name, any_value(pitcher_hand) AS pitcher_hand, {', '.join(_cols)}
FROM names LEFT JOIN s USING ({_TK}) GROUP BY {_TK}"""

_HIT5 = constants_sql("hitters", "pitch", _HK, "level_id", _REG_HIT_RATES, _REG_HIT_MEANS, 5, 3)
_ARM5 = constants_sql("pitchers", "pitch", _AK, "level_id", _REG_ARM_RATES, _REG_ARM_MEANS, 5, 3)
_HIT_CELLS2 = _cells("pitch", _HK, _REG_HIT_RATES, _REG_HIT_MEANS, [("EV90th", "exit_velo", "bbe")],
                     [("max_EV", "exit_velo", "bbe")])
_ARM_CELLS = _cells("pitch", _AK, _REG_ARM_RATES, _REG_ARM_MEANS, maxes=_TOP)
_TAIL = f"stat, {r('num')} AS num, n, {_LONG}"
ORACLE["regression_long"] = f"""{WITH_PITCH},
a AS ({shrunk(_HIT_CELLS2, _HIT5, _ON, _LOCPCT)}), b AS ({shrunk(_ARM_CELLS, _ARM5, _ON, "x.stat = 'pWhiff'")}),
c AS ({shrunk(_TYPE_CELLS, _TYPE_CONST, _ON_TAG, _PCTTYPE)})
SELECT 'hitters' AS dataset, batter_mlbid, NULL AS pitcher_mlbid, season, level_id, NULL AS pitch_tag, {_TAIL} FROM a
UNION ALL SELECT 'pitchers', NULL, pitcher_mlbid, season, level_id, NULL, {_TAIL} FROM b
UNION ALL SELECT 'pitch_types', NULL, pitcher_mlbid, season, level_id, pitch_tag, {_TAIL} FROM c"""

ORACLE["constants_pitchers"] = f"""{WITH_PITCH}, c AS ({_ARM5})
SELECT dataset, kind, level_id, stat, n_players, {items([(c, c) for c in _ALLC])} FROM c"""


def max_law_sql(src, keys, value, cond=None, min_n=20):
    """CTEs up to qpl(keys, val, n, vw): each value's chance to be a resample's maximum."""
    return f"""qd AS (SELECT {keys}, {value} AS v, count(*) AS c FROM {src} WHERE {value} IS NOT NULL{f' AND ({cond})' if cond else ''} GROUP BY ALL),
qk AS (SELECT *, sum(c) OVER (PARTITION BY {keys} ORDER BY v) AS upto, sum(c) OVER (PARTITION BY {keys}) AS n,
  max(v) OVER (PARTITION BY {keys}) AS top FROM qd),
qm AS (SELECT *, pow(upto / n::DOUBLE, n) - pow((upto - c) / n::DOUBLE, n) AS p FROM qk WHERE n >= {min_n}),
qpl AS (SELECT {keys}, max(v) AS val, max(n) AS n, sum(p * (v - top) * (v - top)) - pow(sum(p * (v - top)), 2) AS vw FROM qm GROUP BY ALL)"""


def resampled_sql(dataset, stat, kind, law, by, min_players):
    same = " AND ".join(f"q.{k} IS NOT DISTINCT FROM g.{k}" for k in by.split(", "))
    own = ", ".join(f"g.{k}" for k in by.split(", "))
    return f"""SELECT '{dataset}' AS dataset, '{kind}' AS kind, {by}, '{stat}' AS stat, n_players, mu, var_obs, var_within,
  CAST(NULL AS DOUBLE) AS var_true, var_between, K, {_POINTS} FROM (
  WITH {law}, gr AS (SELECT {by}, count(*) AS n_players, avg(val) AS mu, var_samp(val) AS var_obs, avg(vw) AS var_within FROM qpl GROUP BY ALL),
  g AS (SELECT *, CASE WHEN var_obs IS NOT NULL THEN greatest(1e-8, var_obs - var_within) END AS var_between FROM gr WHERE n_players >= {min_players})
  SELECT g.*, kk.K FROM g JOIN (SELECT {own}, median(q.n * q.vw / g.var_between) AS K FROM qpl q JOIN g ON {same} GROUP BY ALL) kk
    ON {same.replace("q.", "kk.")})"""


_SEASON = "season, level_id"
_PER_SEASON = [
    constants_sql("hitters", "pitch", _HK, _SEASON, _REG_HIT_RATES, _REG_HIT_MEANS, 5, 3),
    constants_sql("pitchers", "pitch", _AK, _SEASON, _REG_ARM_RATES, _REG_ARM_MEANS, 5, 3),
    constants_sql("pitch_types", "pitch", _TK, _SEASON + ", pitch_tag", _REG_OUT, _REG_TYPE_MEANS, 5, 3),
    resampled_sql("hitters", "EV90th", "quantile", quantile_law_sql("pitch", _HK, "exit_velo", 0.9, "bbe", 5), _SEASON, 3),
    resampled_sql("hitters", "max_EV", "max", max_law_sql("pitch", _HK, "exit_velo", "bbe", 5), _SEASON, 3),
    resampled_sql("pitchers", "max_velo", "max", max_law_sql("pitch", _AK, "pitch_velo", None, 5), _SEASON, 3),
    resampled_sql("pitch_types", "max_velo", "max", max_law_sql("pitch", _TK, "pitch_velo", None, 5), _SEASON + ", pitch_tag", 3),
]
ORACLE["all_constants_by_season"] = f"""{WITH_PITCH}, c AS ({" UNION ALL BY NAME ".join(f"SELECT * FROM ({q})" for q in _PER_SEASON)})
SELECT dataset, kind, season, level_id, pitch_tag, stat, n_players, {items([(c, c) for c in _ALLC])} FROM c"""

_PCTARM = "x.stat = 'pWhiff'"
_p, _cols = _wide([n for n, *_ in _REG_ARM_RATES], [n for n, *_ in _REG_ARM_MEANS] + ["max_velo"])
ORACLE["regressed_pitchers"] = f"""{WITH_PITCH}, s AS ({shrunk(_ARM_CELLS, _ARM5, _ON, _PCTARM)}),
names AS (SELECT {_AK}, min(name) AS name, min(pitcher_hand) AS pitcher_hand FROM pitch GROUP BY {_AK})
SELECT {_AK}, any_value(name) AS name, any_value(pitcher_hand) AS pitcher_hand, {', '.join(_cols)}
FROM names LEFT JOIN s USING ({_AK}) GROUP BY {_AK}"""


def _from_table(table: str, keys: str, rates: list, means: list, percent: str, const: str, on: str) -> str:
    """Regressed statistics of a published table; ``percent`` is its one mean in percent."""
    values = [n for n, *_ in means] + ["max_velo"]
    cells = " UNION ALL ".join(
        [f"SELECT {keys}, '{s}' AS stat, {s}_num::DOUBLE AS num, {s}_den AS n, NULL::DOUBLE AS value FROM tab WHERE {s}_den > 0"
         for s, *_ in rates]
        + [f"SELECT {keys}, '{s}', NULL, {s}_n, {s}{' / 100e0' if s == percent else ''} FROM tab WHERE {s}_n > 0" for s in values])
    _, cols = _wide([], [*[n for n, *_ in rates], *values])
    return f"""{WITH_PITCH}, tab AS ({table}), s AS ({shrunk(cells, const, on, f"x.stat = '{percent}'")})
SELECT {keys}, {', '.join(cols)} FROM s GROUP BY {keys}"""


ORACLE["regressed_pitchers_from_table"] = _from_table(
    pitchers_sql(False), PKEYS, _REG_ARM_RATES, _REG_ARM_MEANS, "pWhiff", _ARM5, _ON)
ORACLE["regressed_pitch_types_from_table"] = _from_table(
    pitch_types_sql(False), TKEYS, _REG_OUT, _REG_TYPE_MEANS, "pred_whiff_pct", _TYPE_CONST, _ON_TAG)

# --- similarity -------------------------------------------------------------------------


def comps_sql(features: list[str], name: str) -> str:
    """pool and target CTEs exist; adds scored(…, distance, similarity_score)."""
    stats = ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in features)
    z = lambda v, f: f"coalesce(({v} - m_{f}) / nullif(s_{f}, 0), 0)"
    dist = " + ".join(f"pow({z('e.' + f, f)} - {z('t.' + f, f)}, 2)" for f in features)
    some = " AND ".join(f"{f} IS NOT NULL" for f in features)
    return f""", elig AS (SELECT * FROM pool WHERE {some} AND {name} IS DISTINCT FROM (SELECT {name} FROM target)),
mom AS (SELECT {stats} FROM elig), far0 AS (SELECT e.*, sqrt({dist}) AS distance FROM elig e, target t, mom),
scored AS (SELECT *, CASE WHEN max(distance) OVER () > 0
  THEN round_even(100e0 * (1 - distance / max(distance) OVER ()), 0) ELSE 100 END AS similarity_score FROM far0)"""


_COMPS = f"""{WITH_OBS}, tb AS (SELECT entity_id, entity_name, season, count(*) AS pitches, {pct('miss', 'attempt')} AS miss_rate,
  {pct('attempt AND NOT in_zone', 'NOT in_zone')} AS chase, avg(v1) FILTER (WHERE attempt) AS v1_mean, max(v2) AS v2_max
  FROM obs GROUP BY ALL), pool AS (SELECT * FROM tb WHERE pitches >= 60),
target AS (SELECT * FROM tb WHERE season = 1997 ORDER BY entity_name LIMIT 1)""" + comps_sql(
    ["miss_rate", "chase", "v1_mean", "v2_max"], "entity_name")
ORACLE["comps"] = f"{_COMPS} SELECT entity_id, entity_name, season, {r('distance')} AS distance, {r('similarity_score')} AS similarity_score FROM scored"
ORACLE["comps_topk"] = f"""{_COMPS} SELECT entity_id, season, {r('similarity_score')} AS similarity_score FROM scored
ORDER BY scored.similarity_score DESC, entity_id, season LIMIT 25"""
ORACLE["pitch_type_comps"] = f"""{WITH_PITCH}, ty AS ({pitch_types_sql(False)}),
pool AS (SELECT * FROM ty WHERE pitch_tag = 'FA' AND pitches >= 5),
target AS (SELECT * FROM pool WHERE name = (SELECT min(name) FROM pool) AND season = 1997 AND level_id = 11
  ORDER BY velo LIMIT 1)""" + comps_sql(["velo", "vaa", "vbreak", "hbreak", "SwStr"], "name") + f"""
SELECT name, season, level_id, {r('distance')} AS distance, {r('similarity_score')} AS similarity_score FROM scored"""
ORACLE["vector_comps"] = f"""WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x,
  generate_subscripts(embedding, 1) AS i FROM embeddings),
s AS (SELECT i, stddev_pop(x) AS sd FROM e WHERE vec_id <> 1 GROUP BY i), t AS (SELECT i, x AS tx FROM e WHERE vec_id = 1)
SELECT vec_id, label, {r('sqrt(sum(pow((x - tx) / sd, 2)))', 4)} AS distance
FROM e JOIN s USING (i) JOIN t USING (i) WHERE vec_id <> 1 GROUP BY vec_id, label"""


def anchor_sql(m: str, rev: bool) -> str:
    lo, md, hi = (f"quantile_cont({m}, {q}) OVER (PARTITION BY season, level_id)" for q in ("0.05", "0.5", "0.95"))
    s = (
        f"CASE WHEN {m} IS NULL OR {lo} = {hi} THEN NULL WHEN {m} <= {lo} THEN 0 WHEN {m} >= {hi} THEN 1"
        f" WHEN {m} < {md} THEN 0.5e0 * ({m} - {lo}) / ({md} - {lo})"
        f" ELSE 0.5e0 + 0.5e0 * ({m} - {md}) / ({hi} - {md}) END"
    )
    return f"1 - ({s})" if rev else s


ORACLE["anchored_score"] = f"""{WITH_TABLE} SELECT {ENT}, {r(anchor_sql('miss_rate', True))} AS miss_rate_score,
  {r(anchor_sql('v2_max', False))} AS v2_max_score FROM t"""

# --- features -----------------------------------------------------------------------------

_FLAGS = ", ".join(f"CAST({f} AS INTEGER) AS {f}" for f in ("swing", "whiff", "bbe", "bb", "k"))
_PF = ["spray_angle_adj", "x_adj", "release_x_adj", "haa_adj", "pfx_x_short_adj", "vbreak", "hbreak", "spin_efficiency"]
ORACLE["pitch_features"] = f"""{WITH_PITCH} SELECT game_pk, at_bat_index, pitch_of_ab, batter_mlbid, pitcher_mlbid,
  hitter_name, name, pitch_group, pitch_tag, hitting_code, pitching_code, outs_recorded, pa_id, "count",
  {items([(c, c) for c in _PF])}, CAST(NULL AS DOUBLE) AS xwt, {_FLAGS} FROM feat"""
_FFLAGS = ", ".join(
    f"CAST({f} AS INTEGER) AS {f}"
    for f in ("is_in_play", "swing", "is_contact", "whiff", "called_strike", "is_ball", "is_inzone", "damage"))
ORACLE["feed_features"] = f"""{WITH_FEED} SELECT game_pk, at_bat_number, day AS game_date, hitting_code, pitching_code,
  hitter_name, pitcher_name, {items([(c, c) for c in ('spray_angle', 'spray_angle_adj', 'ivb', 'hb')])},
  pitch_tag, pitch_group, pa_id, {_FFLAGS} FROM feed"""
ORACLE["priority_tag"] = f"""WITH raw AS ({PITCH_RAW}) SELECT pi_pitch_group, pi_pitch_type, pi_pitch_sub_type,
  {_TAG} AS pitch_tag, count(*) AS rows FROM raw GROUP BY ALL"""
ORACLE["group_recode_source"] = f"""{WITH_OBS} SELECT tag_src AS pitch_type, CASE WHEN tag_src IN ('PROMO', 'STANDARD') THEN 'FA'
  WHEN tag_src = 'SMALL' THEN 'BR' WHEN tag_src IN ('LARGE', 'MEDIUM') THEN 'OFF' ELSE 'XX' END AS pitch_group,
  count(*) AS rows FROM obs GROUP BY ALL"""
ORACLE["position_labels"] = f"{WITH_PITCH} SELECT batter_position, position, count(*) AS rows FROM feat GROUP BY ALL"
ORACLE["sensor_ladder"] = f"""SELECT l_orderkey, l_linenumber, l_partkey,
  {r('CASE WHEN l_tax < 0.03::DOUBLE THEN l_tax WHEN l_tax < 0.06::DOUBLE THEN l_discount ELSE l_quantity END')} AS x,
  {r('CASE WHEN l_tax < 0.02::DOUBLE THEN l_tax WHEN l_tax < 0.05::DOUBLE THEN 60.5 - l_quantity WHEN l_tax < 0.07::DOUBLE THEN 60.5 - l_discount END')} AS ext
FROM lineitem"""
# Output and its sources, best first; "-" in front: 60.5 less the source.
_SENSORS = """x px_corr px_adj px_orig
z pz_corr pz_adj pz_orig
haa x_angle_plate_adj x_angle_plate_corr
vaa z_angle_plate_adj z_angle_plate_corr
pitch_velo start_speed_55_corr start_speed_55_adj start_speed_orig
end_velo end_speed_orig end_speed_adj end_speed_corr
plate_time plate_time_orig
x_angle_release x_angle_release_adj x_angle_release_corr
z_angle_release z_angle_release_adj z_angle_release_corr
ext extension_orig -y_release_adj -y_release_corr
rpm obs_spin_rate_orig obs_spin_rate_corr
inf_rpm inf_spin_rate_corr inf_spin_rate_adj inf_spin_rate_orig
pfx_x_short pfx_x_corr pfx_x_adj
pfx_z_short pfx_z_corr pfx_z_adj
x55 x55_corr x55_adj
z55 z55_corr z55_adj
release_x x_release_corr x_release_adj
release_z z_release_corr z_release_adj
axis obs_spin_axis_orig obs_spin_axis_corr
inf_axis inf_spin_axis_corr inf_spin_axis_adj inf_spin_axis_orig
ax ax_adj ax_corr
ay ay_adj ay_corr
az az_adj az_corr"""
_RUNGS = {words[0]: words[1:] for words in map(str.split, _SENSORS.splitlines())}
_PLACE = {n: i for i, n in enumerate(sorted({s.lstrip("-") for rungs in _RUNGS.values() for s in rungs}))}
_MADE = ", ".join(f"CASE WHEN (l_partkey + {3 * i}) % 5 >= 2 THEN l_quantity + {i} * l_discount END AS {n}" for n, i in _PLACE.items())
_READ = ", ".join(
    f"{r('coalesce(' + ', '.join('60.5e0 - ' + s[1:] if s[0] == '-' else s for s in rungs) + ')')} AS {n}" for n, rungs in _RUNGS.items()
)
ORACLE["sensor_ladder_shipped"] = f"""WITH made AS (SELECT l_orderkey, l_linenumber, l_partkey, {_MADE} FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, {_READ} FROM made"""
ORACLE["date_lenient"] = """SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS game_date FROM orders"""
ORACLE["ensure_columns"] = """SELECT o_orderkey, o_orderstatus, CAST(NULL AS DOUBLE) AS decision_value,
  CAST(NULL AS BIGINT) AS damage FROM orders"""
ORACLE["column_contracts"] = """SELECT l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round_even(avg(l_quantity), 1) AS LA_gte_20,
  round_even(CAST(CAST(avg(l_tax) AS FLOAT) AS DOUBLE), 1) AS LA_lte_0, max(l_returnflag) AS hitting_code,
  count(*) AS whiff_rate_n FROM lineitem GROUP BY l_suppkey, l_linenumber"""
ORACLE["finite_fill"] = f"""{WITH_OBS}, s AS (SELECT entity_id, season, sum(CASE WHEN in_zone THEN v1 END) AS a,
  count(*) FILTER (WHERE miss AND v1 > 48) AS b FROM obs GROUP BY ALL)
SELECT entity_id, season, {r('CASE WHEN b > 2 THEN coalesce(a / b, 0) ELSE 0 END')} AS filled FROM s"""
ORACLE["label_encode"] = f"""WITH raw AS ({PITCH_RAW}), s AS (SELECT CASE WHEN is_inzone_pi IS NOT NULL THEN batter_hand END AS stands FROM raw)
SELECT stands, CASE WHEN coalesce(stands, 'R') = 'L' THEN 0 ELSE 1 END AS code, count(*) AS rows FROM s GROUP BY ALL"""
ORACLE["level_names"] = f"""{WITH_OBS} SELECT level_id, CASE level_id WHEN 1 THEN 'MLB' WHEN 11 THEN 'Triple-A' END AS level,
  count(*) AS rows FROM obs GROUP BY ALL"""
ORACLE["half_even_rounding"] = "SELECT DISTINCT l_quantity, round_even(l_quantity / 2, 0) AS half FROM lineitem"
ORACLE["concat_null"] = f"""{WITH_OBS} SELECT entity_name || ' ' || CASE WHEN in_zone THEN side END AS name, count(*) AS rows
FROM obs GROUP BY ALL"""
_LOOSE = pct("miss OR (side = 'O' AND NOT in_zone)", "attempt")
ORACLE["metric_spec_text"] = f"""{WITH_OBS} SELECT team, season, {r(pct('miss'))} AS miss_rate, {r(_LOOSE)} AS loose,
  {r("avg(v2) FILTER (WHERE side IN ('F', 'P'))")} AS v2_ab, {r('max(v1) FILTER (WHERE v1 > 5 AND v1 < 45)')} AS v1_f,
  {r(pct("side IN ('F', 'P') AND NOT in_zone", "side NOT IN ('P')"))} AS listed,
  {r(pct('miss') + ' - ' + _LOOSE)} AS gap FROM obs GROUP BY ALL"""

# --- joins --------------------------------------------------------------------------------

ORACLE["source_join"] = """SELECT CAST(year(l_shipdate) AS BIGINT) AS season, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 11 END AS level_id,
  l_orderkey, l_linenumber, l_partkey, l_quantity, o_orderstatus, o_totalprice, p_brand
FROM lineitem LEFT JOIN orders ON l_orderkey + 1 = o_orderkey LEFT JOIN part ON l_partkey = p_partkey
WHERE year(l_shipdate) BETWEEN 1995 AND 1997 AND l_returnflag <> 'N'"""
ORACLE["multi_key_join"] = """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, max(l_tax) AS tracked
  FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL),
s AS (SELECT l_orderkey, l_partkey, l_suppkey, max(l_discount) AS seen FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, tracked, seen FROM lineitem
LEFT JOIN t USING (l_orderkey, l_linenumber, l_partkey, l_suppkey) LEFT JOIN s USING (l_orderkey, l_partkey, l_suppkey)"""
ORACLE["seen_keys_join"] = """SELECT l_orderkey, l_partkey, l_quantity, o_orderpriority
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey"""
ORACLE["group_mean_backjoin"] = f"""{WITH_OBS} SELECT {ENT}, unit_id, {r('v1')} AS v1, {r('v2')} AS v2,
  {r(f'avg(v1) OVER (PARTITION BY {ENT})')} AS avg_v1, {r(f'avg(v2) OVER (PARTITION BY {ENT})')} AS avg_v2 FROM obs"""
_ALLOWED = "('ECONOMY', 'LARGE', 'PROMO')"
ORACLE["primary_category"] = f"""{WITH_OBS}, c AS (SELECT entity_id, season, tag_src, count(*) AS n FROM obs
  WHERE tag_src IN {_ALLOWED} GROUP BY ALL)
SELECT entity_id, season, first(tag_src ORDER BY n DESC, tag_src) AS primary_tag, min(tag_src) AS first_tag FROM c GROUP BY ALL"""
ORACLE["primary_context"] = f"""{WITH_OBS}, c AS (SELECT entity_id, season, tag_src, count(*) AS n, avg(v1) AS a1, avg(v2) AS a2
  FROM obs WHERE tag_src IN {_ALLOWED} GROUP BY ALL),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY entity_id, season ORDER BY n DESC, tag_src) = 1)
SELECT o.entity_id, o.season, o.tag_src, unit_id, b.tag_src AS primary_tag, {r('a1')} AS primary_v1, {r('a2')} AS primary_v2
FROM obs o LEFT JOIN b ON o.entity_id = b.entity_id AND o.season = b.season"""
ORACLE["baseline_backjoin"] = f"""{WITH_TABLE} SELECT {ENT}, {r('''100e0 * (miss_rate_num / nullif(miss_rate_den, 0)::DOUBLE
  - sum(miss_rate_num) OVER (PARTITION BY season, level_id) / sum(miss_rate_den) OVER (PARTITION BY season, level_id)::DOUBLE)''')} AS miss_vs_avg FROM t"""
ORACLE["merge_frames"] = f"""{WITH_OBS} SELECT {ENT}, {r(pct('miss', 'attempt'))} AS miss_rate,
  {r('avg(v2) FILTER (WHERE seq > 2)')} AS late_v2 FROM obs GROUP BY ALL"""
ORACLE["merge_regressed"] = f"""{WITH_OBS}, s AS (SELECT {ENT}, side, {pct('miss', 'attempt')} AS miss_reg, {cnt('attempt')} AS miss_n
  FROM obs GROUP BY ALL), f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY {ENT} ORDER BY side NULLS FIRST) = 1)
SELECT {ENT}, count(*) AS pitches, any_value({r('miss_reg')}) AS miss_reg, any_value(miss_n) AS miss_n
FROM obs LEFT JOIN f USING ({ENT}) GROUP BY ALL"""
ORACLE["dedupe_latest"] = """SELECT user_id, event_type, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) = 1"""
ORACLE["union_diagonal"] = f"""{WITH_OBS}
SELECT season, {r(pct('miss', 'attempt'))} AS miss_rate, CAST(NULL AS VARCHAR) AS side, CAST(NULL AS BIGINT) AS pitches FROM obs GROUP BY season
UNION ALL SELECT season, NULL, side, count(*) FROM obs GROUP BY season, side"""
ORACLE["distinct_keys"] = f"{WITH_OBS} SELECT DISTINCT entity_id, season, team FROM obs"

# --- leaderboards and filters ----------------------------------------------------------------

ORACLE["leaderboard"] = f"""{WITH_OBS}, t AS (SELECT entity_id, entity_name, season, level_id, count(*) AS n,
  {pct('miss', 'attempt')} AS m, {pct('attempt AND NOT in_zone', 'NOT in_zone')} AS c, {nearest('v1', 0.9)} AS q
  FROM obs GROUP BY entity_id, entity_name, season, level_id)
SELECT entity_name AS "Name", season AS "Season", level_id AS "Level", n AS "N", {r('m')} AS "Miss", {r('c')} AS "Chase",
  {r('q')} AS "V90" FROM t WHERE n >= 50 ORDER BY m DESC NULLS LAST, entity_id, season, level_id LIMIT 100"""
_PLAIN = {"hitter_name", "hitting_code", "season", "PA", "bbe", "name", "pitching_code", "TBF", "pitches", "pitch_tag", "level_id"}


_ABSENT = {"Zone", "Zone_reg", "stuff_z"}  # in the published lists, in none of the tables here


def board_sql(name: str, src: str, cond: str, plain: bool = False, absent: set[str] = _ABSENT) -> str:
    preset = BOARDS[name]

    def shown(c: str) -> str:
        source = "team" if c in preset.legacy.values() else c
        if c in preset.whole:
            return r(f"round_even({c}, 0)")
        return source if plain or c in _PLAIN else r(c)

    cols = ", ".join(f'{shown(c)} AS "{preset.names.get(c, c)}"' for c in preset.columns if c not in absent)
    return f"SELECT {cols} FROM {src} WHERE level_id IN (1, 11, 14, 16) AND {cond}"


ORACLE["board_hitters"] = f"{WITH_PITCH}, h AS ({hitters_sql(False)}) " + board_sql("hitters", "h", "level_id = 1 AND PA >= 20")
ORACLE["board_pitchers"] = _G2 + " " + board_sql("pitchers", "arms", "season IN (1996, 1998) AND IP >= 2")
ORACLE["board_pitch_types"] = _G2 + " " + board_sql("pitch_types", "ty", "level_id = 1 AND pitch_tag IN ('FA', 'SL') AND pitches >= 5")
ORACLE["board_team_hitting"] = f"""{WITH_PITCH}, t AS ({group_hitting_sql('hitting_code, level_id, season', 'hitting_code')})
{board_sql("team_hitting", "t", "level_id = 11")}"""
ORACLE["board_league_hitting"] = f"""{WITH_PITCH}, t AS ({group_hitting_sql('level_id, season', None)})
{board_sql("league_hitting", "t", "TRUE")}"""
ORACLE["board_hitter_pctiles"] = f"""WITH ranked AS ({ORACLE["hitter_pctiles"]}), plain AS ({WITH_PITCH} {hitters_sql(False)})
{board_sql("hitter_pctiles", "(SELECT ranked.*, team, bbe FROM ranked JOIN plain ON ranked.batter_mlbid = plain.batter_mlbid AND ranked.season = plain.season AND ranked.level_id = plain.level_id AND ranked.hitter_name IS NOT DISTINCT FROM plain.hitter_name)", "bbe >= 5", True)}"""
_q = lambda s: f"max(CASE WHEN stat = '{s}' THEN reg END)"
_REGS = [f"{_q(s)} AS {s}_reg" for s in [*_TAB_RATES, *_TAB_VALUES]] + [
    f"{_q('selection_skill')} - {_q('hittable_pitches_taken')} AS SEAGER_reg",
    f"{_q('pred_whiff_loc_mean')} - {_q('whiff_rate')} - max(base) AS contact_vs_avg_reg",
]
_WITH_REG = f"""{WITH_PITCH}, h AS ({hitters_sql(False)}),
lgb AS (SELECT season, level_id, 100e0 * sum(pred_whiff_loc_mean * pred_whiff_loc_mean_n) / sum(pred_whiff_loc_mean_n)
  - 100e0 * sum(whiff_rate_num) / sum(whiff_rate_den) AS base FROM h GROUP BY ALL),
s AS ({shrunk(_TAB_CELLS, _HIT_CONST, _ON, _LOCPCT)}),
reg AS (SELECT s.batter_mlbid, s.hitter_name, s.level_id, s.season, {', '.join(_REGS)}
  FROM s LEFT JOIN lgb USING (season, level_id) GROUP BY ALL),
joined AS (SELECT h.*, reg.* EXCLUDE ({HKEYS}) FROM h LEFT JOIN reg USING ({HKEYS}))"""
ORACLE["board_hitters_regressed"] = f"{_WITH_REG} " + board_sql("hitters_regressed", "joined", "level_id = 1 AND PA >= 20")
for _board, _by, _code, _grade, _cond in (
    ("team_pitching", "pitching_code, level_id, season", "pitching_code", "g2", "level_id = 1 AND IP >= 2"),
    ("league_pitching", "level_id, season", None, "g3", "TRUE"),
):
    ORACLE[f"board_{_board}"] = f"""{_G2}, plain AS ({group_pitching_sql(_by, _code, False)}),
t AS (SELECT plain.*, {_grade}.stuff FROM plain LEFT JOIN {_grade} USING ({_by}))
{board_sql(_board, "t", _cond, absent={*_ABSENT, "BB_rpm"})}"""


def _beside(table: str, keys: str, other: str, wanted: list[str], as_rows: str) -> str:
    """Columns of another query's rows beside a graded table's, by NULL-safe keys."""
    same = " AND ".join(f"x.{k} IS NOT DISTINCT FROM o.{k}" for k in keys.split(", "))
    columns = ", ".join(f"o.{c}" for c in wanted)
    return f"{_G2}, other AS ({other}), {as_rows} AS (SELECT x.*, {columns} FROM {table} x LEFT JOIN other o ON {same})"


def _shown(name: str, end: str) -> list[str]:
    return [c for c in BOARDS[name].columns if c.endswith(end) and c not in _ABSENT]


ORACLE["board_pitcher_pctiles"] = _beside(
    "arms", PKEYS, ORACLE["pitcher_pctiles"], _shown("pitcher_pctiles", "_pctile"), "t"
) + board_sql("pitcher_pctiles", "t", "IP >= 2", True)
ORACLE["board_pitch_type_pctiles"] = _beside(
    "ty", TKEYS, ORACLE["pitch_type_pctiles"], _shown("pitch_type_pctiles", "_pctile"), "t"
) + board_sql("pitch_type_pctiles", "t", "level_id = 1 AND pitch_tag IN ('FA', 'SL')")
ORACLE["board_pitchers_regressed"] = _beside(
    "arms", PKEYS, ORACLE["regressed_pitchers_from_table"], _shown("pitchers_regressed", "_reg"), "t"
) + board_sql("pitchers_regressed", "t", "level_id = 1 AND IP >= 2")
ORACLE["board_pitch_types_regressed"] = _beside(
    "ty", TKEYS, ORACLE["regressed_pitch_types_from_table"], _shown("pitch_types_regressed", "_reg"), "t"
) + board_sql("pitch_types_regressed", "t", "level_id = 1 AND pitch_tag IN ('FA', 'SL') AND pitches >= 5")
ORACLE["hitter_comparisons"] = f"""{_WITH_REG}, pool AS (SELECT * FROM joined WHERE level_id = 1 AND PA >= 20),
target AS (SELECT * FROM joined WHERE level_id = 1 AND PA >= 5 AND season = 1996 AND hitter_name = 'B Supplier#000000001')
{comps_sql(HITTER_FEATURES, 'hitter_name')} SELECT hitter_name, season, {r('distance')} AS distance,
{r('similarity_score')} AS similarity_score FROM scored"""
ORACLE["pitcher_comparisons"] = f"""{_G2}, pool AS (SELECT * FROM arms WHERE level_id = 1 AND IP >= 1),
target AS (SELECT * FROM arms WHERE level_id = 1 AND IP >= 0 AND season = 1996 AND name = 'P Arm1')
{comps_sql(PITCHER_FEATURES, 'name')} SELECT name, season, {r('distance')} AS distance,
{r('similarity_score')} AS similarity_score FROM scored"""
ORACLE["filter_ops"] = """SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part
WHERE p_size BETWEEN 10 AND 30 AND p_retailprice >= 950 AND regexp_matches(p_name, 'R.*G', 'i') AND p_brand <> 'Brand#11'
  AND p_size NOT IN (12, 13)"""
ORACLE["filter_compare"] = """SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem
WHERE l_linenumber = 2 AND l_quantity <= 30 AND l_quantity > 3 AND l_discount > l_tax"""
ORACLE["filter_all_aware"] = """SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice FROM orders
WHERE o_orderstatus IN ('F', 'O') AND o_totalprice >= 100000"""
ORACLE["training_filter"] = f"""{WITH_PITCH} SELECT season, pitch_group, count(*) AS rows FROM feat
WHERE pitch_group IN ('FA', 'BR', 'OFF') AND pitch_velo >= 80 AND home_team <> 'H3' AND pitch_outcome <> 'X' AND strikes = 2
  AND ext IS NOT NULL AND inf_rpm IS NOT NULL GROUP BY ALL"""
ORACLE["page"] = "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50 OFFSET 100"
ORACLE["page_deep"] = """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 9980"""
ORACLE["page_all"] = "SELECT c_custkey, c_name, c_acctbal FROM customer"
ORACLE["distinct_options"] = f"""{WITH_OBS} SELECT DISTINCT CAST(season AS VARCHAR) AS "option" FROM obs
UNION ALL SELECT DISTINCT team FROM obs WHERE team IS NOT NULL"""

# --- scoring ------------------------------------------------------------------------------

_ROW = "game_pk, at_bat_index, pitch_of_ab, batter_mlbid"
ORACLE["score_linear"] = f"""WITH raw AS ({PITCH_RAW}) SELECT {_ROW},
  {r('0.25e0 + 0.01e0 * coalesce(pitch_velo, 0) - 0.2e0 * vaa + 0.0005e0 * rpm')} AS stuff, CAST(NULL AS DOUBLE) AS nothing FROM raw"""
ORACLE["score_probability"] = f"""{WITH_PITCH} SELECT {_ROW},
  {r('1 / (1 + exp(-(-1 + 0.02e0 * coalesce(pitch_velo, 0) - 0.5e0 * x_adj + 0.03e0 * vbreak)))')} AS p FROM feat"""
ORACLE["score_subset"] = f"""WITH raw AS ({PITCH_RAW}) SELECT {_ROW},
  {r('CASE WHEN is_in_play THEN 5 + 0.9e0 * coalesce(exit_velo, 0) + 0.1e0 * coalesce(launch_angle, 0) END')} AS damage FROM raw"""
_HOME = "CASE coalesce(home_team, 'unknown') WHEN 'H1' THEN 0.2e0 WHEN 'H2' THEN -0.2e0 WHEN 'unknown' THEN 0.7e0 ELSE 0 END"
_GROUP = "CASE coalesce(pi_pitch_group, 'unknown') WHEN 'FA' THEN 0.4e0 WHEN 'CU' THEN -0.6e0 WHEN 'unknown' THEN -0.9e0 ELSE 0 END"
_LOGIT = f"-3 + 0.02e0 * coalesce(pitch_velo, 86) - 0.3e0 * vaa + 5 * 0.02e0 + 0.1e0 * coalesce(ext, 0) + {_HOME} + {_GROUP} + 0.15e0"
ORACLE["score_table_class"] = f"""WITH raw AS ({PITCH_RAW}) SELECT {_ROW}, {r(f'1 / (1 + exp(-({_LOGIT})))')} AS p FROM raw"""
_DAMAGED = """CASE WHEN exit_velo IS NULL OR exit_velo < 95 THEN 0.1e0 WHEN coalesce(launch_angle, 12) < 8 THEN 0.3e0 ELSE 0.9e0 END
  + CASE WHEN pi_pitch_group IS NULL OR pi_pitch_group = 'SL' THEN -0.05e0 WHEN batter_hand = 'L' THEN 0.02e0 ELSE 0e0 END"""
ORACLE["score_table_trees"] = f"""WITH raw AS ({PITCH_RAW}) SELECT {_ROW}, {r(_DAMAGED)} AS damage FROM raw"""
ORACLE["residual_adjust"] = f"""WITH raw AS ({PITCH_RAW}) SELECT {_ROW},
  {r('vaa - (-2 + 0.5e0 * z - 0.04e0 * coalesce(pitch_velo, 0))')} AS loc_adj_vaa FROM raw"""
ORACLE["signed_value"] = f"""{WITH_PITCH} SELECT batter_mlbid, season,
  {r('avg(CASE WHEN NOT swing THEN -decision_value ELSE decision_value END)')} AS signed FROM feat GROUP BY ALL"""
_SIG = lambda x: f"1 / (1 + exp(-({x})))"
ORACLE["score_chain"] = f"""{with_pitch('vaa - (-2 + 0.5e0 * z - 0.04e0 * coalesce(pitch_velo, 0))')},
ax AS (SELECT pitcher_mlbid, level_id, season, avg(ext) AS avg_ext FROM feat GROUP BY ALL),
sc AS (SELECT batter_mlbid, p.season, loc_adj_vaa,
  {_SIG('-2 + 0.01e0 * coalesce(pitch_velo, 0) + 0.02e0 * coalesce(primary_velo, 0) + 0.1e0 * x')} AS pred_whiff_loc,
  {_SIG('-2 + 0.01e0 * coalesce(pitch_velo, 0) + 0.3e0 * coalesce(avg_ext, 0)')} AS pred_whiff_base,
  CASE WHEN is_in_play THEN 5 + 0.9e0 * coalesce(exit_velo, 0) + 0.1e0 * coalesce(launch_angle, 0) END AS damage_pred,
  (CASE WHEN swing THEN 1 ELSE -1 END) * (0.1e0 * coalesce(balls, 0) + 0.2e0 * x + 0.3e0 * CASE WHEN stands = 'L' THEN 0 ELSE 1 END) AS decision_value,
  0.1e0 * loc_adj_vaa + 0.001e0 * coalesce(primary_rpm, 0) AS stuff_raw
  FROM pitch p LEFT JOIN ax USING (pitcher_mlbid, level_id, season))
SELECT batter_mlbid, season, {', '.join(f'{r(f"avg({c})")} AS {c}' for c in
  ('loc_adj_vaa', 'pred_whiff_loc', 'pred_whiff_base', 'damage_pred', 'decision_value', 'stuff_raw'))},
  count(damage_pred) AS damage_n FROM sc GROUP BY ALL"""
ORACLE["evaluate"] = f"""WITH raw AS ({PITCH_RAW}), g AS (SELECT level_id, exit_velo AS y,
  exit_velo * 0.9e0 + coalesce(launch_angle, 0) * 0.1e0 + 5 AS p FROM raw WHERE exit_velo IS NOT NULL)
SELECT level_id, {r('sqrt(avg(pow(y - p, 2)))')} AS rmse, {r('1 - sum(pow(y - p, 2)) / (count(*) * var_pop(y))')} AS r2,
  {r('avg(abs(y - p))')} AS mae, {r('corr(y, p)')} AS correlation, count(*) AS n FROM g GROUP BY ALL"""

# --- samples ------------------------------------------------------------------------------

_HASH = "CAST('0x' || substr(md5('17|' || CAST(o_orderkey AS VARCHAR)), 1, 13) AS BIGINT)"
ORACLE["hash_split"] = f"""SELECT o_orderstatus, CASE WHEN {_HASH} < (1::BIGINT << 50) THEN 'test' ELSE 'train' END AS split,
  count(*) AS rows FROM orders GROUP BY ALL"""
ORACLE["stratified_sample"] = f"""WITH o AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, {_HASH} AS h FROM orders),
c AS (SELECT o_orderstatus, o_orderpriority, count(*) * least(500, sum(count(*)) OVER ()) AS share, sum(count(*)) OVER () AS total
  FROM o GROUP BY ALL),
q AS (SELECT *, share // total AS whole,
  row_number() OVER (ORDER BY share % total DESC, o_orderstatus, o_orderpriority) AS place FROM c),
g AS (SELECT *, whole + CASE WHEN place <= 500 - sum(whole) OVER () THEN 1 ELSE 0 END AS quota FROM q)
SELECT o_orderkey, o_orderstatus, o_orderpriority
FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY h) AS r FROM o)
JOIN g USING (o_orderstatus, o_orderpriority) WHERE r <= quota"""

# --- sources and sinks --------------------------------------------------------------------

ORACLE["csv_by_name"] = """SELECT o_orderkey, o_orderstatus, o_totalprice, CAST(NULL AS BIGINT) AS o_rank,
  CAST(NULL AS VARCHAR) AS o_note FROM orders"""
ORACLE["fact_round_trip"] = """SELECT CAST(year(l_shipdate) AS BIGINT) AS season,
  CASE WHEN l_linestatus = 'F' THEN 1 ELSE 11 END AS level_id, 'R' AS game_type, l_orderkey, l_linenumber, l_extendedprice
FROM lineitem"""
ORACLE["snapshot_newest"] = "SELECT o_orderkey, o_totalprice, 2025 AS taken FROM orders"
ORACLE["missing_source"] = """SELECT o_orderkey, o_orderstatus, CAST(NULL AS VARCHAR) AS note, CAST(NULL AS DOUBLE) AS weight
FROM orders"""
ORACLE["sample_sink"] = """SELECT 'all' AS sample, count(*) AS rows FROM customer
UNION ALL SELECT 'first', least(count(*), 1000) FROM customer UNION ALL SELECT 'none', 0"""
ORACLE["empty_input"] = ORACLE["entity_rates"]
ORACLE["publish_replaced"] = f"""{WITH_PITCH}, fixed AS (
  SELECT * EXCLUDE (pitch_velo), CASE WHEN season = 1996 THEN pitch_velo + 1 ELSE pitch_velo END AS pitch_velo
  FROM pitch WHERE season IS DISTINCT FROM 1996 OR pitch_of_ab <> 1)
SELECT {_GRAIN}, count(*) AS pitches, {_PA_WITH_NULL} AS TBF, count(DISTINCT game_pk) AS games, {r(exact('pitch_velo'))} AS velo,
  {r('max(pitch_velo)')} AS top_velo, {r(nearest('pitch_velo', 0.9))} AS velo_q90
FROM fixed GROUP BY GROUPING SETS {_GRAINS}"""
