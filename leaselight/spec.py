"""The valuation spec: what is fixed by contract with the users of the scores, and how it is read.

Fixed values: weights, bands, thresholds, codes and ids below must stay as they are
for scores to be comparable; texts are ours.
"""

from __future__ import annotations

import copy
import json
from typing import Any

from pyspark.sql import SparkSession, types as T

HUBS = ["tokyo_station", "shinjuku", "shibuya", "ikebukuro", "ueno", "shinagawa", "osaka_station", "umeda", "namba", "tennoji", "other"]
PREFECTURES = ["saitama", "tokyo", "chiba", "kanagawa", "osaka"]
LAYOUTS = ["1R", "1K", "1DK", "1LDK"]
STRUCTURES = ["wood", "light_steel", "steel", "rc", "src", "other"]
ORIENTATIONS = ["N", "NE", "E", "SE", "S", "SW", "W", "NW", "UNKNOWN"]
BREAKDOWN = ["shikikin_yen", "reikin_yen", "brokerage_fee_yen", "guarantor_fee_yen", "fire_insurance_yen", "key_change_yen", "cleaning_fee_yen", "other_initial_fees_yen"]

#: key, type, required, least, most, allowed values, unit
FIELDS: list[tuple[str, str, bool, float | None, float | None, list[str] | None, str]] = [
    ("hub_station", "enum", True, None, None, HUBS, ""),
    ("hub_station_other_name", "string", False, None, None, None, ""),
    ("prefecture", "enum", True, None, None, PREFECTURES, ""),
    ("nearest_station_name", "string", True, None, None, None, ""),
    ("station_walk_min", "integer", True, 0, 60, None, "min"),
    ("layout_type", "enum", True, None, None, LAYOUTS, ""),
    ("building_structure", "enum", True, None, None, STRUCTURES, ""),
    ("area_sqm", "number", True, 5, 80, None, "sqm"),
    ("building_built_year", "integer", True, 1950, 2035, None, "year"),
    ("orientation", "enum", True, None, None, ORIENTATIONS, ""),
    ("bathroom_toilet_separate", "boolean", True, None, None, None, ""),
    ("rent_yen", "integer", True, 0, 500_000, None, "yen"),
    ("mgmt_fee_yen", "integer", True, 0, 100_000, None, "yen"),
    ("initial_cost_total_yen", "integer", True, 0, 2_000_000, None, "yen"),
    ("municipality", "string", False, None, None, None, ""),
    ("line_name", "string", False, None, None, None, ""),
    ("shikikin_yen", "integer", False, 0, 2_000_000, None, "yen"),
    ("reikin_yen", "integer", False, 0, 2_000_000, None, "yen"),
    ("brokerage_fee_yen", "integer", False, 0, 2_000_000, None, "yen"),
    ("guarantor_fee_yen", "integer", False, 0, 2_000_000, None, "yen"),
    ("fire_insurance_yen", "integer", False, 0, 300_000, None, "yen"),
    ("key_change_yen", "integer", False, 0, 200_000, None, "yen"),
    ("cleaning_fee_yen", "integer", False, 0, 300_000, None, "yen"),
    ("other_initial_fees_yen", "integer", False, 0, 500_000, None, "yen"),
    ("contract_term_months", "integer", False, 0, 60, None, "months"),
    ("renewal_fee_months", "number", False, 0, 2, None, "months"),
    ("early_termination_penalty_yen", "integer", False, 0, 2_000_000, None, "yen"),
]
_SPARK = {"enum": T.StringType(), "string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}


def subject_schema() -> T.StructType:
    return T.StructType([T.StructField("listing_id", T.StringType()), *(T.StructField(f[0], _SPARK[f[1]]) for f in FIELDS)])


def _upto(*pairs: tuple[float, float], default: float, beyond: tuple[float, float] | None = None) -> dict[str, Any]:
    steps = [{"max": m, "score": s} for m, s in pairs] + ([{"min": beyond[0], "score": beyond[1]}] if beyond else [])
    return {"buckets": steps, "default": default}


NEUTRAL = {"neutral_if": ["none", "low"], "neutral_score": 70}
SCORING: dict[str, Any] = {
    "weights": {"location": 0.35, "condition": 0.25, "cost": 0.4},
    "im_shift_months": 1.0,
    "bands": [["A", 85], ["B", 70], ["C", 55], ["D", 0]],
    "features": [
        {"id": "loc_station_walk_min", "component": "location", "input": "station_walk_min", "method": "bucket", "weight": 0.4, "params": _upto((5, 95), (10, 90), (12, 83), (15, 75), (20, 60), (30, 40), beyond=(31, 20), default=55)},
        {"id": "loc_area_access_score_0_100", "component": "location", "input": "area_access_score_0_100", "method": "linear", "weight": 0.6, "params": {"x": [0, 100], "y": [0, 100], "clamp": True, "higher_is_better": True, "default": 70, **NEUTRAL}},
        {"id": "cond_area_sqm", "component": "condition", "input": "area_sqm", "method": "linear", "weight": 0.32, "params": {"x": [12, 35], "y": [40, 100], "clamp": True, "higher_is_better": True, "default": 70}},
        {"id": "cond_building_age_years", "component": "condition", "input": "building_age_years", "method": "bucket", "weight": 0.32, "params": _upto((5, 95), (10, 85), (20, 70), (30, 55), (40, 40), beyond=(41, 25), default=55)},
        {"id": "cond_orientation", "component": "condition", "input": "orientation", "method": "lookup", "weight": 0.14, "params": {"table": {"S": 95, "SE": 90, "SW": 90, "E": 80, "W": 80, "NE": 65, "NW": 65, "N": 55, "UNKNOWN": 70}, "default": 70}},
        {"id": "cond_bathroom_toilet_separate", "component": "condition", "input": "bathroom_toilet_separate", "method": "boolean", "weight": 0.14, "params": {"true": 85, "false": 60}},
        {"id": "cond_building_structure", "component": "condition", "input": "building_structure", "method": "lookup", "weight": 0.08, "params": {"table": {"wood": 72, "light_steel": 77, "steel": 80, "rc": 88, "src": 90, "other": 78}, "default": 78}},
        {"id": "cost_rent_delta_ratio", "component": "cost", "input": "rent_delta_ratio", "method": "bucket", "weight": 0.6, "params": _upto((-0.1, 95), (-0.05, 85), (0.0, 75), (0.05, 70), (0.1, 55), (0.2, 35), default=15) | NEUTRAL},
        {"id": "cost_initial_multiple_im", "component": "cost", "input": "initial_multiple_market_delta_foreigner", "method": "bucket", "weight": 0.4, "params": _upto((-1.0, 95), (-0.5, 85), (0.0, 75), (0.5, 70), (1.0, 55), (2.0, 40), default=20)},
    ],
}


def var(name: str) -> dict[str, str]:
    return {"var": name}


def present_and(op: str, name: str, value: float) -> dict[str, Any]:
    return {"and": [{"!=": [var(name), None]}, {op: [var(name), value]}]}


#: id, priority, condition, flag, severity; all that match apply, in order
RISK_RULES: list[tuple[str, int, dict[str, Any], str, str]] = [
    ("RF_HIGH_INITIAL_MULTIPLE", 100, {">=": [var("initial_multiple"), 6.0]}, "HIGH_INITIAL_MULTIPLE", "high"),
    ("RF_FAR_FROM_STATION", 200, {">=": [var("station_walk_min"), 15]}, "FAR_FROM_STATION", "mid"),
    ("RF_VERY_SMALL_AREA", 300, {"<": [var("area_sqm"), 15]}, "VERY_SMALL_AREA", "mid"),
    ("RF_OLD_BUILDING", 400, {">=": [var("building_age_years"), 30]}, "OLD_BUILDING", "mid"),
    ("RF_NORTH_FACING", 500, {"==": [var("orientation"), "N"]}, "NORTH_FACING", "low"),
    ("RF_BATH_NOT_SEPARATE", 600, {"==": [var("bathroom_toilet_separate"), False]}, "BATH_NOT_SEPARATE", "low"),
    ("RF_HIGH_OTHER_FEES", 700, present_and(">=", "other_initial_fees_yen", 100_000), "HIGH_OTHER_FEES", "high"),
    ("RF_LONG_CONTRACT_TERM", 800, present_and(">=", "contract_term_months", 24), "LONG_CONTRACT_TERM", "high"),
    ("RF_HIGH_EARLY_TERMINATION_PENALTY", 900, present_and(">=", "early_termination_penalty_yen", 100_000), "HIGH_EARLY_TERMINATION_PENALTY", "high"),
]
ALWAYS = {"==": [1, 1]}


def _both(a: tuple[str, str, float], b: tuple[str, str, float]) -> dict[str, Any]:
    return {"and": [{op: [var(k), v]} for k, op, v in (a, b)]}


#: id, priority, condition, tag; the first in ascending order applies
TRADEOFF_RULES: list[tuple[str, int, dict[str, Any], str]] = [
    ("TR_CONDITION_HIGH_COST_LOW", 100, _both(("condition_score", ">=", 75), ("cost_score", "<=", 55)), "condition_high_cost_low"),
    ("TR_LOCATION_HIGH_CONDITION_LOW", 200, _both(("location_score", ">=", 75), ("condition_score", "<=", 55)), "location_high_condition_low"),
    ("TR_LOCATION_LOW_COST_HIGH", 300, _both(("location_score", "<=", 55), ("cost_score", ">=", 75)), "location_low_cost_high"),
    ("TR_DEFAULT_BALANCED", 999, ALWAYS, "balanced"),
]

#: id, condition, action, target, value
WHATIF_RULES: list[tuple[str, dict[str, Any], str, str, float | None]] = [
    ("WI_REDUCE_INITIAL_TOTAL_50K", ALWAYS, "delta_yen", "initial_cost_total_yen", -50_000),
    ("WI_SET_REIKIN_ZERO", present_and(">", "reikin_yen", 0), "set_zero", "reikin_yen", None),
    ("WI_SCALE_BROKERAGE_HALF", present_and(">", "brokerage_fee_yen", 0), "scale", "brokerage_fee_yen", 0.5),
]

_STRONG = {"and": [{">=": [var("overall_score"), 75]}, *({">=": [var(f"{c}_score"), 55]} for c in ("location", "condition", "cost")), {"in": [var("benchmark_confidence"), ["high", "mid"]]}]}
#: id, priority, condition, summary, evidence, negotiation; the first in descending order applies.  The texts are ours.
TEMPLATES: list[tuple[str, int, dict[str, Any], str, list[str], list[str]]] = [
    ("R01_BENCHMARK_NONE", 900, {"==": [var("benchmark_confidence"), "none"]}, "Overall {overall_grade} ({overall_score}); no market figure for {layout_type} in {prefecture}.", ["Monthly cost is {monthly_fixed_cost_yen} yen."], ["Ask for comparable rents nearby."]),
    ("R02_BENCHMARK_LOW", 850, {"==": [var("benchmark_confidence"), "low"]}, "Overall {overall_grade}; the market figure is uncertain.", ["Rent differs by {rent_delta_ratio} from a rough figure."], ["Check two more offers first."]),
    ("R03_CONDITION_HIGH_COST_LOW", 800, _both(("condition_score", ">=", 70), ("cost_score", "<=", 40)), "Good condition ({condition_score}) at a high price ({cost_score}).", ["Initial cost is {initial_multiple} months."], ["Ask to lower the key money."]),
    ("R04_LOCATION_HIGH_CONDITION_LOW", 750, _both(("location_score", ">=", 70), ("condition_score", "<=", 40)), "Good location ({location_score}), weak condition ({condition_score}).", ["{nearest_station_name} is {station_walk_min} minutes away; built {building_age_years} years ago."], ["Ask for repairs before moving in."]),
    ("R05_COST_HIGH_LOCATION_LOW", 700, _both(("cost_score", ">=", 70), ("location_score", "<=", 40)), "Cheap ({cost_score}) but far out ({location_score}).", ["{station_walk_min} minutes to {nearest_station_name}."], ["Ask about bicycle parking."]),
    ("R06_BALANCED_STRONG", 650, _STRONG, "Strong in all respects: {overall_grade} ({overall_score}).", ["Location {location_grade}, condition {condition_grade}, cost {cost_grade}."], ["Apply soon."]),
    ("R07_HIGH_INITIAL_MULTIPLE", 600, {"and": [{">=": [var("initial_multiple"), 6.0]}, {"<=": [var("cost_score"), 55]}]}, "High initial cost: {initial_cost_total_yen} yen, {initial_multiple} months.", ["Cost grade {cost_grade}."], ["Ask for fee details."]),
    ("R08_FAR_FROM_STATION", 550, {">=": [var("station_walk_min"), 16]}, "{station_walk_min} minutes from {nearest_station_name}.", ["Area {area_sqm} sqm facing {orientation}."], ["Ask about bus lines."]),
    ("R99_FALLBACK_GENERAL", 0, ALWAYS, "Overall {overall_grade} ({overall_score}) for {layout_type}.", ["Separate bath: {bathroom_toilet_separate}."], ["Compare with similar offers."]),
]

IM_MARKET_AVERAGE = {"tokyo": 5.0, "osaka": 5.0, "saitama": 4.5, "chiba": 4.5, "kanagawa": 4.5}
IM_MARKET_DEFAULT = 4.5
STRUCTURE_MULTIPLIERS = {"wood": 0.90, "light_steel": 0.94, "steel": 0.98, "rc": 1.08, "src": 1.12, "other": 1.00}
MULTIPLIER_RANGE = (0.85, 1.15)
MGMT_FEE_RATE, MGMT_FEE_CAP = 0.05, 20_000
OUTLIER_RATIO = 2.0
IMPUTATION_RATIOS = {"wood": 0.78, "light_steel": 0.87, "steel": 0.80, "src": 0.94}
MIN_SAMPLES = 20


def load(spark: SparkSession, path: str) -> dict[str, Any]:
    """A scoring spec kept as one JSON document, over the built-in one; read by Spark, so any store will do."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    return copy.deepcopy(SCORING) | json.loads(text)
