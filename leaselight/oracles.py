"""The queries of the catalog once more, as DuckDB SQL over the same tables."""

from __future__ import annotations

from typing import Any

from . import spec
from .operators import comparables
from .plans import adapters, regression
from .plans.adapters import AS_OF_YEAR


def _d(x: float) -> str:
    return f"{float(x)!r}e0"


def _base(*names: str) -> str:
    out = [f"{n} AS ({adapters.sql(n) if n != 'offers' else adapters.OFFERS.replace('({market})', 'market')})" for n in names]
    return ",\n".join(out)


_CASE = lambda table, key, default: f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {_d(v)}" for k, v in table.items()) + f" ELSE {default} END"

MEASURED = f"""m1 AS (
  SELECT *, rent_yen + mgmt_fee_yen AS monthly_fixed_cost_yen, greatest(0, {AS_OF_YEAR} - building_built_year) AS building_age_years,
    {_CASE(spec.IM_MARKET_AVERAGE, 'prefecture', _d(spec.IM_MARKET_DEFAULT))} AS im_market_avg FROM subjects
), m2 AS (
  SELECT *, CASE WHEN monthly_fixed_cost_yen > 0 THEN initial_cost_total_yen / monthly_fixed_cost_yen ELSE 0e0 END AS initial_multiple FROM m1
), m AS (
  SELECT *, greatest(0e0, initial_multiple - 1e0) AS initial_multiple_foreigner, initial_multiple - im_market_avg AS initial_multiple_market_delta,
    greatest(0e0, initial_multiple - 1e0) - im_market_avg AS initial_multiple_market_delta_foreigner,
    CASE WHEN initial_multiple - im_market_avg <= -1.5e0 THEN 'very low' WHEN initial_multiple - im_market_avg <= -1e0 THEN 'low'
      WHEN initial_multiple - im_market_avg < 1e0 THEN 'average' WHEN initial_multiple - im_market_avg < 1.5e0 THEN 'rather high' ELSE 'high' END AS im_assessment FROM m2
)"""

INDEX = """idx AS (
  SELECT * FROM (
    SELECT CASE WHEN grouping(building_structure) = 0 THEN 'structure' WHEN grouping(municipality) = 0 THEN 'municipality' ELSE 'prefecture' END AS level,
      prefecture, municipality, layout_type, building_structure, CAST(trunc(median(avg_rent_yen)) AS BIGINT) AS benchmark_rent_yen_median, count(*) AS n_rows
    FROM market GROUP BY GROUPING SETS ((prefecture, municipality, layout_type, building_structure), (prefecture, municipality, layout_type), (prefecture, layout_type))
  ) WHERE level <> 'structure' OR building_structure <> 'all'
)"""

_MULTIPLIER = f"greatest({_d(spec.MULTIPLIER_RANGE[0])}, least({_d(spec.MULTIPLIER_RANGE[1])}, {_CASE(spec.STRUCTURE_MULTIPLIERS, 'building_structure', '1e0')}))"
MATCHED = f"""j AS (
  SELECT m.*, s.benchmark_rent_yen_median AS sr, s.n_rows AS sn, u.benchmark_rent_yen_median AS ur, u.n_rows AS un, p.benchmark_rent_yen_median AS pr, p.n_rows AS pn
  FROM m LEFT JOIN idx s ON s.level = 'structure' AND s.prefecture = m.prefecture AND s.municipality = m.municipality AND s.layout_type = m.layout_type AND s.building_structure = m.building_structure
    LEFT JOIN idx u ON u.level = 'municipality' AND u.prefecture = m.prefecture AND u.municipality = m.municipality AND u.layout_type = m.layout_type
    LEFT JOIN idx p ON p.level = 'prefecture' AND p.prefecture = m.prefecture AND p.layout_type = m.layout_type
), k1 AS (
  SELECT *, CASE WHEN building_structure NOT IN ('', 'other', 'all') AND sn >= 2 THEN 'structure' WHEN un IS NOT NULL THEN 'municipality' WHEN pn IS NOT NULL THEN 'prefecture' ELSE 'none' END AS matched_level FROM j
), k2 AS (
  SELECT *, CASE matched_level WHEN 'structure' THEN sr WHEN 'municipality' THEN ur WHEN 'prefecture' THEN pr END AS benchmark_raw_yen,
    CASE matched_level WHEN 'structure' THEN sn WHEN 'municipality' THEN un WHEN 'prefecture' THEN pn END AS benchmark_n_rows,
    CASE matched_level WHEN 'structure' THEN 'high' WHEN 'municipality' THEN CASE WHEN un >= 2 THEN 'high' ELSE 'mid' END WHEN 'prefecture' THEN 'mid' ELSE 'none' END AS benchmark_confidence,
    CASE matched_level WHEN 'structure' THEN 1e0 ELSE {_MULTIPLIER} END AS structure_multiplier FROM k1
), k3 AS (SELECT *, CAST(round_even(benchmark_raw_yen * structure_multiplier, 0) AS BIGINT) AS benchmark_yen FROM k2
)"""
DELTAS = f"""k4 AS (
  SELECT *, CAST(CASE WHEN benchmark_yen > 0 AND mgmt_fee_yen > 0 AND matched_level NOT IN ({', '.join(f"'{x}'" for x in comparables.live_levels())}) THEN least(mgmt_fee_yen, greatest(0, least({spec.MGMT_FEE_CAP}, round_even(benchmark_yen * {_d(spec.MGMT_FEE_RATE)}, 0)))) ELSE 0 END AS BIGINT) AS benchmark_mgmt_fee_yen FROM k3
), k5 AS (SELECT *, benchmark_yen + benchmark_mgmt_fee_yen AS benchmark_total_yen FROM k4
), k AS (
  SELECT *, CASE WHEN benchmark_total_yen > 0 THEN (monthly_fixed_cost_yen - benchmark_total_yen) / benchmark_total_yen ELSE 0e0 END AS rent_delta_ratio,
    CASE WHEN benchmark_yen > 0 THEN (rent_yen - benchmark_yen) / benchmark_yen END AS rent_only_delta_ratio FROM k5
)"""


def _feature(f: dict[str, Any], golden: bool = False) -> str:
    """A feature's score; golden runs have an access score, and defaults for what is missing."""
    p, x = f["params"], f["input"]
    if f["method"] == "bucket":
        score = "CASE " + " ".join(f"WHEN {x} {'<=' if 'max' in b else '>='} {_d(b.get('max', b.get('min')))} THEN {_d(b['score'])}" for b in p["buckets"]) + f" ELSE {_d(p['default'])} END"
    elif f["method"] == "lookup":
        score = _CASE(p["table"], x, _d(p["default"]))
    elif f["method"] == "boolean":
        score = f"CASE WHEN {x} THEN {_d(p['true'])} ELSE {_d(p['false'])} END"
    elif x == "area_access_score_0_100" and not golden:
        score = "NULL"
    else:
        (x0, x1), (y0, y1) = p["x"], p["y"]
        score = f"greatest(0e0, least(1e0, ({x} - {_d(x0)}) / {_d(x1 - x0)})) * {_d(y1 - y0)} + {_d(y0)}"
    score = score if score == "NULL" else f"CASE WHEN {x} IS NOT NULL THEN {score} {f'ELSE {_d(p.get("default", 70))} ' if golden else ''}END"
    return f"CASE WHEN benchmark_confidence IN ('none', 'low') THEN {_d(p['neutral_score'])} ELSE {score} END" if "neutral_if" in p else score


def _component(name: str) -> str:
    parts = [(f"({_feature(f)})", f["weight"]) for f in spec.SCORING["features"] if f["component"] == name]
    total = sum(w for _, w in parts)
    had = " + ".join(f"CASE WHEN {s} IS NOT NULL THEN {_d(w)} ELSE 0e0 END" for s, w in parts)
    return f"round_even(CASE WHEN {had} > 0 THEN ({' + '.join(f'coalesce({s} * {_d(w)}, 0e0)' for s, w in parts)}) * {_d(total)} / ({had}) ELSE 70e0 END + 1e-9, 6)"


def _grade(score: str) -> str:
    return "CASE " + " ".join(f"WHEN {score} >= {least} THEN '{g}'" for g, least in spec.SCORING["bands"]) + " ELSE 'D' END"


_W = spec.SCORING["weights"]
_OVERALL = "round_even(" + " + ".join(f"{c}_score * {_d(_W[c])}" for c in ("location", "condition", "cost")) + " + 1e-9, 6)"
_PARTS = ("location", "condition", "cost")
SCORED = f"""z1 AS (SELECT *, {', '.join(f'{_component(c)} AS {c}_score' for c in _PARTS)} FROM k
), z2 AS (SELECT *, {_OVERALL} AS overall_score FROM z1
), z AS (SELECT *, {', '.join(f"{_grade(f'{c}_score')} AS {c}_grade" for c in (*_PARTS, 'overall'))} FROM z2
)"""
_FULL = f"WITH {_base('market', 'subjects')},\n{MEASURED},\n{INDEX},\n{MATCHED},\n{DELTAS},\n{SCORED}\n"


def _rule(rule: Any) -> str:
    """Rules of the built-in content, which compare columns with literals."""
    if isinstance(rule, dict):
        (op, args), *_ = rule.items()
        if op == "var":
            return args
        if op == "and":
            return "(" + " AND ".join(map(_rule, args)) + ")"
        if op == "in":
            return f"coalesce({_rule(args[0])} IN ({', '.join(map(_rule, args[1]))}), false)"
        if args[1] is None:
            return f"{_rule(args[0])} IS {'NOT ' if op == '!=' else ''}NULL"
        return f"coalesce({_rule(args[0])} {'=' if op == '==' else op} {_rule(args[1])}, false)"
    return f"'{rule}'" if isinstance(rule, str) else str(rule).lower()


_FLAGS = [(r[3], r[4], _rule(r[2])) for r in sorted(spec.RISK_RULES, key=lambda r: r[1])]
_TRADEOFF = "CASE " + " ".join(f"WHEN {_rule(r[2])} THEN '{r[3]}'" for r in sorted(spec.TRADEOFF_RULES, key=lambda r: r[1])) + " END"
_TEMPLATE = "CASE " + " ".join(f"WHEN {_rule(t[2])} THEN '{t[0]}'" for t in sorted(spec.TEMPLATES, key=lambda t: -t[1])) + " END"
_DOUBLES = {"initial_multiple", "rent_delta_ratio", "area_sqm", "location_score", "condition_score", "cost_score", "overall_score"}


def _text(template: str) -> str:
    parts = []
    for i, piece in enumerate(template.replace("}", "{").split("{")):
        if i % 2 == 0:
            parts.append("'" + piece.replace("'", "''") + "'")
        elif piece in _DOUBLES:
            parts.append(f"coalesce(rtrim(rtrim(CASE WHEN abs({piece}) < 2 THEN printf('%.4f', {piece} + 1e-9) ELSE printf('%.2f', {piece} + 1e-9) END, '0'), '.'), 'null')")
        else:
            parts.append(f"coalesce(CAST({piece} AS VARCHAR), 'null')")
    return " || ".join(parts)


_SUMMARY = "CASE template_id " + " ".join(f"WHEN '{t[0]}' THEN {_text(t[3])}" for t in spec.TEMPLATES) + " END"


def _bucket(x: str, limits: tuple[int, ...], step: int) -> str:
    return "CASE " + " ".join(f"WHEN {x} <= {b} THEN {limits[min(i + step, len(limits) - 1)]}" for i, b in enumerate(limits)) + " END"


def _station(name: str, dialect: str) -> str:
    return f"replace(regexp_replace({name}, '[\\s\\x{{3000}}\\x{{A0}}]+', '', 'g'), '駅', '')" if dialect == "cassette" else name


def _tests(dialect: str, step: int) -> dict[str, str]:
    """The conditions of a step; ``s`` is the subject, ``c`` the offer."""
    lim = lambda limit, test: f"(({limit}) IS NULL OR coalesce({test}, false))"
    age = _bucket("s.building_age_years", comparables.AGE_BUCKETS, step) if dialect == "cassette" else f"greatest(5, ceil(s.building_age_years / 5) * 5) + {5 * step}"
    walk = _bucket("s.station_walk_min", comparables.WALK_BUCKETS, step) if dialect == "cassette" else f"{_bucket('s.station_walk_min', comparables.LINES_WALK_BUCKETS, 0)} + {5 * step}"
    kind = "CASE WHEN s.building_structure IN ('rc', 'src', 'steel') THEN 'mansion' WHEN s.building_structure IN ('wood', 'light_steel') THEN 'apartment' END"
    tests = {
        "area": f"coalesce(c.area_sqm BETWEEN greatest(0, floor(s.area_sqm / 5) * 5 - {5 * step}) AND floor(s.area_sqm / 5) * 5 + 5 + {5 * step}, false)",
        "age": lim(age, f"c.building_age_years <= {age}"),
        "walk": "coalesce(c.walk_min BETWEEN s.station_walk_min - 3 AND s.station_walk_min + 3, false)" if dialect == "block" else lim(walk, f"c.walk_min <= {walk}"),
        "station": "coalesce(contains({c}, {s}) OR contains({s}, {c}), false)".format(c=_station("c.station_name", dialect), s=_station("s.nearest_station_name", dialect)),
        "building_type": f"({kind} IS NULL OR c.building_type IS NULL OR c.building_type = {kind})",
        "orientation": "(s.orientation = 'UNKNOWN' OR coalesce(c.orientation = s.orientation, false))",
        "structure": "(s.building_structure IN ('other', 'all') OR coalesce(c.building_structure = s.building_structure, false))",
        "bath": "coalesce(c.bathroom_toilet_separate = s.bathroom_toilet_separate, false)",
    }
    return {k: tests[k] for k, last in comparables.LADDERS[dialect].items() if step <= last}


def _ladder(dialect: str, step: int) -> str:
    return " AND ".join(_tests(dialect, step).values()) or "true"


_VALUES = {"orientation": "orientation", "structure": "building_structure", "bath": "bathroom_toilet_separate"}
_READ = {"orientation": "CASE WHEN pos % 2 = 0 THEN 'N' END", "structure": "CASE WHEN pos % 5 > 0 THEN 'rc' ELSE 'wood' END", "bath": "pos % 4 < 2"}


def _tried(dialect: str, skip: tuple[str, ...] = (), details: bool = False) -> str:
    """Every subject with every offer of its place at every step (``tri``), and the steps that it takes (``tried``), by brute force."""
    selects = []
    for k in range(comparables.STEPS):
        tests = {name: t for name, t in _tests(dialect, k).items() if name not in skip}
        asks = {"orientation": "s.orientation <> 'UNKNOWN'", "structure": "s.building_structure NOT IN ('other', 'all')", "bath": "s.bathroom_toilet_separate IS NOT NULL"}
        untold = {v: f"({asks[v]} AND c.{c} IS NULL)" if v in tests else "false" for v, c in _VALUES.items()}
        failed = " ".join(f"WHEN NOT ({t}) AND NOT {untold.get(name, 'false')} THEN '{name}'" for name, t in tests.items())
        selects.append(f"SELECT s.listing_id, {k} AS step, s.orientation AS want_orientation, s.building_structure AS want_structure, s.bathroom_toilet_separate AS want_bath, c.rent_yen, c.admin_fee_yen, c.area_sqm, c.page, c.pos, CASE {failed} END AS reason, {', '.join(f'{t} AS untold_{v}' for v, t in untold.items())} FROM m s JOIN offers c ON s.prefecture = c.prefecture AND s.municipality = c.municipality AND s.layout_type = c.layout_type")
    lacks = " + ".join(f"CAST(untold_{v} AS INTEGER)" for v in _VALUES)
    fits = " AND ".join(f"(NOT untold_{v} OR (pos % 3 > 0 AND coalesce(({read}) = want_{v}, false)))" for v, read in _READ.items())
    order = "missing, page, pos, rent_yen, admin_fee_yen, area_sqm"
    read = f"""(SELECT listing_id, step, rent_yen, admin_fee_yen, area_sqm, row_number() OVER (PARTITION BY listing_id, step ORDER BY {order}) AS rank, fits FROM (
    SELECT *, {fits} AS fits FROM few JOIN (SELECT *, {lacks} AS missing FROM tri WHERE reason IS NULL AND {lacks} > 0) USING (listing_id, step)
    QUALIFY row_number() OVER (PARTITION BY listing_id, step, pos ORDER BY {order}) = 1) QUALIFY rank <= {comparables.quota_of(2)})""" if details else "(SELECT * FROM complete WHERE false)"
    return f"""tri AS ({' UNION ALL '.join(selects)}
), complete AS (SELECT listing_id, step, rent_yen, admin_fee_yen, area_sqm, 0 AS rank, true AS fits FROM tri WHERE reason IS NULL AND {lacks} = 0 GROUP BY ALL
), few AS (SELECT listing_id, step FROM m, (SELECT unnest(range({comparables.STEPS})) AS step) EXCEPT SELECT listing_id, step FROM complete GROUP BY listing_id, step HAVING count(*) >= 2
), looked AS (SELECT *, fits AND row_number() OVER (PARTITION BY listing_id, step, rent_yen, admin_fee_yen, area_sqm, fits ORDER BY rank) = 1 AS new FROM (SELECT * FROM complete UNION ALL SELECT * FROM {read})
), used AS (SELECT * FROM (SELECT *, coalesce(sum(CAST(new AS INTEGER)) OVER (PARTITION BY listing_id, step ORDER BY rank RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM looked) WHERE rank = 0 OR before < 2
), told AS (SELECT listing_id, step, count(*) FILTER (new) AS n, count(*) FILTER (rank > 0) AS detail_n, count(*) FILTER (rank > 0 AND fits) AS detail_matched_n FROM used GROUP BY ALL
), every AS (SELECT listing_id, step, coalesce(n, 0) AS n, coalesce(detail_n, 0) AS detail_n, coalesce(detail_matched_n, 0) AS detail_matched_n FROM m CROSS JOIN (SELECT unnest(range({comparables.STEPS})) AS step) LEFT JOIN told USING (listing_id, step)
), tried AS (SELECT * FROM every QUALIFY step <= coalesce(min(step) FILTER (n >= 2) OVER (PARTITION BY listing_id), {comparables.STEPS}))"""


_REASONS = ("area", "age", "walk", "station", "building_type", *_VALUES)


def _rejects(dialect: str) -> str:
    counted = " UNION ALL ".join([
        "SELECT step, reason, 1 AS n FROM seen WHERE reason IS NOT NULL", *(f"SELECT step, 'untold_{v}', 1 FROM seen WHERE reason IS NULL AND untold_{v}" for v in _VALUES),
        f"SELECT step, CASE WHEN {' OR '.join(f'untold_{v}' for v in _VALUES)} THEN 'untold' ELSE 'complete' END, 1 FROM seen WHERE reason IS NULL",
    ])
    return f"{_LIVE_BASE}, {_tried(dialect)}, seen AS (SELECT tri.* FROM tri JOIN tried USING (listing_id, step)) SELECT step, reason, count(*) AS n FROM ({counted}) GROUP BY ALL"


def _attempt_log() -> str:
    listed = lambda names: f"coalesce(array_to_string(list_filter([{', '.join(f"CASE WHEN {n} > 0 THEN '{n}:' || {n} END" for n in names)}], lambda x: x IS NOT NULL), ','), '')"
    untold = [f"untold_{v}" for v in _VALUES]
    counts = ", ".join([*(f"count(*) FILTER (reason = '{r}') AS {r}" for r in _REASONS), *(f"count(*) FILTER (reason IS NULL AND {u}) AS {u}" for u in untold)])
    fields = ("area_sqm", "walk_min", "building_age_years", "building_structure", "bathroom_toilet_separate", "station_name", "building_type")
    return f"""{_LIVE_BASE}, {_tried('cassette', ('station',), True)}, c AS (SELECT listing_id, step, count(*) AS fetched_n, count(*) FILTER (reason IS NULL AND NOT ({' OR '.join(untold)})) AS complete_n, {counts} FROM tri GROUP BY ALL
), p AS (SELECT prefecture, municipality, layout_type, {" || ',' || ".join(f'count({f})' for f in fields)} AS coverage FROM offers GROUP BY ALL)
SELECT listing_id, step, coalesce(fetched_n, 0) AS fetched_n, coalesce(complete_n, 0) AS complete_n, detail_n, detail_matched_n, n, {listed(_REASONS)} AS rejects, {listed(untold)} AS untold, coalesce(coverage, '{','.join('0' for _ in fields)}') AS coverage
FROM tried JOIN (SELECT listing_id, prefecture, municipality, layout_type FROM m) USING (listing_id) LEFT JOIN c USING (listing_id, step) LEFT JOIN p USING (prefecture, municipality, layout_type)"""


def _detailed() -> str:
    return f"""{_LIVE_BASE}, {_tried('cassette', ('station',), True)}, chosen AS (SELECT listing_id, max(step) AS chosen_step FROM tried WHERE n > 0 GROUP BY listing_id
), f AS (SELECT listing_id, chosen_step, count(*) AS n, {_robust('(rent_yen + admin_fee_yen)')} AS benchmark_yen, {_robust('rent_yen')} AS benchmark_rent_yen FROM used JOIN chosen USING (listing_id) WHERE new AND step = chosen_step GROUP BY ALL)
SELECT listing_id, chosen_step, coalesce(n, 0) AS n, benchmark_yen, benchmark_rent_yen, CASE WHEN coalesce(n, 0) < 2 THEN 'none' WHEN chosen_step = 0 THEN CASE WHEN n >= 3 THEN 'high' ELSE 'mid' END WHEN chosen_step = 1 THEN CASE WHEN n >= 3 THEN 'mid' ELSE 'low' END ELSE 'low' END AS benchmark_confidence,
  CASE WHEN n IS NULL THEN 'none' WHEN chosen_step = 0 THEN 'live_cassette' ELSE 'relaxed_cassette' END AS matched_level FROM m LEFT JOIN f USING (listing_id)"""


def _robust(value: str) -> str:
    return f"""CAST(round_even(CASE WHEN count({value}) >= 3 AND min({value}) > 0 AND max({value}) / min({value}) > {_d(spec.OUTLIER_RATIO)} THEN median({value}) ELSE (min({value}) + max({value})) / 2 END, 0) AS BIGINT)"""


def _live(dialect: str, paged: bool = False) -> str:
    """The ladder of a dialect; ``paged``: of the offers that pass, those up to the page on which there are enough."""
    p = dialect[0]
    one = f"(SELECT listing_id, rent_yen, admin_fee_yen, area_sqm, min(step) AS step FROM {p}1 GROUP BY ALL)" if paged else f"{p}1"
    passing = f"""(SELECT * FROM (SELECT *, min(page) FILTER (nth = 2) OVER (PARTITION BY listing_id) AS stop FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY page) AS nth FROM (
    SELECT listing_id, rent_yen, admin_fee_yen, area_sqm, min(page) AS page FROM {p}1 JOIN {p}2 USING (listing_id) WHERE step <= chosen_step GROUP BY ALL))) WHERE stop IS NULL OR page <= stop) x JOIN {p}2 USING (listing_id)""" if paged else f"{p}1 JOIN {p}2 USING (listing_id) WHERE step <= chosen_step"
    cases = " ".join(f"WHEN {_ladder(dialect, k)} THEN {k}" for k in range(comparables.STEPS))
    return f"""{p}1 AS (
  SELECT s.listing_id, c.rent_yen, c.admin_fee_yen, c.area_sqm, {"c.page, " if paged else ""}min(CASE {cases} END) AS step
  FROM m s JOIN offers c ON s.prefecture = c.prefecture AND s.municipality = c.municipality AND s.layout_type = c.layout_type GROUP BY ALL HAVING step IS NOT NULL
), {p}2 AS (
  SELECT listing_id, CASE WHEN count(*) FILTER (step <= 0) >= 2 THEN 0 WHEN count(*) FILTER (step <= 1) >= 2 THEN 1 WHEN count(*) FILTER (step <= 2) >= 2 THEN 2 ELSE 3 END AS chosen_step FROM {one} GROUP BY listing_id
), {p}3 AS (
  SELECT listing_id, chosen_step, count(*) AS n, {_robust('(rent_yen + admin_fee_yen)')} AS benchmark_yen, {_robust('rent_yen')} AS benchmark_rent_yen
  FROM {passing} GROUP BY listing_id, chosen_step
), live_{dialect} AS (
  SELECT listing_id, chosen_step, coalesce(n, 0) AS n, benchmark_yen, benchmark_rent_yen,
    CASE WHEN coalesce(n, 0) < 2 THEN 'none' WHEN chosen_step = 0 THEN CASE WHEN n >= 3 THEN 'high' ELSE 'mid' END WHEN chosen_step = 1 THEN CASE WHEN n >= 3 THEN 'mid' ELSE 'low' END ELSE 'low' END AS benchmark_confidence,
    CASE WHEN n IS NULL THEN 'none' WHEN chosen_step = 0 THEN 'live_{dialect}' ELSE 'relaxed_{dialect}' END AS matched_level FROM m LEFT JOIN {p}3 USING (listing_id)
)"""


_LIVE_BASE = f"WITH {_base('market', 'subjects', 'offers')},\n{MEASURED}"
_LIVE_COLS = "listing_id, chosen_step, n, benchmark_yen, benchmark_rent_yen, benchmark_confidence, matched_level"
_FALLBACK = f"""u AS (
  {' UNION ALL '.join(f"SELECT {_LIVE_COLS}, {i} AS provider, '{d}:' || benchmark_confidence AS tried, benchmark_confidence <> 'none' AND benchmark_yen IS NOT NULL AS good FROM live_{d}" for i, d in enumerate(comparables.LADDERS))}
), pf AS (
  SELECT *, string_agg(tried, ',') OVER (PARTITION BY listing_id ORDER BY provider) AS attempts FROM u QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY CASE WHEN good THEN provider ELSE 100 - provider END) = 1
)"""
_COLLECTED = "r AS (SELECT prefecture, municipality, layout_type, building_structure, CAST(trunc(median(avg_rent_yen)) AS BIGINT) AS rent_yen, count(*) AS n_rows FROM market GROUP BY ALL)"
_GRID = f"""g AS (SELECT DISTINCT prefecture, municipality FROM market), w AS (
  SELECT prefecture, municipality, a.layout_type, b.building_structure FROM g, (SELECT unnest({spec.LAYOUTS}) AS layout_type) a, (SELECT unnest({spec.STRUCTURES[:5]}) AS building_structure) b
), have AS (SELECT * FROM r WHERE n_rows >= {spec.MIN_SAMPLES})"""
_RATIOS = "q AS (SELECT x.*, b.rent_yen AS rc_rent, x.rent_yen / b.rent_yen AS ratio FROM r x JOIN r b ON b.building_structure = 'rc' AND b.rent_yen > 0 AND b.prefecture = x.prefecture AND b.municipality = x.municipality AND b.layout_type = x.layout_type WHERE x.building_structure <> 'rc' AND x.rent_yen > 0)"
_MARKET = f"WITH {_base('market')}"


def _whatif() -> str:
    changes = {"WI_REDUCE_INITIAL_TOTAL_50K": ("true", "initial_cost_total_yen", "initial_cost_total_yen - 50000"), "WI_SET_REIKIN_ZERO": ("reikin_yen > 0", "reikin_yen", "0"), "WI_SCALE_BROKERAGE_HALF": ("brokerage_fee_yen > 0", "brokerage_fee_yen", "round_even(brokerage_fee_yen * 0.5e0, 0)")}
    rows = []
    for name, (when, target, new) in changes.items():
        new = f"CAST(greatest(0, {new}) AS BIGINT)"
        total = new if target == "initial_cost_total_yen" else f"greatest(0, initial_cost_total_yen + {new} - {target})"
        rows.append(f"SELECT * EXCLUDE (initial_multiple, cost_score, overall_score, initial_multiple_market_delta_foreigner), '{name}' AS whatif_id, {target} AS old_yen, {new} AS new_yen, {total} AS new_total_yen, overall_score AS old_overall_score FROM z WHERE {when}")
    return _FULL + f""", a AS ({' UNION ALL '.join(rows)}
), b AS (SELECT *, CASE WHEN monthly_fixed_cost_yen > 0 THEN new_total_yen / monthly_fixed_cost_yen ELSE 0e0 END AS initial_multiple FROM a
), c AS (SELECT *, greatest(0e0, initial_multiple - 1e0) - im_market_avg AS initial_multiple_market_delta_foreigner FROM b
), d AS (SELECT *, {_component('cost')} AS cost_score FROM c), e AS (SELECT *, {_OVERALL} AS overall_score FROM d)
SELECT listing_id, whatif_id, old_yen, new_yen, new_total_yen, round_even(initial_multiple, 6) AS initial_multiple, cost_score, overall_score, {_grade('overall_score')} AS new_grade, old_overall_score FROM e"""


def _errors() -> str:
    tests = []
    for key, _, required, *_ in spec.FIELDS:
        if required:
            tests.append(f"CASE WHEN {key} IS NULL THEN 'missing:{key}' END")
    tests.append("CASE WHEN hub_station = 'other' AND coalesce(trim(hub_station_other_name), '') = '' THEN 'missing:hub_station_other_name' END")
    have = {f[0] for f in spec.FIELDS} - {"line_name", "guarantor_fee_yen", "fire_insurance_yen", "key_change_yen", "cleaning_fee_yen", "renewal_fee_months"}
    for key, _, _, least, most, allowed, unit in (f for f in spec.FIELDS if f[0] in have):
        if allowed:
            tests.append(f"CASE WHEN {key} NOT IN ({', '.join(f"'{a}'" for a in allowed)}) THEN 'enum:{key}' END")
        if least is not None:
            tests.append(f"CASE WHEN {key} < {least} THEN 'min:{key}' END")
        if most is not None and unit != "yen":
            tests.append(f"CASE WHEN {key} > {most} THEN 'max:{key}' END")
    return f"WITH {_base('subjects')} SELECT listing_id, array_to_string(list_filter([{', '.join(tests)}], lambda x: x IS NOT NULL), ',') AS errors FROM subjects"


_BREAKDOWN = ("shikikin_yen", "reikin_yen", "brokerage_fee_yen", "other_initial_fees_yen")
_SANITY = f"""WITH {_base('subjects')},\n{MEASURED},
b AS (SELECT *, CASE WHEN {' OR '.join(f'{c} IS NOT NULL' for c in _BREAKDOWN)} THEN {' + '.join(f'coalesce({c}, 0)' for c in _BREAKDOWN)} END AS breakdown_sum_yen FROM m),
f AS (SELECT listing_id, breakdown_sum_yen, list_filter([CASE WHEN initial_multiple >= 10 THEN 'initial_multiple_ge_10' END, CASE WHEN rent_yen > 0 AND reikin_yen / rent_yen > 3 THEN 'reikin_months_gt_3' END,
  CASE WHEN rent_yen > 0 AND shikikin_yen / rent_yen > 3 THEN 'shikikin_months_gt_3' END, CASE WHEN rent_yen > 0 AND brokerage_fee_yen / rent_yen > 2 THEN 'brokerage_months_gt_2' END,
  CASE WHEN initial_cost_total_yen > 0 AND breakdown_sum_yen > initial_cost_total_yen * 1.2e0 THEN 'initial_breakdown_sum_gt_total_120pct' END], lambda x: x IS NOT NULL) AS flags FROM b)
SELECT listing_id, breakdown_sum_yen, array_to_string(flags, ',') AS sanity_flags, len(flags) > 0 AS suspect FROM f"""

def _golden() -> str:
    """Golden runs: stand-in rents and access scores, and rules of greatest priority."""
    cut = lambda x: f"CAST(trunc(coalesce({x}, 0)) AS BIGINT)"
    rent = f"{_CASE(regression.RENTS, 'prefecture', _d(regression.RENT_OTHER))} + CASE WHEN layout_type = '1K' THEN 5000 ELSE 0 END + {cut('(area_sqm - 20) * 900')} - {cut('(station_walk_min - 10) * 400')} - {cut('building_age_years * 120')}"
    access = f"greatest(0e0, least(100e0, {_CASE(regression.ACCESS, 'hub_station', _d(regression.ACCESS_OTHER))} - least(25e0, station_walk_min * 1.2e0)))"
    parts = {c: [(f"({_feature(f, True)})", f["weight"]) for f in spec.SCORING["features"] if f["component"] == c] for c in _PARTS}
    scores = ", ".join(f"round_even(({' + '.join(f'{s} * {_d(w)}' for s, w in p)}) / ({' + '.join(_d(w) for _, w in p)}) + 1e-9, 6) AS {c}_score" for c, p in parts.items())
    always = lambda rule: rule == spec.ALWAYS
    chosen = lambda rows: "CASE " + " ".join(f"WHEN {_rule(w)} THEN '{name}'" for name, _, w in sorted(rows, key=lambda r: (always(r[2]), -r[1]))) + " END"
    return f"""WITH {_base('subjects')},
{MEASURED}, g1 AS (SELECT *, CASE WHEN prefecture = 'tokyo' THEN 'mid' ELSE 'low' END AS benchmark_confidence, CAST(greatest({regression.LEAST_RENT}, {rent}) AS BIGINT) AS benchmark_total_yen, {access} AS area_access_score_0_100 FROM m
), g2 AS (SELECT *, (monthly_fixed_cost_yen - benchmark_total_yen) / benchmark_total_yen AS rent_delta_ratio FROM g1), g3 AS (SELECT *, {scores} FROM g2), g4 AS (SELECT *, {_OVERALL} AS overall_score FROM g3)
SELECT listing_id, benchmark_total_yen, location_score, condition_score, cost_score, overall_score, {_grade('overall_score')} AS overall_grade, {chosen([(r[3], r[1], r[2]) for r in spec.TRADEOFF_RULES])} AS tradeoff_tag, {chosen([(t[0], t[1], t[2]) for t in spec.TEMPLATES])} AS template_id FROM g4"""


def _page_lines(html: str) -> str:
    bare = f"regexp_replace({html}, '<script\\b.*?</script>', ' ', 'gis')"
    for tag in ("style", "noscript"):
        bare = f"regexp_replace({bare}, '<{tag}\\b.*?</{tag}>', ' ', 'gis')"
    bare = f"regexp_replace(regexp_replace({bare}, '<!--.*?-->', ' ', 'gs'), '<(?:/?(?:tr|li|p|div|section|article|header|footer|table|tbody|thead|ul|ol|dl|dt|dd|h1|h2|h3|h4|h5|h6)|br)\\b[^>]*>', chr(10), 'gi')"
    line = "regexp_replace(x, '<[^>]+>', ' ', 'g')"
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&sup2;", "²"), ("&amp;", "&")):
        line = f"replace({line}, '{entity}', '{plain}')"
    return f"list_filter(list_transform(string_split({bare}, chr(10)), lambda x: trim(regexp_replace({line}, '[\\s\\x{{3000}}\\x{{A0}}]+', ' ', 'g'))), lambda x: x <> '')"


def _documents() -> dict[str, str]:
    """What pages and notes written from listings must say, from the listings themselves."""
    known = lambda c, none: f"CASE {c} WHEN '{none}' THEN NULL ELSE {c} END AS {c}"
    told = f"""WITH {_base('subjects')}, t AS (SELECT listing_id, rent_yen, CAST(round(rent_yen / 1000e0) * 1000 AS BIGINT) AS man, mgmt_fee_yen AS fee, layout_type, area_sqm, station_walk_min AS walk, listing_id % 45 AS age, 1 + listing_id % 8 AS floor_no,
  {known('orientation', 'UNKNOWN')}, {known('building_structure', 'other')}, 'S' || regexp_extract(nearest_station_name, '[0-9]+') AS st, bathroom_toilet_separate AS bath, building_built_year AS built, prefecture, municipality AS muni FROM subjects)"""
    room = lambda n, rent, fee, layout, area, walk, floor, facing, more: f"SELECT listing_id, {n} AS room, {rent} AS rent_yen, {fee} AS admin_fee_yen, {rent} + {fee} AS monthly_total_yen, {layout} AS layout_type, {area} AS area_sqm, {walk} AS walk_min, age AS building_age_years, {floor} AS floor, {facing} AS orientation, building_structure, {more} FROM t"
    kind = "CASE listing_id % 3 WHEN 0 THEN 'mansion' WHEN 1 THEN 'apartment' ELSE 'house' END AS building_type"
    cassette = room(0, "rent_yen", "fee", "layout_type", "area_sqm", "walk + 2", "floor_no", "orientation", f"{kind}, '/room/' || listing_id || '/1' AS detail_url, st AS station_names") + " UNION ALL " + room(1, "man", "0", "''", "area_sqm + 1", "walk", "NULL", "NULL", f"{kind}, 'https://other.example/room/' || listing_id || '/2' AS detail_url, st AS station_names")
    own_fee, both = "CASE WHEN fee <= 50000 THEN fee ELSE 0 END", "bath AS bathroom_toilet_separate, st || ',新' || st AS station_names"
    block = room(1, "man", own_fee, "layout_type", "area_sqm", "walk", "floor_no", "orientation", both) + " UNION ALL " + room(2, "man", "0", "layout_type", "area_sqm + 1", "walk", "9", "NULL", both)
    places = {"saitama": "熊谷市", "tokyo": "昭島市", "chiba": "銚子市", "kanagawa": "秦野市", "osaka": "枚方市"}
    town = "CASE prefecture " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in places.items()) + " END"
    form = {"prefecture": "prefecture", "municipality": town, "nearest_station_name": "st", "station_walk_min": "walk", "rent_yen": "CASE WHEN listing_id % 2 = 0 THEN rent_yen ELSE man END", "mgmt_fee_yen": "fee", "orientation": "orientation", "area_sqm": "area_sqm", "layout_type": "layout_type", "building_structure": "building_structure", "building_age_years": f"{AS_OF_YEAR} - built", "building_built_year": "built", "bathroom_toilet_separate": "bath"}
    read = ", ".join(f"CASE WHEN listing_id % 7 <> 0 THEN {v} END AS {k}" for k, v in form.items())
    reason, strong, plan = "'reason ' || listing_id || chr(10) || chr(10) || '### Detail' || chr(10) || 'more of ' || layout_type", "'near ' || st", "'plan ' || listing_id"
    section = lambda pos, level, title, body, where="true": f"SELECT listing_id AS doc, {pos} AS pos, {level} AS level, '{title}' AS title, {body} AS body FROM t WHERE {where}"
    even = "listing_id % 2 = 0"
    parts = [section(0, 2, "Reasons to move", reason), section(1, 3, "Detail", "'more of ' || layout_type"), section(2, 2, "Strengths", strong, even), section(3, 2, "More strengths", "'floor ' || floor_no", even), section(f"2 + CASE WHEN {even} THEN 2 ELSE 0 END", 2, "The plan", plan, "listing_id % 3 = 0")]
    nl = "chr(10) || chr(10)"
    n = f"""{told}, n AS (SELECT listing_id AS doc, '## Q1. reason' || {nl} || {reason} || {nl} || '## Q2. strong' || {nl} || CASE WHEN {even} THEN '### Strengths' || {nl} || {strong} || {nl} || '### More strengths' || {nl} || 'floor ' || floor_no ELSE '> TODO' END
  || {nl} || '## Q3. plan' || {nl} || CASE WHEN listing_id % 3 = 0 THEN {plan} ELSE '> TODO' END || chr(10) AS normalised, list_filter([CASE WHEN NOT {even} THEN 'strong' END, CASE WHEN listing_id % 3 <> 0 THEN 'plan' END], lambda x: x IS NOT NULL) AS gone FROM t)"""
    names = {"saitama": "埼玉県", "tokyo": "東京都", "chiba": "千葉県", "kanagawa": "神奈川県", "osaka": "大阪府"}
    address = "'〒000 ' || CASE prefecture " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" END || {town} || '本町3-1'"
    return {
        "parsed_places": f"""{told} SELECT listing_id, prefecture, {town} AS municipality, st || ':' || CASE WHEN true THEN walk END AS near, walk AS least_walk, '難波' AS station, true AS similar, lpad(CAST(listing_id % 100000 AS VARCHAR), 5, '0') AS code, area_sqm AS hidden_area,
  prefecture AS asked_prefecture, CASE WHEN round(rent_yen / 10000e0) > 0 THEN round(rent_yen / 10000e0) END AS asked_rent, area_sqm AS asked_area, CASE WHEN walk > 0 THEN walk END AS asked_walk, CASE WHEN listing_id % 2 = 1 AND age > 0 THEN age END AS asked_age, {address} AS decoded FROM t""",
        "cassette_rooms": f"{told} {cassette}",
        "collected_rents": f"{told}, rooms AS ({cassette}) SELECT building_structure, layout_type, count(*) AS n, CAST(sum(rent_yen) AS BIGINT) AS rents FROM rooms WHERE building_structure IS NOT NULL GROUP BY ALL",
        "block_rooms": f"{told} {block}",
        "collected_market_rows": f"""{told}, rooms AS (SELECT prefecture, muni, layout_type, building_structure, unnest([rent_yen, man]) AS rent FROM t WHERE building_structure IS NOT NULL)
SELECT 'JP' AS region_country, prefecture, muni AS municipality, layout_type, building_structure, CAST(trunc(median(rent)) AS BIGINT) AS avg_rent_yen, 'pages' AS source_name, CAST(NULL AS VARCHAR) AS source_url, '2001-01-01' AS source_updated_at, '2001-01-01' AS collected_at, 'median of ' || count(*) || ' rooms' AS method_notes FROM rooms GROUP BY ALL HAVING count(*) >= 3""",
        "gaps_after_collection": f"""{told}, have AS (SELECT prefecture, muni AS municipality, layout_type, building_structure FROM t WHERE building_structure IS NOT NULL AND layout_type <> '1R' GROUP BY ALL HAVING 2 * count(*) >= 3),
  w AS (SELECT * FROM (SELECT DISTINCT prefecture, municipality FROM have) p, (SELECT unnest({spec.LAYOUTS}) AS layout_type) a, (SELECT unnest({spec.STRUCTURES[:5]}) AS building_structure) b)
SELECT w.* FROM w ANTI JOIN have USING (prefecture, municipality, layout_type, building_structure)""",
        "line_rooms": f"{told} SELECT * EXCLUDE (room) FROM ({room(0, 'man', 'fee', 'layout_type', 'area_sqm', 'walk', 'NULL', 'orientation', 'bath AS bathroom_toilet_separate, st AS station_names')})",
        "detail_listing": f"{told} SELECT listing_id, {read}, CASE WHEN listing_id % 7 = 0 THEN 'challenge page' END AS error FROM t",
        "detail_fields": f"{told} SELECT listing_id, orientation, bath AS bathroom_toilet_separate, building_structure FROM t WHERE listing_id % 7 <> 0",
        "note_sections": f"{told} {' UNION ALL '.join(parts)}",
        "rebuilt_notes": f"{n} SELECT doc, normalised, array_to_string(gone, ',') AS missing FROM n",
        "missing_answers": f"{n} SELECT key, count(*) AS n FROM (SELECT unnest(gone) AS key FROM n) GROUP BY key",
        "worst_notes": f"{n} SELECT doc, len(gone) AS n_missing FROM n ORDER BY n_missing DESC, doc LIMIT 15",
    }


def _checks() -> dict[str, str]:
    """What is wrong with payloads and bundles, from how they were made."""
    no = "listing_id % 13 <> 0 AND"
    tests = [
        (f"{no} prefecture = 'tokyo' AND area_sqm < 20", "minimum:$.area_sqm"), ("listing_id % 9 = 0", "required:$.building_structure"), ("length(prefecture) < 6", "minLength:$.prefecture"), ("layout_type NOT IN ('1R', '1K')", "enum:$.layout_type"),
        (f"{no} area_sqm < 15", "minimum:$.area_sqm"), (f"{no} area_sqm > 40", "maximum:$.area_sqm"), ("listing_id % 12 = 0", "type:$.rent_yen"), ("listing_id % 4 = 0", "minItems:$.stations"), ("listing_id % 4 = 3", "maxItems:$.stations"),
        ("listing_id % 9 <> 0 AND NOT regexp_matches(building_structure, '^[a-z]+$')", "pattern:$.building_structure"), ("listing_id % 10 = 0", "additional:$.extra"),
    ]
    listed = ", ".join(f"CASE WHEN {when} THEN '{said}' END" for when, said in tests)
    faults = [
        (5, "error", "V0_KEY", "S1.fields[2]", "qa_notes"), (5, "error", "QA_NOTES", "S1.fields[2]", "qa_notes"), (4, "error", "V0_KEY", "S1.mvp_required_fields[1]", "ghost"), (3, "error", "INPUT_KEY_UNKNOWN", "S2.features[0]", "unknown"),
        (6, "error", "JSONLOGIC_VAR", "S2.risk_flag_rules[0]", "nobody"), (7, "error", "SEVERITY", "S2.risk_flag_rules[0]", "huge"), (8, "error", "WHEN_NOT_OBJECT", "S2.what_if_rules[0]", "enabled_if"), (9, "error", "GRADE_ENUM", "S2.grade_thresholds.overall[1]", "Z"),
        (10, "error", "PLACEHOLDER_V0", "C1.placeholders[1]", "odd"), (10, "error", "PLACEHOLDER_UNDECLARED", "C1.rules[0]", "area"), (11, "warn", "JSONLOGIC_VAR", "C1.rules[0]", "runtime"), (12, "error", "ENUM", "D1.fallback_policy[0]", "sure"),
    ]
    found = " UNION ALL ".join(f"SELECT CAST(s_suppkey AS VARCHAR) AS bundle, '{severity}' AS severity, '{code}' AS code, '{place}' AS place, '{name}' AS name FROM supplier WHERE s_suppkey % {n} = 0" for n, severity, code, place, name in faults)
    return {
        "schema_checks": f"WITH {_base('subjects')} SELECT listing_id, CASE WHEN listing_id % 50 = 49 THEN 'unreadable:$' ELSE array_to_string(list_filter([{listed}], lambda x: x IS NOT NULL), ',') END AS findings FROM subjects",
        "bundle_findings": found,
        "bundle_reports": f"SELECT bundle, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warn') AS warnings, arg_min(code, severity || ' ' || code || ' ' || place) AS first_code FROM ({found}) GROUP BY bundle",
    }


def _list_urls() -> str:
    limits = lambda x, book: "CASE " + " ".join(f"WHEN {x} <= {limit} THEN '{code}'" for limit, code in book) + " END"
    read = lambda x, book: "CASE " + " ".join(f"WHEN {x} <= {limit} THEN {limit}e0" for limit, _ in book) + " END"
    walk = [(1, "1"), (3, "2"), (5, "3"), (7, "4"), (10, "5"), (15, "6"), (20, "7")]
    age = [(0, "0"), (1, "1"), (3, "2"), (5, "3"), (7, "3.5"), (10, "4"), (15, "5"), (20, "6"), (25, "7"), (30, "8")]
    kind = "CASE WHEN building_structure IN ('rc', 'src') THEN '1' WHEN building_structure IN ('steel', 'light_steel') THEN '2' WHEN building_structure = 'wood' THEN '3' END"
    param = lambda name, value: f"coalesce('&{name}=' || {value}, '')"
    low, high = "CAST(floor(area_sqm / 5) * 5 AS BIGINT)", "CAST(ceil(area_sqm / 5) * 5 AS BIGINT)"
    return f"""{_MARKET}, s AS ({adapters.sql('subjects')}), k AS (
  SELECT prefecture, municipality, layout_type, arg_min(code, lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || code) AS code FROM (SELECT *, lpad(CAST(l_suppkey % 7 AS VARCHAR), 5, '1310') AS code FROM market WHERE l_linenumber > 2 AND layout_type <> '1LDK') GROUP BY ALL
), p AS (SELECT prefecture, municipality, layout_type, arg_min(code, rank) AS code FROM (SELECT DISTINCT prefecture, municipality, layout_type FROM s) a JOIN (SELECT prefecture, municipality, layout_type AS known, code FROM k) USING (prefecture, municipality),
    LATERAL (SELECT CASE WHEN known = layout_type THEN 0 ELSE list_position(['1R', '1K', '1DK', '1LDK'], known) END AS rank) GROUP BY ALL
), o AS (SELECT listing_id, code, layout_type, area_sqm, listing_id % 3 + 1 AS page, bathroom_toilet_separate AS bath, {limits('station_walk_min', walk)} AS j, {limits('listing_id % 45', age)} AS h, {kind} AS kz, {read('station_walk_min', walk)} AS w, {read('listing_id % 45', age)} AS g, prefecture
  FROM s LEFT JOIN p USING (prefecture, municipality, layout_type) WHERE listing_id % 5 > 0)
SELECT listing_id, 'https://rooms.example/' || prefecture || '/area/' || code || '/list' || CASE WHEN bath THEN '/bath-toilet' ELSE '' END || CASE WHEN page > 1 THEN '/page' || page ELSE '' END || '/?m=' || list_position(['1R', '1K', '1DK', '1LDK'], layout_type) - 1 || '&rt=50&k=1&sf=' || {low} || '&st=' || {high} || {param('j', 'j')} || {param('h', 'h')} || {param('kz', 'kz')} AS url,
  code AS area_code, CASE WHEN code IS NOT NULL THEN layout_type END AS layout_type, CASE WHEN code IS NOT NULL THEN {low} * 1e0 END AS area_low, CASE WHEN code IS NOT NULL THEN {high} * 1e0 END AS area_high, CASE WHEN code IS NOT NULL THEN w END AS walk_max, CASE WHEN code IS NOT NULL THEN g END AS age_max,
  CASE WHEN code IS NOT NULL THEN CASE kz WHEN '1' THEN 'rc' WHEN '2' THEN 'steel' WHEN '3' THEN 'wood' END END AS structure, CASE WHEN code IS NOT NULL THEN bath END AS bath, CASE WHEN code IS NOT NULL THEN page ELSE 1 END AS page FROM o"""


def _more() -> dict[str, str]:
    """Visibility, sketches, encodings, archives and summaries."""
    listed = lambda *pairs: f"array_to_string(list_filter([{', '.join(f"CASE WHEN {when} THEN '{name}' END" for name, when in pairs)}], lambda x: x IS NOT NULL), ',')"
    other, elsewhere, term, layout = "hub_station = 'other'", "coalesce(hub_station_other_name = 'Elsewhere', false)", "contract_term_months IS NOT NULL", "layout_type <> '1R'"
    chained_term = f"({other} AND {elsewhere})"
    chained_penalty = f"({chained_term} AND {term})"
    raw = {"hub_station_other_name": other, "contract_term_months": elsewhere, "early_termination_penalty_yen": term, "reikin_yen": layout}
    places = {"saitama": ("埼玉県", "熊谷市"), "tokyo": ("東京都", "昭島市"), "chiba": ("千葉県", "銚子市"), "kanagawa": ("神奈川県", "秦野市"), "osaka": ("大阪府", "枚方市")}
    codes = ("utf-8", "cp932", "shift_jis", "euc_jp")
    text = {k: f"〒000 {a}{b}本町3-1" for k, (a, b) in places.items()}
    data = "CASE " + " ".join(f"WHEN prefecture = '{k}' AND listing_id % 4 = {i} THEN '{t.encode(c).hex().upper()}'" for k, t in text.items() for i, c in enumerate(codes)) + " END"
    levels = {"station": (["prefecture", "municipality", "station_name", "layout_type"], 30), "municipality": (["prefecture", "municipality", "layout_type"], 30), "prefecture": (["prefecture", "layout_type"], 200)}
    sums = " UNION ALL ".join(f"SELECT '{level}' AS level, {', '.join(k if k in keys else f'CAST(NULL AS VARCHAR) AS {k}' for k in levels['station'][0])}, count(*) AS n_rows, round_even(avg(greatest(0e0, 100 - walk_min * 3e0)), 6) AS mean_score, true AS within FROM offers GROUP BY ALL HAVING count(*) >= {least}" for level, (keys, least) in levels.items())
    went = "SELECT 'corp/' || s_suppkey AS folder, name, s_suppkey % 4 AS k FROM supplier, (SELECT unnest(['analysis.md', 'answers.md']) AS name) WHERE s_suppkey % 3 > 0"
    lines = ["'# Data collection summary'", "''", "'**Date:** 2001-01-01'", "'**Rows:** ' || n", "'**Missing combinations:** ' || gone", "''", "'## Rows by structure'", *(f"'- **{s}:** ' || n_{s}" for s in spec.STRUCTURES[:5])]
    return {
        "visible_fields": f"""WITH {_base('subjects')} SELECT listing_id, {listed(('hub_station', 'true'), *raw.items())} AS visible, {listed(('hub_station', 'true'), ('hub_station_other_name', other), ('contract_term_months', chained_term), ('early_termination_penalty_yen', chained_penalty), ('reikin_yen', layout))} AS chained,
  {listed(*((k, f"{when} AND coalesce(trim(CAST({k} AS VARCHAR)), '') = ''") for k, when in raw.items()))} AS missing, CASE WHEN {chained_term} THEN contract_term_months END AS contract_term_months, CASE WHEN {chained_penalty} THEN early_termination_penalty_yen END AS early_termination_penalty_yen, CASE WHEN {layout} THEN reikin_yen END AS reikin_yen FROM subjects""",
        "level_quartiles": f"WITH {_base('market', 'offers')} {sums}",
        "decoded_addresses": f"WITH {_base('subjects')} SELECT listing_id, {data} AS bytes, CASE prefecture {' '.join(f"WHEN '{k}' THEN '{t}'" for k, t in text.items())} END AS decoded FROM subjects",
        "detail_stages": f"""WITH {_base('subjects')}, p AS (SELECT listing_id % 7 = 0 AS barred, listing_id % 2 = 0 AS linked, orientation, building_structure, CASE prefecture {' '.join(f"WHEN '{k}' THEN '{a}{b}'" for k, (a, b) in places.items())} END AS place FROM subjects)
SELECT CASE WHEN barred THEN '' ELSE 'prefecture:label,municipality:label,nearest_station_name:text,station_walk_min:text,rent_yen:' || CASE WHEN linked THEN 'linked' ELSE 'beside' END || ',mgmt_fee_yen:label' || CASE WHEN orientation <> 'UNKNOWN' THEN ',orientation:beside' ELSE '' END
  || ',area_sqm:' || CASE WHEN linked THEN 'linked' ELSE 'label' END || ',layout_type:label' || CASE WHEN building_structure <> 'other' THEN ',building_structure:label' ELSE '' END || ',building_age_years:derived,building_built_year:label,bathroom_toilet_separate:text' END AS stages,
  CASE WHEN barred THEN 'challenge page' END AS error, CASE WHEN barred THEN substr(CASE WHEN linked THEN '{{"offers": {{"price":' ELSE '所在地 ' || place || '本町3 交通 みどり線' END, 1, 20) END AS snippet, count(*) AS n FROM p GROUP BY ALL""",
        "archive_moves": f"SELECT folder, name, '_archive/' || CASE WHEN name = 'analysis.md' AND k = 0 THEN 'analysis.2.md' WHEN name = 'answers.md' AND k = 1 THEN 'answers.1.md' ELSE name END AS target FROM ({went})",
        "collection_summary": f"{_MARKET}, {_COLLECTED}, {_GRID}, c AS (SELECT count(*) AS n, (SELECT count(*) FROM (SELECT w.* FROM w ANTI JOIN have USING (prefecture, municipality, layout_type, building_structure))) AS gone, {', '.join(f"count(*) FILTER (building_structure = '{s}') AS n_{s}" for s in spec.STRUCTURES[:5])} FROM market) SELECT unnest(range({len(lines)})) AS rank, unnest([{', '.join(lines)}]) AS value FROM c",
    }


def _bundled() -> str:
    """The two bundles of the pages module, written out by hand."""
    pick = lambda plain, strict: f"CASE bundle WHEN 'plain' THEN {plain} WHEN 'strict' THEN {strict} END"
    score = {
        "location": pick("CASE WHEN station_walk_min <= 10 THEN 90e0 WHEN station_walk_min <= 20 THEN 60e0 ELSE 30e0 END", "(1e0 - greatest(0e0, least(1e0, station_walk_min / 30e0))) * 100e0"),
        "condition": pick("(greatest(0e0, least(1e0, (area_sqm - 10e0) / 40e0)) * 80e0 + 20e0) * 0.5e0 + CASE WHEN bathroom_toilet_separate THEN 80e0 ELSE 40e0 END * 0.5e0", "CASE orientation WHEN 'S' THEN 100e0 WHEN 'N' THEN 10e0 ELSE 55e0 END"),
        "cost": pick("CASE WHEN benchmark_confidence = 'none' THEN 50e0 WHEN rent_delta_ratio <= 0 THEN 80e0 ELSE 20e0 END", "CASE WHEN monthly_fixed_cost_yen <= 20000 THEN 95e0 WHEN monthly_fixed_cost_yen >= 60000 THEN 5e0 ELSE 45e0 END"),
    }
    small, dear = "area_sqm < 20", "rent_yen > 40000"
    return f"""WITH {_base('market', 'subjects')},\n{MEASURED},\n{INDEX},\n{MATCHED},\n{DELTAS}, b0 AS (SELECT *, CASE listing_id % 3 WHEN 0 THEN 'plain' WHEN 1 THEN 'strict' ELSE 'nobody''s' END AS bundle FROM k
), b1 AS (SELECT *, {', '.join(f'round_even({v} + 1e-9, 6) AS {c}_score' for c, v in score.items())} FROM b0
), b2 AS (SELECT *, round_even({pick('location_score * 0.5e0 + condition_score * 0.3e0 + cost_score * 0.2e0', 'location_score * 0.2e0 + condition_score * 0.2e0 + cost_score * 0.6e0')} + 1e-9, 6) AS overall_score FROM b1
), b3 AS (SELECT *, {pick("CASE WHEN overall_score >= 70 THEN 'A' WHEN overall_score >= 50 THEN 'B' ELSE 'D' END", "CASE WHEN overall_score >= 90 THEN 'A' WHEN overall_score >= 30 THEN 'C' ELSE 'D' END")} AS overall_grade,
  {pick("CASE WHEN location_score >= 60 THEN 'A' ELSE 'D' END", "'D'")} AS location_grade, {pick("'D'", "'D'")} AS condition_grade, {pick("CASE WHEN cost_score >= 40 THEN 'B' ELSE 'D' END", "'D'")} AS cost_grade FROM b2)
SELECT listing_id, bundle, location_score, condition_score, cost_score, overall_score, location_grade, condition_grade, cost_grade, overall_grade,
  {pick("concat_ws(',', CASE WHEN station_walk_min > 20 THEN 'FAR:mid' END, CASE WHEN " + small + " THEN 'SMALL:low' END)", "CASE WHEN coalesce(contract_term_months >= 12, false) THEN 'LONG:high' ELSE '' END")} AS flags,
  {pick("CASE WHEN location_score >= 90 THEN 'near' ELSE 'even' END", 'NULL')} AS tradeoff_tag, {pick(f"CASE WHEN {small} THEN 'SMALL' ELSE 'ANY' END", f"CASE WHEN {dear} THEN 'DEAR' END")} AS template_id,
  {pick(f"CASE WHEN {small} THEN '작은 방 ' || layout_type ELSE '등급 ' || overall_grade END", 'NULL')} AS summary_ko, {pick(f"CASE WHEN NOT {small} THEN '評価 ' || overall_grade END", f"CASE WHEN {dear} THEN '家賃 ' || rent_yen || ' 円' END")} AS summary_ja,
  {pick(f"CASE WHEN {small} THEN '도보 ' || station_walk_min || '분' END", 'NULL')} AS evidence_ko, {pick(f"CASE WHEN {small} THEN '礼金の相談' END", 'NULL')} AS negotiation_ja,
  {pick(f"CASE WHEN NOT {small} THEN layout_type || ' 賃貸|' || nearest_station_name || ' 徒歩' || station_walk_min || '分' END", 'NULL')} AS queries_ja FROM b3"""


_R = lambda *cols: ", ".join(f"round_even({c}, 6) AS {c}" for c in cols)
ORACLES: dict[str, str] = {
    "validate_listings": _errors(),
    "measures": f"WITH {_base('subjects')},\n{MEASURED} SELECT listing_id, monthly_fixed_cost_yen, building_age_years, im_assessment, {_R('im_market_avg', 'initial_multiple', 'initial_multiple_market_delta', 'initial_multiple_market_delta_foreigner')} FROM m",
    "pricing_sanity": _SANITY,
    "benchmark_index": f"{_MARKET}, {INDEX} SELECT * FROM idx",
    "benchmark_match": f"WITH {_base('market', 'subjects')},\n{MEASURED},\n{INDEX},\n{MATCHED},\n{DELTAS} SELECT listing_id, matched_level, benchmark_confidence, benchmark_raw_yen, benchmark_n_rows, benchmark_yen, benchmark_mgmt_fee_yen, benchmark_total_yen, {_R('structure_multiplier', 'rent_delta_ratio', 'rent_only_delta_ratio')} FROM k",
    "scores": f"{_FULL} SELECT listing_id, {', '.join(f'{c}_score, {c}_grade' for c in (*_PARTS, 'overall'))} FROM z",
    "evaluate": f"{_FULL}, t AS (SELECT *, {_TRADEOFF} AS tradeoff_tag, {_TEMPLATE} AS template_id, array_to_string(list_filter([{', '.join(f"CASE WHEN {w} THEN '{f}:{s}' END" for f, s, w in _FLAGS)}], lambda x: x IS NOT NULL), ',') AS flags FROM z) SELECT listing_id, overall_score, overall_grade, benchmark_confidence, flags, tradeoff_tag, template_id, {_SUMMARY} AS summary FROM t",
    "risk_flag_counts": f"{_FULL}, f AS ({' UNION ALL '.join(f"SELECT '{f}' AS risk_flag_id, '{s}' AS severity FROM z WHERE {w}" for f, s, w in _FLAGS)}) SELECT risk_flag_id, severity, count(*) AS n FROM f GROUP BY ALL",
    "template_counts": f"{_FULL} SELECT {_TEMPLATE} AS template_id, count(*) AS n FROM z GROUP BY ALL",
    "whatif": _whatif(),
    "golden_run": _golden(),
    "fee_scenarios": f"WITH {_base('subjects')} SELECT listing_id, cut_pct, CAST(round_even(initial_cost_total_yen * (100 - cut_pct) / 100, 0) AS BIGINT) AS cut_total_yen FROM subjects, (SELECT unnest([0, 10, 20, 30]) AS cut_pct)",
    "risk_chips": f"""{_FULL}, t AS (SELECT *, CASE WHEN station_walk_min >= 45 THEN 'high' WHEN station_walk_min >= 30 THEN 'mid' WHEN station_walk_min >= 20 THEN 'low' END AS tier FROM z)
SELECT listing_id, array_to_string(list_filter([{', '.join(f"CASE WHEN {w} THEN '{f}:' || " + ("coalesce(tier, 'mid')" if f == 'FAR_FROM_STATION' else f"'{s}'") + " END" for f, s, w in _FLAGS)},
  CASE WHEN benchmark_confidence IN ('none', 'low') THEN NULL WHEN rent_delta_ratio >= 0.5 THEN 'RENT_OVER_BENCHMARK:high' WHEN rent_delta_ratio >= 0.25 THEN 'RENT_OVER_BENCHMARK:mid' WHEN rent_delta_ratio >= 0.1 THEN 'RENT_OVER_BENCHMARK:low' END,
  CASE im_assessment WHEN 'high' THEN 'INITIAL_MULTIPLE:high' WHEN 'rather high' THEN 'INITIAL_MULTIPLE:mid' END], lambda x: x IS NOT NULL), ',') AS chips,
  CASE WHEN greatest(location_score, condition_score, cost_score) - least(location_score, condition_score, cost_score) >= 20 THEN 'strong ' || CASE greatest(location_score, condition_score, cost_score) WHEN location_score THEN 'location' WHEN condition_score THEN 'condition' ELSE 'cost' END ELSE 'even' END AS balance FROM t""",
    **{f"comparables_{d}": f"{_LIVE_BASE},\n{_live(d)} SELECT {_LIVE_COLS} FROM live_{d}" for d in comparables.LADDERS},
    "provider_fallback": f"""{_LIVE_BASE},\n{', '.join(_live(d) for d in comparables.LADDERS)}, {_FALLBACK} SELECT {_LIVE_COLS}, provider, attempts FROM pf""",
    "reject_counts": _rejects("cassette"),
    "attempt_log": _attempt_log(),
    "comparables_detailed": _detailed(),
    "offer_coverage": f"WITH {_base('market', 'offers')} SELECT page, count(*) AS fetched_n, {', '.join(f'count({c}) AS has_{c}' for c in ('area_sqm', 'walk_min', 'building_age_years', 'orientation', 'building_structure', 'bathroom_toilet_separate', 'building_type'))} FROM offers GROUP BY page",
    "distinct_offers": f"WITH {_base('market', 'offers')} SELECT prefecture, municipality, count(*) AS n FROM (SELECT DISTINCT prefecture, municipality, rent_yen, admin_fee_yen, area_sqm, layout_type FROM offers) GROUP BY ALL",
    "segments": f"""WITH {_base('market', 'offers')} SELECT CASE WHEN area_sqm < 15 THEN 'lt15' WHEN area_sqm < 20 THEN '15_19' WHEN area_sqm < 25 THEN '20_24' WHEN area_sqm < 30 THEN '25_29' ELSE 'ge30' END AS area_segment,
  CASE WHEN building_age_years <= 5 THEN '0_5' WHEN building_age_years <= 10 THEN '6_10' WHEN building_age_years <= 20 THEN '11_20' ELSE 'ge21' END AS age_segment,
  CASE WHEN walk_min <= 5 THEN 'le5' WHEN walk_min <= 10 THEN '6_10' WHEN walk_min <= 15 THEN '11_15' ELSE 'ge16' END AS walk_segment, count(*) AS n, CAST(median(rent_yen) AS DOUBLE) AS median_rent_yen FROM offers GROUP BY ALL""",
    "rent_quartiles": f"{_MARKET} SELECT prefecture, layout_type, count(*) AS n_rows, quantile_cont(avg_rent_yen, 0.25) AS p25, quantile_cont(avg_rent_yen, 0.5) AS p50, quantile_cont(avg_rent_yen, 0.75) AS p75, round_even(avg(avg_rent_yen), 4) AS mean_rent FROM market GROUP BY ALL HAVING count(*) >= 30",
    "collected_medians": f"{_MARKET}, {_COLLECTED} SELECT prefecture, municipality, layout_type, building_structure, rent_yen AS median_rent_yen, n_rows FROM r WHERE n_rows >= {spec.MIN_SAMPLES}",
    "missing_combinations": f"{_MARKET}, {_COLLECTED}, {_GRID} SELECT w.* FROM w ANTI JOIN have USING (prefecture, municipality, layout_type, building_structure)",
    "coverage": f"{_MARKET}, {_COLLECTED}, {_GRID} SELECT coalesce(building_structure, 'all') AS building_structure, count(*) AS wanted_n, count(n_rows) AS covered_n, round_even(count(n_rows) * 100e0 / count(*), 4) AS covered_pct FROM w LEFT JOIN have USING (prefecture, municipality, layout_type, building_structure) GROUP BY ROLLUP (building_structure)",
    "structure_ratio_stats": f"""{_MARKET}, {_COLLECTED}, {_RATIOS} SELECT building_structure, layout_type, prefecture, CASE WHEN grouping(layout_type) = 0 THEN 'layout' WHEN grouping(prefecture) = 0 THEN 'prefecture' ELSE 'all' END AS level, count(*) AS n,
  round_even(avg(ratio), 6) AS mean_ratio, round_even(median(ratio), 6) AS median_ratio, round_even(min(ratio), 6) AS min_ratio, round_even(max(ratio), 6) AS max_ratio FROM q GROUP BY GROUPING SETS ((building_structure), (building_structure, layout_type), (building_structure, prefecture))""",
    "imputed_rents": f"""{_MARKET}, {_COLLECTED}, {_GRID}, {_RATIOS}, gone AS (SELECT w.* FROM w ANTI JOIN have USING (prefecture, municipality, layout_type, building_structure)),
n1 AS (SELECT layout_type, building_structure, count(*) AS n, median(ratio) AS r FROM q GROUP BY ALL), n2 AS (SELECT building_structure, count(*) AS n, median(ratio) AS r FROM q GROUP BY ALL),
o AS (SELECT gone.*, b.rent_yen AS rc_rent, coalesce(CASE WHEN n1.n >= 3 THEN n1.r END, CASE WHEN n2.n >= 3 THEN n2.r END, {_CASE(spec.IMPUTATION_RATIOS, 'gone.building_structure', 'NULL')}) AS ratio
  FROM gone JOIN r b ON b.building_structure = 'rc' AND b.rent_yen > 0 AND b.prefecture = gone.prefecture AND b.municipality = gone.municipality AND b.layout_type = gone.layout_type
    LEFT JOIN n1 ON n1.layout_type = gone.layout_type AND n1.building_structure = gone.building_structure LEFT JOIN n2 ON n2.building_structure = gone.building_structure)
SELECT prefecture, municipality, layout_type, building_structure, rc_rent, round_even(ratio, 6) AS ratio, CAST(round_even(rc_rent * ratio / 100, 0) * 100 AS BIGINT) AS avg_rent_yen, 'estimated_from_rc' AS source_name, 'estimate' AS confidence FROM o WHERE ratio IS NOT NULL""",
    "merged_rows": f"""{_MARKET}, e AS (SELECT prefecture, municipality, layout_type, building_structure, avg_rent_yen, source_name, source_updated_at FROM market WHERE l_linenumber <= 3), i AS (SELECT DISTINCT prefecture, municipality, layout_type, building_structure, avg_rent_yen, source_name, source_updated_at FROM market WHERE l_linenumber >= 3)
SELECT * FROM e UNION ALL (SELECT * FROM i EXCEPT SELECT * FROM e)""",
    "collection_template": f"""{_MARKET}, t AS (SELECT prefecture, municipality, layout_type, source_name, arg_max(avg_rent_yen, source_updated_at || lpad(CAST(avg_rent_yen AS VARCHAR), 12, '0')) AS base_rent_yen FROM market WHERE building_structure = 'all' GROUP BY ALL)
SELECT prefecture, municipality, layout_type, s.building_structure, source_name, base_rent_yen FROM t, (SELECT unnest({spec.STRUCTURES[:5]}) AS building_structure) s""",
    "structure_ordering": f"{_MARKET}, {_COLLECTED} SELECT prefecture, municipality, layout_type, max(rent_yen) FILTER (building_structure = 'wood') AS wood_rent, max(rent_yen) FILTER (building_structure = 'rc') AS rc_rent, wood_rent < rc_rent AS as_expected FROM r GROUP BY ALL HAVING wood_rent IS NOT NULL AND rc_rent IS NOT NULL",
    "market_summary": f"""{_MARKET} SELECT count(*) AS n_rows, string_agg(DISTINCT source_name, ',' ORDER BY source_name) AS sources, string_agg(DISTINCT prefecture, ',' ORDER BY prefecture) AS prefectures, max(source_updated_at) AS latest_source_updated_at, max(collected_at) AS latest_collected_at,
  (SELECT string_agg(method_notes, ',' ORDER BY seen, method_notes) FROM (SELECT method_notes, min(l_orderkey * 10 + l_linenumber) AS seen FROM market WHERE coalesce(method_notes, '') <> '' GROUP BY method_notes ORDER BY seen, method_notes LIMIT 3)) AS notes FROM market""",
    "full_template": f"""{_MARKET}, b AS (SELECT * FROM market WHERE building_structure = 'all'), t AS (SELECT prefecture, municipality, layout_type, source_name, arg_max(avg_rent_yen, source_updated_at || lpad(CAST(avg_rent_yen AS VARCHAR), 12, '0')) AS base_rent_yen FROM b GROUP BY ALL),
  w AS (SELECT * FROM (SELECT DISTINCT prefecture, municipality FROM b) JOIN (SELECT DISTINCT prefecture, source_name FROM b) USING (prefecture), (SELECT unnest({spec.LAYOUTS}) AS layout_type) l)
SELECT prefecture, municipality, layout_type, s.building_structure, source_name, base_rent_yen FROM w LEFT JOIN t USING (prefecture, municipality, layout_type, source_name), (SELECT unnest({spec.STRUCTURES[:5]}) AS building_structure) s""",
    "imputation_counts": f"""{_MARKET}, {_COLLECTED}, {_GRID}, {_RATIOS}, gone AS (SELECT w.* FROM w ANTI JOIN have USING (prefecture, municipality, layout_type, building_structure)), base AS (SELECT DISTINCT prefecture, municipality, layout_type FROM r WHERE building_structure = 'rc' AND rent_yen > 0),
n1 AS (SELECT layout_type, building_structure FROM q GROUP BY ALL HAVING count(*) >= 3), n2 AS (SELECT building_structure FROM q GROUP BY ALL HAVING count(*) >= 3)
SELECT CASE WHEN base.prefecture IS NULL THEN 'no_base' WHEN n1.layout_type IS NOT NULL OR n2.building_structure IS NOT NULL OR gone.building_structure IN ({', '.join(f"'{k}'" for k in spec.IMPUTATION_RATIOS)}) THEN 'filled' ELSE 'no_ratio' END AS outcome, count(*) AS n
FROM gone LEFT JOIN base USING (prefecture, municipality, layout_type) LEFT JOIN n1 ON n1.layout_type = gone.layout_type AND n1.building_structure = gone.building_structure LEFT JOIN n2 ON n2.building_structure = gone.building_structure GROUP BY 1""",
    "comparables_paged": f"{_LIVE_BASE},\n{_live('lines', paged=True)} SELECT {_LIVE_COLS} FROM live_lines",
    "comparables_enriched": f"{_LIVE_BASE.replace('offers AS (', 'found_offers AS (')}, offers AS (SELECT * EXCLUDE (building_structure, bathroom_toilet_separate), coalesce(building_structure, CASE WHEN pos % 2 = 0 THEN 'rc' END) AS building_structure, coalesce(bathroom_toilet_separate, CASE WHEN pos % 2 = 0 THEN true END) AS bathroom_toilet_separate FROM found_offers),\n{_live('cassette')} SELECT {_LIVE_COLS} FROM live_cassette",
    "structure_counts": f"{_MARKET} SELECT building_structure, count(*) AS n_rows FROM market GROUP BY ALL",
    "closest_municipality": f"""{_MARKET}, a AS (SELECT DISTINCT prefecture, municipality || ' ward' AS municipality FROM market), b AS (SELECT DISTINCT prefecture, municipality AS known FROM market)
SELECT a.prefecture, a.municipality, arg_min(known, lpad(CAST(abs(length(a.municipality) - length(known)) AS VARCHAR), 6, '0') || known) AS known FROM a JOIN b ON a.prefecture = b.prefecture AND (contains(a.municipality, known) OR contains(known, a.municipality)) GROUP BY ALL""",
    "parsed_offers": f"""WITH {_base('subjects')} SELECT listing_id, CAST(round(rent_yen / 1000e0) * 1000 AS BIGINT) AS rent_yen, mgmt_fee_yen AS admin_fee_yen, area_sqm, station_walk_min AS walk_min, listing_id % 45 AS building_age_years, layout_type,
  CASE orientation WHEN 'UNKNOWN' THEN NULL ELSE orientation END AS orientation, CASE building_structure WHEN 'other' THEN NULL ELSE building_structure END AS building_structure, bathroom_toilet_separate AS bath_separate FROM subjects""",
    "page_lines": f"""SELECT page_id, len(ls) AS n_lines, md5(array_to_string(ls, chr(10))) AS lines_md5 FROM (SELECT page_id, {_page_lines('html')} AS ls FROM pages)""",
    **_documents(),
    **_checks(),
    "bundled_reports": _bundled(),
    **_more(),
    "list_urls": _list_urls(),
    "stored_index": f"{_MARKET}, {INDEX} SELECT * FROM idx",
    "appended_rows": f"{_MARKET} SELECT CASE WHEN l_linenumber <= 3 THEN 'early' ELSE 'late' END AS batch, building_structure, count(*) AS n, CAST(sum(avg_rent_yen) AS BIGINT) AS rents FROM market GROUP BY ALL",
    "written_rows": f"""{_MARKET}, kinds AS (SELECT unnest(['json', 'csv']) AS kind) SELECT kind, 'Japan' AS region_country, prefecture, municipality, layout_type, building_structure, avg_rent_yen, source_name,
      CASE WHEN l_linenumber % 3 > 0 THEN 'https://rooms.example/?a=1,2&s=' || l_suppkey END AS source_url, source_updated_at, collected_at,
      CASE WHEN l_linenumber % 2 = 0 THEN 'by "' || method_notes || '", of ' || municipality END AS method_notes FROM market, kinds""",
    "pasted_rows": f"""{_MARKET} SELECT 'Japan' AS region_country, prefecture, municipality, layout_type, CASE WHEN l_linenumber % 2 = 0 THEN building_structure ELSE 'all' END AS building_structure, avg_rent_yen,
      source_name, CAST(NULL AS VARCHAR) AS source_url, source_updated_at, collected_at, method_notes || ', "est."' AS method_notes FROM market WHERE l_linenumber <> 5""",
    "cached_pages": "SELECT page_id, left(sha256(url), 32) AS cache_key, page_id % 3 > 0 AS found, CASE WHEN page_id % 3 > 0 THEN CAST(length(html) AS BIGINT) ELSE 0 END AS n_chars FROM pages",
    "streamed_index": f"WITH {_base('market').replace('market AS (', 'arrived AS (')}, market AS (SELECT DISTINCT prefecture, municipality, layout_type, building_structure, avg_rent_yen, source_name, source_updated_at FROM arrived), {INDEX} SELECT * FROM idx",
}
ORACLES["reported_gaps"] = ORACLES["missing_combinations"]
#: Evaluation that prefers comparable offers.
_PREFERRED = ("matched_level", "benchmark_confidence", "benchmark_yen", "benchmark_n_rows", "benchmark_raw_yen")
ORACLES["evaluate_live"] = f"""{_LIVE_BASE},\n{INDEX},\n{MATCHED},\n{', '.join(_live(d) for d in comparables.LADDERS)}, {_FALLBACK.removesuffix(')')}), k3l AS (SELECT k3.* EXCLUDE ({', '.join(_PREFERRED)}), pf.benchmark_confidence <> 'none' AND pf.benchmark_yen IS NOT NULL AS use_live,
  {', '.join(f"CASE WHEN use_live THEN pf.{'n' if c == 'benchmark_n_rows' else 'benchmark_yen' if c == 'benchmark_raw_yen' else c} ELSE k3.{c} END AS {c}" for c in _PREFERRED)} FROM k3 LEFT JOIN pf USING (listing_id)
), {DELTAS.replace('FROM k3', 'FROM k3l')},\n{SCORED}
SELECT listing_id, matched_level, benchmark_confidence, benchmark_total_yen, overall_score, overall_grade, {_TEMPLATE} AS template_id FROM z"""
