"""Rules, features, texts and their boundaries."""

import pytest
from pyspark.sql import functions as F

from leaselight import spec
from leaselight.functions import rules, scoring
from leaselight.operators import benchmark, comparables, derive, report, validate
from leaselight.plans import engine

GOOD = {
    "listing_id": "a", "hub_station": "shinjuku", "prefecture": "tokyo", "municipality": "月見市", "nearest_station_name": "星野", "station_walk_min": 8, "layout_type": "1K", "building_structure": "wood", "area_sqm": 22.0,
    "building_built_year": 2010, "orientation": "S", "bathroom_toilet_separate": True, "rent_yen": 90_000, "mgmt_fee_yen": 5_000, "initial_cost_total_yen": 380_000,
}


def listings(spark, *changes):
    schema = spec.subject_schema()
    return spark.createDataFrame([tuple({**GOOD, "listing_id": str(i), **c}.get(f) for f in schema.names) for i, c in enumerate(changes or ({},))], schema)


def index(spark, rows):
    columns = "prefecture string, municipality string, layout_type string, building_structure string, avg_rent_yen long"
    return benchmark.build_index(spark.createDataFrame(rows, columns))


TOWN = [("tokyo", "月見市", "1K", "wood", 120_000)] * 2 + [("tokyo", "月見市", "1K", "rc", 160_000)] * 2 + [("tokyo", "月見市", "1K", "all", 150_000)] * 2


@pytest.mark.parametrize("rule, expected", [
    ({"==": [{"var": "x"}, None]}, [False, True]),
    ({"!=": [{"var": "x"}, 1]}, [False, True]),
    ({">": [{"var": "x"}, 0]}, [True, False]),
    ({"!": {">": [{"var": "x"}, 0]}}, [False, True]),
    ({"in": [{"var": "s"}, ["a", "b"]]}, [True, False]),
    ({"in": ["a", {"var": "s"}]}, [True, False]),
    ({"or": [{"<": [{"var": "x"}, 0]}, {"==": [1, 1]}]}, [True, True]),
    ({"==": [{"var": ["absent", 7]}, 7]}, [True, True]),
    ({">": [{"var": "absent"}, 7]}, [False, False]),
    ({"==": [{"var": "p.q"}, 5]}, [True, False]),
])
def test_rule(spark, rule, expected):
    df = spark.createDataFrame([(1, "a", (5,)), (None, None, None)], "x int, s string, p struct<q: int>")
    assert [r[0] for r in df.select(rules.compile_rule(rule, df.columns)).collect()] == expected


def test_bad_rules():
    for bad in ({"%": [1, 2]}, {"and": []}, {">": [1]}, [1], {"a": 1, "b": 2}):
        with pytest.raises(rules.RuleError):
            rules.compile_rule(bad, [])


def test_select_rule_prefers_conditions(spark):
    df = spark.createDataFrame([(1,)], "x int")
    chosen = rules.select_rule([("always", 900, {"==": [1, 1]}), ("low", 1, {">": [{"var": "x"}, 0]}), ("high", 5, {">": [{"var": "x"}, 0]})], df.columns)
    assert df.select(chosen).first()[0] == "high"


@pytest.mark.parametrize("column, at, off, flag", [
    ("station_walk_min", 15, 14, "FAR_FROM_STATION"), ("area_sqm", 14.5, 15.0, "VERY_SMALL_AREA"), ("building_built_year", 1994, 1995, "OLD_BUILDING"), ("orientation", "N", "NE", "NORTH_FACING"),
    ("bathroom_toilet_separate", False, True, "BATH_NOT_SEPARATE"), ("other_initial_fees_yen", 100_000, 80_000, "HIGH_OTHER_FEES"), ("contract_term_months", 24, 12, "LONG_CONTRACT_TERM"),
    ("early_termination_penalty_yen", 100_000, None, "HIGH_EARLY_TERMINATION_PENALTY"), ("initial_cost_total_yen", 570_000, 285_000, "HIGH_INITIAL_MULTIPLE"),
])
def test_flag_boundaries(spark, column, at, off, flag):
    out = engine.evaluate(listings(spark, {column: at}, {column: off}), index(spark, TOWN), 2024)
    flags = {r.listing_id: [f.risk_flag_id for f in r.risk_flags] for r in out.collect()}
    assert flag in flags["0"] and flag not in flags["1"]


def test_levels_and_confidence(spark):
    subjects = listings(spark, {}, {"building_structure": "rc"}, {"building_structure": "other"}, {"municipality": "港区"}, {"prefecture": "osaka"})
    found = {r.listing_id: r for r in engine.evaluate(subjects, index(spark, TOWN), 2024).collect()}
    assert [found[str(i)].benchmark_raw_yen for i in range(5)] == [120_000, 160_000, 150_000, 150_000, None]
    assert [found[str(i)].matched_level for i in range(5)] == ["structure", "structure", "municipality", "prefecture", "none"]
    assert [found[str(i)].benchmark_confidence for i in range(5)] == ["high", "high", "high", "mid", "none"]
    assert found["4"].template_id == "R01_BENCHMARK_NONE" and found["4"].summary and found["4"].rent_delta_ratio == 0


def test_whatif(spark):
    scored = engine.score(engine.measured(listings(spark, {"reikin_yen": 90_000, "brokerage_fee_yen": 45_001}, {"initial_cost_total_yen": 30_000}), index(spark, TOWN), 2024))
    got = {(r.listing_id, r.whatif_id): r for r in report.whatif(scored).collect()}
    assert got["0", "WI_SET_REIKIN_ZERO"].new_total_yen == 290_000
    assert got["0", "WI_SCALE_BROKERAGE_HALF"].new_yen == 22_500
    assert got["1", "WI_REDUCE_INITIAL_TOTAL_50K"].new_total_yen == 0
    assert all(r.cost_score >= r.old_cost_score for r in got.values())
    assert len(got) == 4


def test_scores_skip_what_is_missing(spark):
    df = spark.createDataFrame([(None, None), (4.0, None), (4.0, 2.0)], "a double, b double")
    feats = [{"input": c, "method": "linear", "params": {"x": [0, 4], "y": [0, 100], "clamp": True, "default": 50}} for c in "ab"]
    value = scoring.component([(scoring.feature(f, df.columns), w) for f, w in zip(feats, (0.6, 0.4))])
    assert [r[0] for r in df.select(value).collect()] == [70.0, 100.0, 80.0]
    default = scoring.component([(scoring.feature(f, df.columns, null_policy="default"), w) for f, w in zip(feats, (0.6, 0.4))], divide=True)
    assert [r[0] for r in df.select(default).collect()] == [50.0, 80.0, 80.0]


def test_validation(spark):
    bad = [{"layout_type": "2K"}, {"station_walk_min": 61}, {"rent_yen": -1}, {"rent_yen": 900_000}, {"area_sqm": None}, {"hub_station": "other"}]
    got = {r.listing_id: r.errors for r in validate.validate(listings(spark, *bad)).collect()}
    assert [got[str(i)] for i in range(6)] == [["enum:layout_type"], ["max:station_walk_min"], ["min:rent_yen"], [], ["missing:area_sqm"], ["missing:hub_station_other_name"]]


def test_payloads(spark):
    texts = ['{"rent_yen": 5, "area_sqm": 20}', '{"rent_yen": "5", "extra": 1}', '{"area_sqm": null}', "no json", None]
    df = validate.parse_payloads(spark.createDataFrame([(t,) for t in texts], "payload string"))
    assert [r.payload_errors for r in df.collect()] == [[], ["unknown:extra", "type:rent_yen"], ["type:area_sqm"], ["unreadable"], ["unreadable"]]
    assert (df.first().rent_yen, df.first().area_sqm) == (5, 20.0)


def test_json_schemas(spark):
    schema = {
        "type": "object", "required": ["id", "kind"], "additionalProperties": False, "definitions": {"id": {"type": "integer"}},
        "properties": {"id": {"$ref": "#/definitions/id"}, "kind": {"enum": ["a", "b", 3]}, "tags": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "string", "minLength": 2, "pattern": "^x"}}, "n": {"type": ["number", "null"], "minimum": 1, "maximum": 9}, "more": {"type": "object", "additionalProperties": {"type": "integer"}}, "v": {"const": 1}, "lost": {"$ref": "#/nowhere"}},
        "allOf": [{"if": {"properties": {"kind": {"const": "b"}}, "required": ["kind"]}, "then": {"required": ["n"]}}],
    }
    cases = {
        '{"id":1,"kind":"a"}': [], '{"id":"1","kind":"c","z":1}': ["type:$.id", "enum:$.kind", "additional:$.z"], '{"id":1,"kind":"b"}': ["required:$.n"], '{"id":1,"kind":3,"tags":[]}': ["minItems:$.tags"],
        '{"id":1,"kind":"a","tags":["x","xy","abc"],"n":0.5}': ["maxItems:$.tags", "minLength:$.tags[0]", "pattern:$.tags[2]", "minimum:$.n"], '{"id":2.5,"kind":"a","n":null,"more":{"q":1,"r":"s"},"v":2}': ["type:$.id", "type:$.more.r", "const:$.v"],
        "[1]": ["type:$"], "no json": ["unreadable:$"], '{"id":12345678901234567890,"kind":"b","n":10}': ["maximum:$.n"], '{"id":1,"kind":"a","lost":1}': ["$ref:$.lost"], '{"id":true,"kind":"a","n":"1"}': ["type:$.id", "type:$.n"],
    }
    found = validate.checked_by_schema(spark.createDataFrame([(c,) for c in cases], "payload string"), schema)
    assert {r.payload: r.findings for r in found.collect()} == cases


def test_content_is_coherent(spark):
    assert validate.incoherent(validate.references(spark), validate.vocabulary(spark)).count() == 0
    df = spark.createDataFrame([("x", [1]), (None, [])], "a string, b array<int>")
    found = validate.checked(df, {"a": {"required": True, "pattern": "^y", "minLength": 1}, "b": {"minItems": 1}}).collect()
    assert [r.schema_errors for r in found] == [["pattern:a"], ["required:a", "minItems:b"]]


def test_buckets(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert [value(f(F.lit(25.2), s)) for s in (0, 2) for f in (comparables.area_low, comparables.area_high)] == [25, 30, 15, 40]
    assert [value(comparables.next_bucket(F.lit(7), comparables.WALK_BUCKETS, s)) for s in (0, 1, 9)] == [7, 10, 20]
    assert [value(comparables.next_bucket(F.lit(x), comparables.AGE_BUCKETS, s)) for x, s in ((8, 0), (8, 2), (31, 0))] == [10, 20, None]
    assert [value(f(F.lit(23))) for f in (comparables.snap_floor, comparables.snap_ceil)] == [20, 25]


def test_robust_figure(spark):
    rows = [("one", 5), ("two", 10), ("two", 30), ("mid", 10), ("mid", 12), ("mid", 20), ("wide", 10), ("wide", 11), ("wide", 40), ("zero", 0), ("zero", 1), ("zero", 9), ("bad", -1), ("bad", None)]
    df = spark.createDataFrame(rows, "k string, v long")
    parts = comparables.robust_aggregate(F.col("v"))
    got = {r.k: (r.value, r.method) for r in df.groupBy("k").agg(parts["value"].alias("value"), parts["method"].alias("method")).collect()}
    assert got == {"one": (5, "single"), "two": (20, "mean"), "mid": (15, "midrange"), "wide": (11, "median"), "zero": (4, "midrange"), "bad": (None, "none")}


def test_page_stop_and_enrichment(spark):
    found = spark.createDataFrame([("a", 0, p, i) for i, p in enumerate((1, 2, 2, 3))], "listing_id string, step int, page int, i int")
    assert sorted(r.i for r in comparables.page_stop(found).collect()) == [0, 1, 2]
    offers = spark.createDataFrame([(1, "u1", None, None, "rc"), (2, "u2", "S", True, "rc"), (3, "u3", None, None, None)], "pos long, detail_url string, orientation string, bathroom_toilet_separate boolean, building_structure string")
    details = spark.createDataFrame([("u1", "N", False, "wood"), ("u3", "E", True, "src")], "detail_url string, orientation string, bathroom_toilet_separate boolean, building_structure string")
    assert [tuple(r)[2:] for r in comparables.enrich(offers, details).orderBy("pos").collect()] == [("N", False, "rc"), ("S", True, "rc"), ("E", True, "src")]
    assert [r.orientation for r in comparables.enrich(offers, details, budget=1).orderBy("pos").collect()] == ["N", "S", None]


def test_measures_at_zero(spark):
    row = derive.with_measures(listings(spark, {"rent_yen": 0, "mgmt_fee_yen": 0, "building_built_year": 2030}), 2024).first()
    assert (row.initial_multiple, row.building_age_years) == (0.0, 0)
    shown = derive.pricing_sanity(derive.with_measures(listings(spark, {"shikikin_yen": 400_000, "reikin_yen": 300_000, "brokerage_fee_yen": 200_000, "initial_cost_total_yen": 700_000}), 2024)).first()
    assert shown.sanity_flags == ["reikin_months_gt_3", "shikikin_months_gt_3", "brokerage_months_gt_2", "initial_breakdown_sum_gt_total_120pct"]


def test_counts_and_response(spark):
    assert spark.sql("SELECT map('a', 1, 'b', 5, 'c', 5) AS m").select(report.top_counts(F.col("m"), 2)).first()[0] == "b:5, c:5"
    nested = engine.response(engine.evaluate(listings(spark), index(spark, TOWN), 2024)).first()
    assert nested.derived.matched_level == "structure" and nested.grades.overall_grade in "ABCD" and nested.report.summary
