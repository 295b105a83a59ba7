"""Golden runs, cuts, descriptions and plain texts."""

import pytest
from pyspark.sql import functions as F

from leaselight.operators import report
from leaselight.plans import engine, regression
from tests.test_rules import TOWN, index, listings


def test_golden_run(spark):
    everything = {"station_walk_min": 20, "area_sqm": 14.0, "building_built_year": 1980, "orientation": "N", "bathroom_toilet_separate": False, "other_initial_fees_yen": 100_000, "contract_term_months": 24, "early_termination_penalty_yen": 100_000, "initial_cost_total_yen": 700_000}
    subjects = listings(spark, everything, {"listing_id": "unpriced"}, {"prefecture": "chiba", "layout_type": "1R", "area_sqm": 30.0})
    results = regression.run(subjects, 2020, without_benchmark=("unpriced",))
    out = {r.listing_id: r for r in results.collect()}
    assert out["unpriced"].template_id == "R01_BENCHMARK_NONE" and out["2"].template_id == "R02_BENCHMARK_LOW"
    assert (out["2"].benchmark_total_yen, out["2"].area_access_score_0_100) == (80_000 + 9_000 + 800 - 1_200, pytest.approx(92 - 9.6))
    assert regression.untriggered(results).count() == 0
    assert {r.name for r in regression.untriggered(regression.run(subjects.where("listing_id = '2'"), 2020)).collect()} >= {"R01_BENCHMARK_NONE", "NORTH_FACING"}
    assert all(0 <= r.overall_score <= 100 for r in out.values())


def test_fee_cuts(spark):
    row = report.fee_cuts(listings(spark, {"reikin_yen": 90_001, "brokerage_fee_yen": 45_000}), {"reikin_yen": "half", "brokerage_fee_yen": "waive"}).first()
    assert (row.cut_reikin_yen, row.cut_brokerage_fee_yen, row.cut_total_yen) == (45_001, 0, 380_000 - 45_000 - 45_000)


def test_words(spark):
    df = engine.evaluate(listings(spark, {}, {"orientation": "UNKNOWN", "prefecture": "osaka"}), index(spark, TOWN), 2024)
    told = df.select("listing_id", report.headline(df).alias("h"), *(c.alias(f"{k}_line") for k, c in report.descriptions(df).items()))
    a, b = told.orderBy("listing_id").collect()
    assert a.h[1] == "below others" and b.h[1] == "no comparison"
    assert a.location_line.startswith("8 min on foot") and a.condition_line == "14 years old, faces S" and b.condition_line == "14 years old"
    assert a.cost_line == "24% below others, low"


@pytest.mark.parametrize("x", [0.0, 1.5, 12.3456, 123.456, 1234.5, 99999.0, 0.5, 0.012346, -2.25, 1e-7, 3.0, 100.0])
def test_significant_digits(spark, x):
    assert spark.range(1).select(report.significant(F.lit(x))).first()[0] == f"{x:.4g}"


def test_plain_text(spark):
    df = spark.createDataFrame([(None, 2.5, ["a", "b"], True)], "n int, x double, l array<string>, b boolean")
    assert df.select(report.plain_text(df, "{n} {x} {l} {b} {absent}!")).first()[0] == "N/A 2.5 a, b true N/A!"
