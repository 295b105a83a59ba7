"""From listings and a market index to scores, grades, flags and a report: one plan, no Python on rows."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, functions as F

from .. import spec
from ..functions import scoring
from ..operators import benchmark, derive, report


def score(df: DataFrame, scoring_spec: dict[str, Any] = spec.SCORING, null_policy: str = "skip") -> DataFrame:
    """Add component scores, the overall score and all four grades."""
    step = df.withColumns({f"{c}_score": scoring.rounded(s) for c, s in scoring.component_scores(scoring_spec, df.columns, null_policy).items()})
    step = step.withColumn("overall_score", scoring.overall(scoring_spec["weights"]))
    return step.withColumns({f"{c}_grade": scoring.grade(F.col(f"{c}_score"), scoring_spec["bands"]) for c in (*scoring.COMPONENTS, "overall")})


def measured(subjects: DataFrame, index: DataFrame, as_of_year: int) -> DataFrame:
    """Listings with measures, benchmark and deltas."""
    return benchmark.with_deltas(benchmark.with_fee_estimate(benchmark.match(derive.with_measures(subjects, as_of_year), index)))


def evaluate(subjects: DataFrame, index: DataFrame, as_of_year: int, scoring_spec: dict[str, Any] = spec.SCORING, live: DataFrame | None = None) -> DataFrame:
    """Everything about each listing: measures, benchmark, scores, grades, risk flags, trade-off, template and texts."""
    matched = benchmark.match(derive.with_measures(subjects, as_of_year), index)
    if live is not None:
        matched = benchmark.prefer_live(matched, live)
    scored = score(benchmark.with_deltas(benchmark.with_fee_estimate(matched)), scoring_spec)
    return report.render(report.with_rules(derive.pricing_sanity(scored)))


def response(evaluated: DataFrame) -> DataFrame:
    """The nested answer for each listing: derived, scoring, grades and report, rounded to six places."""
    r6 = lambda c: F.bround(F.col(c), 6).alias(c)
    return evaluated.select(
        "listing_id",
        F.struct("monthly_fixed_cost_yen", "building_age_years", r6("initial_multiple"), r6("rent_delta_ratio"), "benchmark_yen", "benchmark_confidence", "matched_level", "sanity_flags").alias("derived"),
        F.struct(*(f"{c}_score" for c in (*scoring.COMPONENTS, "overall"))).alias("scoring"),
        F.struct(*(f"{c}_grade" for c in (*scoring.COMPONENTS, "overall"))).alias("grades"),
        F.struct("risk_flags", "template_id", "summary", "evidence", "negotiation").alias("report"),
    )
