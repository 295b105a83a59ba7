"""Measures of a listing as columns: cost, age, multiples, deltas, plausibility."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from .. import spec


def monthly_cost() -> Column:
    return F.col("rent_yen") + F.col("mgmt_fee_yen")


def ratio(numerator: Column, denominator: Column, otherwise: float | None = 0.0) -> Column:
    """A quotient; ``otherwise`` where the denominator is missing or not above zero."""
    return F.when(denominator > 0, numerator.cast("double") / denominator).otherwise(F.lit(otherwise).cast("double"))


def building_age(as_of_year: int) -> Column:
    return F.greatest(F.lit(0), F.lit(as_of_year) - F.col("building_built_year"))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def market_average() -> Column:
    table = F.create_map(*(F.lit(v) for pair in spec.IM_MARKET_AVERAGE.items() for v in pair))
    return F.coalesce(F.try_element_at(table, F.col("prefecture")), F.lit(spec.IM_MARKET_DEFAULT))


def assessment(delta: Column) -> Column:
    """The initial multiple against the market, in five words."""
    return F.when(delta <= -1.5, "very low").when(delta <= -1.0, "low").when(delta < 1.0, "average").when(delta < 1.5, "rather high").otherwise("high")


def mgmt_fee_estimate(benchmark: Column, own_fee: Column) -> Column:
    """What a rent-only benchmark lacks: a share of it, capped, and never more than the listing's own fee."""
    share = clamp(F.bround(benchmark * spec.MGMT_FEE_RATE), 0, spec.MGMT_FEE_CAP)
    return F.when((benchmark > 0) & (own_fee > 0), F.least(own_fee, share)).otherwise(F.lit(0)).cast("bigint")


def with_measures(df: DataFrame, as_of_year: int) -> DataFrame:
    """Add monthly cost, age, initial multiple and its relation to the market."""
    step = df.withColumns({"monthly_fixed_cost_yen": monthly_cost(), "building_age_years": building_age(as_of_year), "im_market_avg": market_average()})
    step = step.withColumn("initial_multiple", ratio(F.col("initial_cost_total_yen"), F.col("monthly_fixed_cost_yen")))
    step = step.withColumn("initial_multiple_foreigner", F.greatest(F.lit(0.0), F.col("initial_multiple") - spec.SCORING["im_shift_months"]))
    return step.withColumns({"initial_multiple_market_delta": F.col("initial_multiple") - F.col("im_market_avg"), "initial_multiple_market_delta_foreigner": F.col("initial_multiple_foreigner") - F.col("im_market_avg"), "im_assessment": assessment(F.col("initial_multiple") - F.col("im_market_avg"))})


def present(df_columns: list[str], name: str) -> Column:
    return F.col(name) if name in df_columns else F.lit(None).cast("bigint")


def pricing_sanity(df: DataFrame) -> DataFrame:
    """Add ``breakdown_sum_yen`` (null if no item is given), ``sanity_flags`` and ``suspect``.

    Needs ``initial_multiple``; fee columns that the input lacks count as not given.
    """
    fees = [present(df.columns, c) for c in spec.BREAKDOWN]
    total = functools.reduce(Column.__add__, (F.coalesce(c, F.lit(0)) for c in fees))
    any_given = functools.reduce(Column.__or__, (c.isNotNull() for c in fees))
    months = {c: ratio(present(df.columns, c), F.col("rent_yen"), None) for c in ("shikikin_yen", "reikin_yen", "brokerage_fee_yen")}
    df = df.withColumn("breakdown_sum_yen", F.when(any_given, total))
    flags = F.array_compact(F.array(
        F.when(F.col("initial_multiple") >= 10, "initial_multiple_ge_10"),
        F.when(months["reikin_yen"] > 3, "reikin_months_gt_3"),
        F.when(months["shikikin_yen"] > 3, "shikikin_months_gt_3"),
        F.when(months["brokerage_fee_yen"] > 2, "brokerage_months_gt_2"),
        F.when((F.col("initial_cost_total_yen") > 0) & (F.col("breakdown_sum_yen") > F.col("initial_cost_total_yen") * 1.2), "initial_breakdown_sum_gt_total_120pct"),
    ))
    return df.withColumn("sanity_flags", flags).withColumn("suspect", F.size("sanity_flags") > 0)
