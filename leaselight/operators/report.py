"""Risk flags, trade-offs, what-if scenarios and rendered texts."""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import spec
from ..functions import rules, scoring
from . import derive

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def risk_flags(columns: Iterable[str], risk_rules: list[tuple[str, int, Any, str, str]] = spec.RISK_RULES) -> Column:
    """All flags whose rule holds, by ascending priority, each once with its first severity."""
    ordered = sorted(risk_rules, key=lambda r: r[1])
    found = F.array_compact(F.array(*(F.when(rules.compile_rule(when, columns), F.struct(F.lit(flag).alias("risk_flag_id"), F.lit(severity).alias("severity"))) for _, _, when, flag, severity in ordered)))
    if len({r[3] for r in ordered}) == len(ordered):
        return found
    seen = lambda acc, x: F.when(F.exists(acc, lambda a: a["risk_flag_id"] == x["risk_flag_id"]), acc).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(found, F.array().cast("array<struct<risk_flag_id:string,severity:string>>"), seen)


def tradeoff(columns: Iterable[str]) -> Column:
    return rules.first_match((rules.compile_rule(when, columns), tag) for _, _, when, tag in sorted(spec.TRADEOFF_RULES, key=lambda r: r[1]))


def template_id(columns: Iterable[str]) -> Column:
    return rules.first_match((rules.compile_rule(t[2], columns), t[0]) for t in sorted(spec.TEMPLATES, key=lambda t: -t[1]))


def with_rules(scored: DataFrame) -> DataFrame:
    columns = scored.columns
    return scored.withColumns({"risk_flags": risk_flags(columns), "tradeoff_tag": tradeoff(columns), "template_id": template_id(columns)})


def formatted(df: DataFrame, name: str) -> Column:
    """A value as text: two places, four for small numbers, without trailing zeros; nothing for null."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        text = F.when(F.abs(c) < 2, F.format_string("%.4f", scoring.rounded(c.cast("double"), 4))).otherwise(F.format_string("%.2f", scoring.rounded(c.cast("double"), 2)))
        return F.coalesce(F.rtrim(F.rtrim(text, F.lit("0")), F.lit(".")), F.lit("null"))
    return F.coalesce(c.cast("string"), F.lit("null"))


def rendered(df: DataFrame, text: str) -> Column:
    """The text with placeholders that name columns replaced; others stay as they are."""
    parts, at = [], 0
    for m in _PLACEHOLDER.finditer(text):
        if m[1] in df.columns:
            parts += [F.lit(text[at : m.start()]), formatted(df, m[1])]
            at = m.end()
    return F.concat(*parts, F.lit(text[at:]))


def placeholders(text: str) -> list[str]:
    return list(dict.fromkeys(_PLACEHOLDER.findall(text)))


def render(df: DataFrame) -> DataFrame:
    """Add ``summary``, ``evidence`` and ``negotiation`` of the chosen template."""
    case = lambda make: rules.first_match((F.col("template_id") == t[0], make(t)) for t in spec.TEMPLATES)
    return df.withColumns({
        "summary": case(lambda t: rendered(df, t[3])),
        "evidence": case(lambda t: F.array(*(rendered(df, x) for x in t[4]))),
        "negotiation": case(lambda t: F.array(*(rendered(df, x) for x in t[5]))),
    })


def whatif(scored: DataFrame, scoring_spec: dict[str, Any] = spec.SCORING, whatif_rules: list[tuple[str, Any, str, str, float | None]] = spec.WHATIF_RULES) -> DataFrame:
    """One row for each listing and enabled scenario, with the changed cost, multiple, cost score and grades.

    A change of one fee moves the total by as much; neither falls below zero.
    Location and condition stay as they were.
    """
    columns = scored.columns
    scenarios = []
    for name, when, action, target, value in whatif_rules:
        if target not in columns:
            continue
        old = F.col(target)
        changed = {"delta_yen": lambda: old + int(value), "set_zero": lambda: F.lit(0), "scale": lambda: F.bround(old * float(value))}[action]()
        new = F.greatest(F.lit(0), changed).cast("bigint")
        total = new if target == "initial_cost_total_yen" else F.greatest(F.lit(0), F.col("initial_cost_total_yen") + new - old).cast("bigint")
        scenarios.append(F.when(rules.compile_rule(when, columns), F.struct(F.lit(name).alias("whatif_id"), F.lit(target).alias("target"), old.cast("bigint").alias("old_yen"), new.alias("new_yen"), total.alias("new_total_yen"))))
    spread = scored.withColumn("w", F.explode(F.array_compact(F.array(*scenarios)))).select(*columns, "w.*")
    spread = spread.withColumnRenamed("initial_multiple", "old_initial_multiple").withColumnRenamed("cost_score", "old_cost_score").withColumnRenamed("overall_score", "old_overall_score")
    spread = spread.withColumn("initial_multiple", derive.ratio(F.col("new_total_yen"), F.col("monthly_fixed_cost_yen")))
    shifted = F.greatest(F.lit(0.0), F.col("initial_multiple") - scoring_spec["im_shift_months"]) - F.col("im_market_avg")
    spread = spread.withColumns({"initial_multiple_market_delta_foreigner": shifted, "initial_multiple_market_delta": F.col("initial_multiple") - F.col("im_market_avg")})
    spread = spread.withColumn("cost_score", scoring.rounded(scoring.component_scores(scoring_spec, spread.columns)["cost"]))
    spread = spread.withColumn("overall_score", scoring.overall(scoring_spec["weights"]))
    return spread.withColumns({"cost_grade": scoring.grade(F.col("cost_score"), scoring_spec["bands"]), "overall_grade": scoring.grade(F.col("overall_score"), scoring_spec["bands"])})


def fee_scenarios(subjects: DataFrame, cuts: tuple[int, ...] = (0, 10, 20, 30)) -> DataFrame:
    """The total cut by fixed shares: one row for each listing and share."""
    return subjects.withColumn("cut_pct", F.explode(F.array(*map(F.lit, cuts)))).withColumn("cut_total_yen", F.bround(F.col("initial_cost_total_yen") * (100 - F.col("cut_pct")) / 100).cast("bigint"))


def walk_tier(x: Column) -> Column:
    return F.when(x >= 45, "high").when(x >= 30, "mid").when(x >= 20, "low")


def rent_tier(delta: Column, confidence: Column) -> Column:
    return F.when(confidence.isin("none", "low"), None).when(delta >= 0.5, "high").when(delta >= 0.25, "mid").when(delta >= 0.1, "low")


def multiple_tier(label: Column) -> Column:
    return F.when(label == "high", "high").when(label == "rather high", "mid")


def chips(df: DataFrame) -> Column:
    """Flags with the tiers merged in: a walking tier overrides the severity of its flag, other tiers are appended."""
    walk = walk_tier(F.col("station_walk_min"))
    flags = F.transform("risk_flags", lambda f: F.struct(f["risk_flag_id"].alias("id"), F.when((f["risk_flag_id"] == "FAR_FROM_STATION") & walk.isNotNull(), walk).otherwise(f["severity"]).alias("severity")))
    more = F.array_compact(F.array(
        F.when(rent_tier(F.col("rent_delta_ratio"), F.col("benchmark_confidence")).isNotNull(), F.struct(F.lit("RENT_OVER_BENCHMARK").alias("id"), rent_tier(F.col("rent_delta_ratio"), F.col("benchmark_confidence")).alias("severity"))),
        F.when(multiple_tier(F.col("im_assessment")).isNotNull(), F.struct(F.lit("INITIAL_MULTIPLE").alias("id"), multiple_tier(F.col("im_assessment")).alias("severity"))),
    ))
    return F.concat(flags, more)


def top_counts(counts: Column, k: int = 3) -> Column:
    """The k largest entries of a map of counts as ``name:count``, ties by name."""
    entries = F.transform(F.map_entries(counts), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("k")))
    return F.array_join(F.transform(F.slice(F.array_sort(entries), 1, k), lambda e: F.concat_ws(":", e["k"], -e["n"])), ", ")


def balance(df: DataFrame, gap: float = 20) -> Column:
    """Which component stands out from the lowest by ``gap`` or more."""
    scores = [F.col(f"{c}_score") for c in scoring.COMPONENTS]
    high, low = F.greatest(*scores), F.least(*scores)
    name = rules.first_match((s == high, c) for s, c in zip(scores, scoring.COMPONENTS))
    return F.when(high - low >= gap, F.concat(F.lit("strong "), name)).otherwise("even")


FEES_TO_CUT = ["reikin_yen", "brokerage_fee_yen", "key_change_yen", "cleaning_fee_yen"]


def fee_cuts(subjects: DataFrame, actions: dict[str, str]) -> DataFrame:
    """The fees and the total after ``half`` or ``waive`` for each fee that is named; a fee not given counts as none."""
    new = {}
    for c in FEES_TO_CUT:
        old = F.coalesce(derive.present(subjects.columns, c), F.lit(0))
        new[c] = {"half": F.floor(old / 2 + 0.5).cast("bigint"), "waive": F.lit(0).cast("bigint")}.get(actions.get(c, ""), old)
    change = sum((new[c] - F.coalesce(derive.present(subjects.columns, c), F.lit(0)) for c in FEES_TO_CUT), F.lit(0))
    return subjects.withColumns({"cut_total_yen": F.greatest(F.lit(0), F.col("initial_cost_total_yen") + change)} | {f"cut_{c}": v for c, v in new.items()})


def percent(delta: Column) -> Column:
    return F.floor(F.abs(delta) * 100 + 0.5).cast("bigint")


def headline(df: DataFrame) -> Column:
    """What a reader should know first, as keys: which side is weak, and how the price compares.

    Input that looks wrong, and a missing benchmark, go before the comparison.
    """
    location, condition, cost, delta = (F.col(c) for c in ("location_score", "condition_score", "cost_score", "rent_delta_ratio"))
    side = F.when(condition - cost >= 20, "dear for its condition").when(location - condition >= 20, "well placed, condition lags").when(cost - location >= 20, "cheap, out of the way").otherwise("balanced")
    price = F.when(F.col("suspect"), "check the input").when(F.col("benchmark_confidence") == "none", "no comparison").when(percent(delta) <= 1, "as others").when(delta >= 0.5, "far above others").when(delta >= 0.25, "well above others").when(delta > 0, "above others").otherwise("below others")
    return F.array(side, price)


def descriptions(df: DataFrame) -> dict[str, Column]:
    """A short line for each component; what is not known is left out."""
    grades = F.when(F.col("location_grade") == "A", "excellent place").when(F.col("location_grade") == "B", "good place").when(F.col("location_grade") == "C", "fair place").when(F.col("location_grade") == "D", "remote place")
    delta = F.col("rent_delta_ratio")
    price = F.when(F.col("benchmark_confidence") != "none", F.when(delta <= -0.1, F.concat(percent(delta), F.lit("% below others"))).when(delta >= 0.1, F.concat(percent(delta), F.lit("% above others"))).otherwise("as others"))
    return {
        "location": F.concat_ws(", ", F.concat("station_walk_min", F.lit(" min on foot")), grades),
        "condition": F.concat_ws(", ", F.concat("building_age_years", F.lit(" years old")), F.when(F.col("orientation") != "UNKNOWN", F.concat(F.lit("faces "), "orientation"))),
        "cost": F.concat_ws(", ", price, "im_assessment"),
    }


def significant(x: Column, digits: int = 4) -> Column:
    """A number with so many significant digits and no trailing zeros; ``N/A`` for null.

    Very large and very small numbers take an exponent, as in C; decimal ties go to the even digit.
    """
    size = F.floor(F.log10(F.abs(x))).cast("int")
    trimmed = lambda t: F.regexp_replace(F.regexp_replace(t, r"(\.\d*?)0+(?=$|e)", "$1"), r"\.(?=$|e)", "")
    shown = lambda places: F.format_string(f"%.{places}f", F.bround(x, places))
    plain = F.when(size == 0, shown(digits - 1))
    for k in (*range(-4, 0), *range(1, digits)):  # below one, zeros follow the point
        plain = plain.when(size == k, shown(digits - 1 - k))
    far = F.format_string(f"%.{digits - 1}e", x)
    return F.when(x.isNull(), "N/A").when(x == 0, "0").otherwise(trimmed(F.when((size >= digits) | (size < -4), far).otherwise(plain)))


def plain_text(df: DataFrame, text: str) -> Column:
    """A text with every placeholder replaced: unknown ones by ``N/A``, doubles by four significant digits, lists joined."""
    parts, at = [], 0
    for m in _PLACEHOLDER.finditer(text):
        kind = df.schema[m[1]].dataType if m[1] in df.columns else None
        if kind is None:
            shown = F.lit("N/A")
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            shown = significant(F.col(m[1]))
        else:
            shown = F.coalesce(F.array_join(m[1], ", ") if isinstance(kind, T.ArrayType) else F.col(m[1]).cast("string"), F.lit("N/A"))
        parts += [F.lit(text[at : m.start()]), shown]
        at = m.end()
    return F.concat(*parts, F.lit(text[at:]))
