"""Golden listings run in bulk with stand-ins for market and access, and what they must have triggered."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from .. import spec
from ..functions import rules, scoring
from ..operators import derive, report

#: Stand-in rents by prefecture and access scores by hub.
RENTS, RENT_OTHER, LEAST_RENT = {"tokyo": 105_000, "saitama": 75_000, "chiba": 80_000}, 85_000, 30_000
ACCESS, ACCESS_OTHER = {"tokyo_station": 95, "shinjuku": 92, "shibuya": 90, "ikebukuro": 86, "ueno": 82, "shinagawa": 86, "other": 75}, 80


def _looked_up(table: dict[str, int], key: str, otherwise: int) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for pair in table.items() for v in pair)), F.col(key)), F.lit(otherwise))


def _cut(x: Column) -> Column:
    return F.coalesce(x, F.lit(0)).cast("bigint")


def with_stand_ins(subjects: DataFrame, as_of_year: int, without_benchmark: Iterable[str] = ()) -> DataFrame:
    """Add measures, a stand-in benchmark with its confidence (none for the listings ``without_benchmark``), the delta and an access score."""
    step = derive.with_measures(subjects, as_of_year)
    rent = _looked_up(RENTS, "prefecture", RENT_OTHER) + F.when(F.col("layout_type") == "1K", 5_000).otherwise(0)
    rent = rent + _cut((F.col("area_sqm") - 20) * 900) - _cut((F.col("station_walk_min") - 10) * 400) - _cut(F.col("building_age_years") * 120)
    confidence = F.when(F.col("listing_id").cast("string").isin(list(without_benchmark)), "none").when(F.col("prefecture") == "tokyo", "mid").otherwise("low")
    step = step.withColumns({"benchmark_confidence": confidence, "benchmark_total_yen": F.when(confidence != "none", F.greatest(F.lit(LEAST_RENT), rent)), "initial_multiple": F.try_divide(F.col("initial_cost_total_yen").cast("double"), F.col("monthly_fixed_cost_yen"))})
    access = derive.clamp(_looked_up(ACCESS, "hub_station", ACCESS_OTHER) - F.coalesce(F.least(F.lit(25.0), F.col("station_walk_min") * 1.2), F.lit(0.0)), 0.0, 100.0)
    return step.withColumns({"rent_delta_ratio": F.try_divide((F.col("monthly_fixed_cost_yen") - F.col("benchmark_total_yen")).cast("double"), F.col("benchmark_total_yen")), "area_access_score_0_100": access})


def run(subjects: DataFrame, as_of_year: int, without_benchmark: Iterable[str] = ()) -> DataFrame:
    """Scores with defaults for missing values, flags, and the rules of greatest priority for trade-off and template."""
    step = with_stand_ins(subjects, as_of_year, without_benchmark)
    parts = {c: [(scoring.feature(f, step.columns, null_policy="default"), f["weight"]) for f in spec.SCORING["features"] if f["component"] == c] for c in scoring.COMPONENTS}
    step = step.withColumns({f"{c}_score": scoring.rounded(scoring.component(p, divide=True)) for c, p in parts.items()})
    step = step.withColumn("overall_score", scoring.overall(spec.SCORING["weights"]))
    step = step.withColumns({f"{c}_grade": scoring.grade(F.col(f"{c}_score"), spec.SCORING["bands"]) for c in (*scoring.COMPONENTS, "overall")})
    tags = rules.select_rule([(tag, priority, when) for _, priority, when, tag in spec.TRADEOFF_RULES], step.columns)
    templates = rules.select_rule([(t[0], t[1], t[2]) for t in spec.TEMPLATES], step.columns)
    return step.withColumns({"risk_flags": report.risk_flags(step.columns), "tradeoff_tag": F.coalesce(tags, F.lit("balanced")), "template_id": templates})


def untriggered(results: DataFrame) -> DataFrame:
    """Flags that no listing raised and the two benchmark templates, if none chose them: findings (``code``, ``name``)."""
    spark = results.sparkSession
    wanted = spark.createDataFrame([("flag", r[3]) for r in spec.RISK_RULES] + [("template", t[0]) for t in spec.TEMPLATES if t[0].startswith("R0") and "BENCHMARK" in t[0]], "code string, name string")
    seen = results.select(F.lit("flag").alias("code"), F.explode("risk_flags.risk_flag_id").alias("name")).union(results.select(F.lit("template"), "template_id")).distinct()
    return wanted.join(seen, ["code", "name"], "left_anti")
