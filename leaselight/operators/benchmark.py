"""The market index, at three levels, and its lookup with fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import spec
from . import comparables
from .derive import clamp, mgmt_fee_estimate

_KEYS = {"structure": ["prefecture", "municipality", "layout_type", "building_structure"], "municipality": ["prefecture", "municipality", "layout_type"], "prefecture": ["prefecture", "layout_type"]}


def usable(rows: DataFrame) -> DataFrame:
    """Market rows with a prefecture, municipality and layout; a blank structure is ``all``."""
    named = rows.where(" AND ".join(f"coalesce(trim({c}), '') <> ''" for c in _KEYS["municipality"]))
    return named.withColumn("building_structure", F.coalesce(F.nullif(F.trim("building_structure"), F.lit("")), F.lit("all")))


def build_index(rows: DataFrame, sources: bool = False) -> DataFrame:
    """One row for each level and key: the truncated median rent and how many rows it stands on.

    One pass of grouping sets; ``sources`` adds the contributing rows' names and dates.
    """
    extra = [F.array_sort(F.collect_set(F.struct("source_name", "source_updated_at"))).alias("sources")] if sources else []
    level = F.when(F.grouping("building_structure") == 0, "structure").when(F.grouping("municipality") == 0, "municipality").otherwise("prefecture").alias("level")
    keys = [F.col(c) for c in _KEYS["structure"]]
    sets = [[F.col(c) for c in _KEYS[k]] for k in _KEYS]
    grouped = usable(rows).groupingSets(sets, *keys).agg(level, F.median("avg_rent_yen").cast("bigint").alias("benchmark_rent_yen_median"), F.count("*").alias("n_rows"), *extra)
    return grouped.where((F.col("level") != "structure") | (F.col("building_structure") != "all"))


def level_of(index: DataFrame, level: str) -> DataFrame:
    keys = _KEYS[level]
    return index.where(F.col("level") == level).select(*keys, F.col("benchmark_rent_yen_median").alias(f"{level}_rent"), F.col("n_rows").alias(f"{level}_n"))


def multiplier(enabled: bool = True, own: dict[str, float] | None = None) -> Column:
    """The structure's share of an all-structure median, within bounds; 1 if it is switched off."""
    if not enabled:
        return F.lit(1.0)
    table = spec.STRUCTURE_MULTIPLIERS | (own or {})
    found = F.try_element_at(F.create_map(*(F.lit(v) for pair in table.items() for v in pair)), F.col("building_structure"))
    return clamp(F.coalesce(found, F.lit(1.0)), *spec.MULTIPLIER_RANGE)


def match(subjects: DataFrame, index: DataFrame, hedonic: bool = True, multipliers: dict[str, float] | None = None) -> DataFrame:
    """Add the best available median: by structure (two rows or more), municipality, or prefecture.

    Three left joins on plain keys; index levels are as small as the map of places, so
    Spark broadcasts them where their size allows and shuffles them otherwise.
    """
    joined = subjects
    for level, keys in _KEYS.items():
        joined = joined.join(level_of(index, level), keys, "left")
    specific = F.col("building_structure").isNotNull() & ~F.col("building_structure").isin("", "other", "all") & (F.col("structure_n") >= 2)
    level = F.when(specific, "structure").when(F.col("municipality_n").isNotNull(), "municipality").when(F.col("prefecture_n").isNotNull(), "prefecture").otherwise("none")
    joined = joined.withColumn("matched_level", level)
    pick = lambda suffix: F.when(F.col("matched_level") == "structure", F.col(f"structure_{suffix}")).when(F.col("matched_level") == "municipality", F.col(f"municipality_{suffix}")).when(F.col("matched_level") == "prefecture", F.col(f"prefecture_{suffix}"))
    confidence = F.when(F.col("matched_level") == "structure", "high").when(F.col("matched_level") == "municipality", F.when(F.col("municipality_n") >= 2, "high").otherwise("mid")).when(F.col("matched_level") == "prefecture", "mid").otherwise("none")
    factor = F.when(F.col("matched_level") == "structure", 1.0).otherwise(multiplier(hedonic, multipliers))
    joined = joined.withColumns({"benchmark_raw_yen": pick("rent"), "benchmark_n_rows": pick("n"), "benchmark_confidence": confidence, "structure_multiplier": factor})
    joined = joined.withColumn("benchmark_yen", F.bround(F.col("benchmark_raw_yen") * F.col("structure_multiplier")).cast("bigint"))
    return joined.drop(*(f"{k}_{s}" for k in _KEYS for s in ("rent", "n")))


def with_fee_estimate(matched: DataFrame) -> DataFrame:
    """Make rent-only medians comparable to monthly totals; live figures already are."""
    live = F.col("matched_level").isin(comparables.live_levels())
    fee = F.when(live, F.lit(0)).otherwise(mgmt_fee_estimate(F.col("benchmark_yen"), F.col("mgmt_fee_yen"))).cast("bigint")
    return matched.withColumn("benchmark_mgmt_fee_yen", fee).withColumn("benchmark_total_yen", F.col("benchmark_yen") + F.col("benchmark_mgmt_fee_yen"))


def with_deltas(matched: DataFrame) -> DataFrame:
    """Add the relative difference of the monthly total (0 without a benchmark) and of the rent alone (null without)."""
    total, rent = F.col("benchmark_total_yen"), F.col("benchmark_yen")
    return matched.withColumns({
        "rent_delta_ratio": F.when(total > 0, (F.col("monthly_fixed_cost_yen") - total) / total).otherwise(0.0),
        "rent_only_delta_ratio": F.when(rent > 0, (F.col("rent_yen") - rent) / rent),
    })


def prefer_live(indexed: DataFrame, live: DataFrame, key: str = "listing_id") -> DataFrame:
    """Take the live figure where it has any confidence, else the index's."""
    own = live.select(key, F.col("benchmark_confidence").alias("__confidence"), F.col("benchmark_yen").alias("__yen"), F.col("matched_level").alias("__level"), F.col("n").alias("__n"))
    joined = indexed.join(own, key, "left")
    use = F.coalesce((F.col("__confidence") != "none") & F.col("__yen").isNotNull(), F.lit(False))
    pairs = {"benchmark_confidence": "__confidence", "benchmark_yen": "__yen", "matched_level": "__level", "benchmark_n_rows": "__n", "benchmark_raw_yen": "__yen"}
    use_it = joined.withColumn("__use", use)
    return use_it.withColumns({c: F.when(F.col("__use"), F.col(o)).otherwise(F.col(c)) for c, o in pairs.items()}).drop("__use", "__confidence", "__yen", "__level", "__n")


def spec_percentiles(rows: DataFrame, keys: list[str], least: int = 30) -> DataFrame:
    """Quartiles and mean of rents for keys with enough rows."""
    grouped = rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.percentile("avg_rent_yen", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.avg("avg_rent_yen").alias("mean_rent"))
    return grouped.where(F.col("n_rows") >= least).select(*keys, "n_rows", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), F.bround("mean_rent", 4).alias("mean_rent"))
