"""Upkeep of market rows: merging, coverage, imputation, collection templates and summaries."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import spec
from . import names

ROW = ["region_country", "prefecture", "municipality", "layout_type", "building_structure", "avg_rent_yen", "source_name", "source_url", "source_updated_at", "collected_at", "method_notes"]
KEY = ["prefecture", "municipality", "layout_type", "building_structure"]
PLACE = KEY[:3]


def new_rows(existing: DataFrame, incoming: DataFrame, fields: list[str] = ROW) -> DataFrame:
    """Distinct incoming rows that differ from every existing one in some field; nulls are equal."""
    same = [F.col(f"i.{f}").eqNullSafe(F.col(f"e.{f}")) for f in fields]
    return incoming.select(fields).distinct().alias("i").join(existing.select(fields).distinct().alias("e"), same, "left_anti")


def merge(existing: DataFrame, incoming: DataFrame, fields: list[str] = ROW) -> DataFrame:
    """All existing rows and the new ones, in the order of their keys."""
    order = ["prefecture", "municipality", "layout_type", "building_structure", "source_updated_at", "source_name"]
    return existing.select(fields).unionByName(new_rows(existing, incoming, fields)).orderBy(*(F.col(c) for c in order if c in fields))


def last_by_key(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The last value of each key; rows of one key are combined where they lie."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def collected(rows: DataFrame, least: int = spec.MIN_SAMPLES) -> DataFrame:
    """Median rent and number of rows by place, layout and structure, where there are enough."""
    return rows.groupBy(*KEY).agg(F.median("avg_rent_yen").cast("bigint").alias("median_rent_yen"), F.count("*").alias("n_rows")).where(F.col("n_rows") >= least)


def grid(places: DataFrame, layouts: Iterable[str] = spec.LAYOUTS, structures: Iterable[str] = spec.STRUCTURES[:5]) -> DataFrame:
    """Every layout and structure for every place."""
    spread = F.explode(F.array(*(F.struct(F.lit(a).alias("layout_type"), F.lit(s).alias("building_structure")) for a in layouts for s in structures)))
    return places.select("prefecture", "municipality").distinct().withColumn("g", spread).select("prefecture", "municipality", "g.*")


def missing(wanted: DataFrame, have: DataFrame) -> DataFrame:
    return wanted.join(have.select(KEY).distinct(), KEY, "left_anti")


def coverage(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """Covered and wanted combinations by structure and in all (``all``), and the share in percent."""
    marked = wanted.join(have.select(KEY).distinct().withColumn("hit", F.lit(1)), KEY, "left")
    by = marked.rollup("building_structure").agg(F.count("*").alias("wanted_n"), F.count("hit").alias("covered_n"))
    return by.select(F.coalesce("building_structure", F.lit("all")).alias("building_structure"), "wanted_n", "covered_n", F.bround(F.col("covered_n") * 100.0 / F.col("wanted_n"), 4).alias("covered_pct"))


def structure_ratios(rents: DataFrame, value: str = "rent_yen") -> DataFrame:
    """Each structure's rent over that of reinforced concrete in the same place and layout."""
    base = rents.where("building_structure = 'rc'").select(*PLACE, F.col(value).alias("rc_rent"))
    return rents.where(f"building_structure <> 'rc' AND {value} > 0").join(base.where("rc_rent > 0"), PLACE).withColumn("ratio", F.col(value) / F.col("rc_rent"))


def ratio_stats(ratios: DataFrame) -> DataFrame:
    """Count, mean, median and range of ratios by structure, and by structure with layout or prefecture."""
    level = F.when(F.grouping("layout_type") == 0, "layout").when(F.grouping("prefecture") == 0, "prefecture").otherwise("all")
    s, a, p = F.col("building_structure"), F.col("layout_type"), F.col("prefecture")
    return ratios.groupingSets([[s], [s, a], [s, p]], s, a, p).agg(
        level.alias("level"), F.count("*").alias("n"), F.bround(F.avg("ratio"), 6).alias("mean_ratio"), F.bround(F.median("ratio"), 6).alias("median_ratio"), F.bround(F.min("ratio"), 6).alias("min_ratio"), F.bround(F.max("ratio"), 6).alias("max_ratio")
    )


def impute(rents: DataFrame, wanted: DataFrame, value: str = "rent_yen", least: int = 3) -> DataFrame:
    """Rents of missing combinations from the concrete rent of the place, in hundreds.

    The ratio is the median for layout and structure, else for the structure, each
    of ``least`` or more, else a constant; without any of them no row is made.
    """
    ratios = structure_ratios(rents, value)
    narrow = ratios.groupBy("layout_type", "building_structure").agg(F.count("*").alias("n1"), F.median("ratio").alias("r1"))
    wide = ratios.groupBy("building_structure").agg(F.count("*").alias("n2"), F.median("ratio").alias("r2"))
    fixed = F.create_map(*(F.lit(v) for pair in spec.IMPUTATION_RATIOS.items() for v in pair))
    base = rents.where(f"building_structure = 'rc' AND {value} > 0").select(*PLACE, F.col(value).alias("rc_rent"))
    joined = wanted.join(base, PLACE).join(F.broadcast(narrow), ["layout_type", "building_structure"], "left").join(F.broadcast(wide), "building_structure", "left")  # at most layouts times structures rows
    ratio = F.coalesce(F.when(F.col("n1") >= least, F.col("r1")), F.when(F.col("n2") >= least, F.col("r2")), F.try_element_at(fixed, F.col("building_structure")))
    made = joined.withColumn("ratio", ratio).where("ratio IS NOT NULL")
    return made.select(*KEY, "rc_rent", F.bround("ratio", 6).alias("ratio"), F.bround(F.col("rc_rent") * F.col("ratio"), -2).cast("bigint").alias("avg_rent_yen"), F.lit("estimated_from_rc").alias("source_name"), F.lit("estimate").alias("confidence"))


def imputation_counts(rents: DataFrame, wanted: DataFrame, value: str = "rent_yen", least: int = 3) -> DataFrame:
    """How many missing combinations are filled, and how many are not for want of a base rent or of a ratio."""
    made = impute(rents, wanted, value, least).select(*KEY, F.lit("filled").alias("outcome"))
    base = rents.where(f"building_structure = 'rc' AND {value} > 0").select(*PLACE, F.lit(True).alias("based")).distinct()
    marked = wanted.join(made, KEY, "left").join(base, PLACE, "left")
    return marked.groupBy(F.coalesce("outcome", F.when(F.col("based"), "no_ratio").otherwise("no_base")).alias("outcome")).agg(F.count("*").alias("n"))


def template(rows: DataFrame, structures: Iterable[str] = spec.STRUCTURES[:5], municipality_prefix: str = "", sources: Iterable[str] = (), layouts: Iterable[str] | None = None) -> DataFrame:
    """A row to fill in for each place, layout, source and structure, with the all-structure rent where one is known.

    With ``layouts`` the grid is full: every municipality with each of them and each source of its prefecture.
    """
    base = rows.where("building_structure = 'all' AND coalesce(prefecture, '') <> ''").where(F.startswith("municipality", F.lit(municipality_prefix)))
    sources = list(sources)
    if sources:
        base = base.where(F.exists(F.array(*map(F.lit, sources)), lambda s: F.contains("source_name", s)))
    known = last_by_key(base, [*PLACE, "source_name"], ["source_updated_at", "avg_rent_yen"], "avg_rent_yen")
    if layouts is not None:
        places = base.select("prefecture", "municipality").where("coalesce(municipality, '') <> ''").distinct().withColumn("layout_type", F.explode(F.array(*map(F.lit, layouts))))
        wanted = places.join(base.select("prefecture", "source_name").where("coalesce(source_name, '') <> ''").distinct(), "prefecture")
        known = wanted.join(known, [*PLACE, "source_name"], "left")
    return known.withColumn("building_structure", F.explode(F.array(*map(F.lit, structures)))).withColumnRenamed("avg_rent_yen", "base_rent_yen").select(*KEY, "source_name", "base_rent_yen")


def ordering(rents: DataFrame, low: str = "wood", high: str = "rc", value: str = "rent_yen") -> DataFrame:
    """Places where both structures are known, and whether the first is cheaper."""
    two = rents.groupBy(*PLACE).agg(*(F.max(F.when(F.col("building_structure") == s, F.col(value))).alias(f"{s}_rent") for s in (low, high)))
    return two.where(f"{low}_rent IS NOT NULL AND {high}_rent IS NOT NULL").withColumn("as_expected", F.col(f"{low}_rent") < F.col(f"{high}_rent"))


def summary(rows: DataFrame, notes: int = 3, order: tuple[str, ...] = ("collected_at", "source_updated_at")) -> DataFrame:
    """Rows, distinct sources and prefectures, the latest dates and the first distinct notes of a data set, in one row.

    Notes are taken by where they appear first in ``order``; a date of fewer than eight characters is none.
    """
    named = lambda c: F.array_join(F.array_sort(F.collect_set(F.nullif(c, F.lit("")))), ",").alias(f"{c}s".replace("source_name", "source"))
    latest = lambda c: F.max(F.when(F.length(c) >= 8, F.col(c))).alias(f"latest_{c}")
    figures = rows.agg(F.count("*").alias("n_rows"), named("source_name"), named("prefecture"), latest("source_updated_at"), latest("collected_at"))
    first = rows.where("coalesce(method_notes, '') <> ''").groupBy("method_notes").agg(F.min(F.struct(*order)).alias("at")).orderBy("at", "method_notes").limit(notes)
    said = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "method_notes"))), lambda x: x["method_notes"]), ",").alias("notes"))
    return figures.crossJoin(said)  # one row each


def counts_by_structure(rows: DataFrame) -> DataFrame:
    return rows.groupBy("building_structure").agg(F.count("*").alias("n_rows")).orderBy(F.desc("n_rows"), "building_structure")


def closest_place(asked: DataFrame, known: DataFrame) -> DataFrame:
    """For each asked municipality the known one of its prefecture that is contained in it, or contains it, closest in length."""
    fits = names.either_contains(asked, known.select("prefecture", F.col("municipality").alias("known")), "municipality", "known", ("prefecture",))
    return fits.groupBy("prefecture", "municipality").agg(F.min_by("known", F.struct(F.abs(F.length("municipality") - F.length("known")), "known")).alias("known"))


def keyword_code(name: Column, table: list[tuple[str, str]]) -> Column:
    """The code of the first keyword of an ordered table that a name holds."""
    chain = F
    for keyword, code in table:
        chain = chain.when(F.contains(name, F.lit(keyword)), code)
    return F.lit(None).cast("string") if chain is F else chain


def page_budget(rows: DataFrame, structures: Iterable[str], least: int = spec.MIN_SAMPLES) -> DataFrame:
    """Rows up to the page of each search on which every structure has ``least`` rows; all pages where that never happens."""
    per_page = rows.groupBy(*PLACE, "page", "building_structure").agg(F.count("*").alias("own"))
    running = per_page.withColumn("so_far", F.sum("own").over(Window.partitionBy(*PLACE, "building_structure").orderBy("page")))
    reached = running.where(F.col("building_structure").isin(list(structures))).groupBy(*PLACE, "building_structure").agg(F.min(F.when(F.col("so_far") >= least, F.col("page"))).alias("page"))
    stop = reached.groupBy(*PLACE).agg(F.when(F.count("page") == len(list(structures)), F.max("page")).alias("stop_page"))
    return rows.join(stop, PLACE, "left").where("stop_page IS NULL OR page <= stop_page").drop("stop_page")


def report_lines(missing_rows: DataFrame, spark: SparkSession) -> DataFrame:
    """The missing combinations as lines of a Markdown table."""
    head = spark.createDataFrame([(0, "| Prefecture | Municipality | Layout | Structure |"), (1, "|---|---|---|---|")], "rank int, value string")
    body = missing_rows.select(F.lit(2).alias("rank"), F.concat(F.lit("| "), F.concat_ws(" | ", *KEY), F.lit(" |")).alias("value"))
    return head.union(body).orderBy("rank", "value").select("value")


def summary_lines(rows: DataFrame, missing_rows: DataFrame, as_of: str, structures: Iterable[str] = spec.STRUCTURES[:5]) -> DataFrame:
    """A summary of a collection as lines of Markdown, in order (``rank``, ``value``): rows, missing combinations, rows of each structure."""
    names = list(structures)
    counts = rows.agg(F.count("*").alias("n"), *(F.count_if(F.col("building_structure") == s).alias(f"n_{s}") for s in names)).join(missing_rows.agg(F.count("*").alias("missing")))  # one row each
    lines = ["# Data collection summary", "", f"**Date:** {as_of}", F.concat(F.lit("**Rows:** "), F.col("n")), F.concat(F.lit("**Missing combinations:** "), F.col("missing")), "", "## Rows by structure", *(F.concat(F.lit(f"- **{s}:** "), F.col(f"n_{s}")) for s in names)]
    listed = F.array(*(line if isinstance(line, Column) else F.lit(line) for line in lines))
    return counts.select(F.posexplode(listed).alias("rank", "value"))
