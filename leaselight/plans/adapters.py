"""Listings, market rows and offers as projections of the star-schema test tables.

Each is one SELECT that Spark and DuckDB both run, so queries and their oracles start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF_YEAR = 2001
_PREFECTURE = "CASE r_regionkey WHEN 0 THEN 'saitama' WHEN 1 THEN 'tokyo' WHEN 2 THEN 'chiba' WHEN 3 THEN 'kanagawa' ELSE 'osaka' END"
_LAYOUT = "CASE {k} % 4 WHEN 0 THEN '1R' WHEN 1 THEN '1K' WHEN 2 THEN '1DK' ELSE '1LDK' END"
_STRUCTURE = "CASE {k} % 6 WHEN 0 THEN 'wood' WHEN 1 THEN 'light_steel' WHEN 2 THEN 'steel' WHEN 3 THEN 'rc' WHEN 4 THEN 'src' ELSE '{last}' END"
_ORIENTATION = "CASE {k} % 9 WHEN 0 THEN 'N' WHEN 1 THEN 'NE' WHEN 2 THEN 'E' WHEN 3 THEN 'SE' WHEN 4 THEN 'S' WHEN 5 THEN 'SW' WHEN 6 THEN 'W' WHEN 7 THEN 'NW' ELSE 'UNKNOWN' END"

MARKET = f"""
SELECT {_PREFECTURE} AS prefecture, n_name AS municipality, {_LAYOUT.format(k='p_partkey')} AS layout_type,
  {_STRUCTURE.format(k='p_size', last='all')} AS building_structure, CAST(round(l_extendedprice) AS BIGINT) AS avg_rent_yen,
  concat('source', CAST(l_linenumber AS STRING)) AS source_name, substr(CAST(l_shipdate AS STRING), 1, 10) AS source_updated_at,
  concat(substr(CAST(l_shipdate AS STRING), 1, 8), '2', CAST(l_linenumber AS STRING)) AS collected_at, s_name AS method_notes,
  l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, p_size, year(l_shipdate) AS ship_year, l_tax
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey JOIN {{supplier}} ON l_suppkey = s_suppkey
  JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey"""

SUBJECTS = f"""
SELECT o_orderkey AS listing_id, CASE WHEN o_orderkey % 11 = 0 THEN 'other' ELSE 'shinjuku' END AS hub_station,
  CASE WHEN o_orderkey % 22 = 0 THEN 'Elsewhere' END AS hub_station_other_name,
  {_PREFECTURE} AS prefecture, n_name AS municipality, concat('Station ', CAST(o_custkey % 50 AS STRING)) AS nearest_station_name,
  o_orderkey % 31 AS station_walk_min, {_LAYOUT.format(k='o_orderkey')} AS layout_type, {_STRUCTURE.format(k='o_custkey', last='other')} AS building_structure,
  CAST(12 + o_orderkey % 40 AS DOUBLE) AS area_sqm, CAST(year(o_orderdate) - o_orderkey % 45 AS BIGINT) AS building_built_year,
  {_ORIENTATION.format(k='o_orderkey')} AS orientation, o_orderkey % 3 = 0 AS bathroom_toilet_separate,
  CAST(round(o_totalprice / 4) AS BIGINT) AS rent_yen, CAST(round(o_totalprice / 4 * (o_orderkey % 5) / 100) AS BIGINT) AS mgmt_fee_yen,
  CAST(round(o_totalprice / 4 * (2 + o_orderkey % 6)) AS BIGINT) AS initial_cost_total_yen,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(round(o_totalprice / 4) AS BIGINT) END AS shikikin_yen,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(round(o_totalprice / 4 * (o_orderkey % 5)) AS BIGINT) END AS reikin_yen,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(round(o_totalprice / 8) AS BIGINT) END AS brokerage_fee_yen,
  CASE WHEN o_orderkey % 6 = 0 THEN CAST(o_orderkey % 150000 AS BIGINT) END AS other_initial_fees_yen,
  CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 37 AS BIGINT) END AS contract_term_months,
  CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey % 200000 AS BIGINT) END AS early_termination_penalty_yen
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey"""

OFFERS = f"""
SELECT prefecture, municipality, layout_type, CASE building_structure WHEN 'all' THEN NULL ELSE building_structure END AS building_structure,
  avg_rent_yen AS rent_yen, CAST(round(avg_rent_yen * l_tax) AS BIGINT) AS admin_fee_yen, l_quantity AS area_sqm, CAST(p_size % 31 AS BIGINT) AS walk_min,
  CAST({AS_OF_YEAR} - ship_year AS BIGINT) AS building_age_years, {_ORIENTATION.format(k='l_partkey')} AS orientation,
  CASE l_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS bathroom_toilet_separate,
  CASE l_partkey % 3 WHEN 0 THEN 'mansion' WHEN 1 THEN 'apartment' END AS building_type,
  concat('Station ', CAST(l_partkey % 50 AS STRING)) AS station_name, l_linenumber AS page, l_orderkey * 1000000 + l_partkey AS pos
FROM ({{market}}) AS m"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "pages", "conversations", "benchmark")


def sql(name: str) -> str:
    """The SELECT over plain table names, for DuckDB."""
    names = {t: t for t in TABLES}
    text = {"market": MARKET, "subjects": SUBJECTS, "offers": OFFERS}[name]
    return text.format(**names, market=MARKET.format(**names))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same SELECT in Spark."""
    if name == "offers":
        return spark.sql(OFFERS.replace("({market})", "{market}"), market=frame(spark, sf_dir, "market"))
    text = {"market": MARKET, "subjects": SUBJECTS}[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in text})
