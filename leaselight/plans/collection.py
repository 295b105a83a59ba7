"""From result pages to market rows: rooms read, medians where there are enough, rows merged with what is known, gaps reported."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from .. import spec
from ..operators import documents, market
from ..scratch import cut


def collect(pages: DataFrame, source_name: str, collected_at: str, structures: Iterable[str] = spec.STRUCTURES[:5], least: int = spec.MIN_SAMPLES) -> DataFrame:
    """Market rows (``market.ROW``) of pages that were found for a place and layout (``prefecture``, ``municipality``, ``layout_type``, ``url``, ``html``, and ``page`` where results have several).

    Of each search only the pages up to that count on which every structure has ``least`` rooms.  Challenge pages give none.
    """
    paged = pages if "page" in pages.columns else pages.withColumn("page", F.lit(1))
    # the search goes with the page, so that pages are read once and met with nothing
    place = {**{c: f"found_{c}" for c in market.PLACE}, "page": "page"}
    rooms = documents.collected_rents(paged.where("html IS NOT NULL"), tuple(structures), place)
    found = rooms.select("building_structure", F.col("rent_yen").alias("avg_rent_yen"), *(F.col(name).alias(c) for c, name in place.items()))
    medians = market.collected(market.page_budget(cut(found), structures, least), least)  # asked for twice, and pages are to be read once
    return medians.select(
        F.lit("JP").alias("region_country"), *market.KEY, F.col("median_rent_yen").alias("avg_rent_yen"), F.lit(source_name).alias("source_name"), F.lit(None).cast("string").alias("source_url"),
        F.lit(collected_at).alias("source_updated_at"), F.lit(collected_at).alias("collected_at"), F.concat(F.lit("median of "), F.col("n_rows"), F.lit(" rooms")).alias("method_notes"),
    )


def extended(existing: DataFrame, pages: DataFrame, source_name: str, collected_at: str, least: int = spec.MIN_SAMPLES) -> tuple[DataFrame, DataFrame]:
    """The market rows with those that pages add, and the combinations of known places that nothing covers then."""
    # both are asked for more than once, and pages are to be read once
    merged = market.merge(cut(existing), cut(collect(pages, source_name, collected_at, least=least)))
    return merged, market.missing(market.grid(merged), merged)
