"""Listings as they arrive: the same columns as in bulk, over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import spec
from ..operators import validate
from ..plans import engine


def read_listings(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of listings from JSON lines that arrive as files."""
    return spark.readStream.schema(spec.subject_schema()).option("maxFilesPerTrigger", files_per_trigger).json(path)


def scored(listings: DataFrame, index: DataFrame, as_of_year: int) -> DataFrame:
    """Valid listings, evaluated against an index that stands still; no state is kept."""
    return engine.evaluate(validate.validate(listings).where("valid").drop("errors", "first_error", "valid"), index, as_of_year)


def write_scored(evaluated: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return engine.response(evaluated).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rents_by_day(rows: DataFrame, time_col: str, late: str = "2 days") -> DataFrame:
    """Running count and mean rent by day and place of arriving market rows; rows later than ``late`` are left out."""
    return rows.withWatermark(time_col, late).groupBy(F.window(time_col, "1 day"), "prefecture").agg(F.count("*").alias("n_rows"), F.avg("avg_rent_yen").alias("mean_rent_yen")).select(F.col("window.start").alias("day"), "prefecture", "n_rows", "mean_rent_yen")
