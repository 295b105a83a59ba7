"""Readers of market rows, listings, pages, reports and stored indexes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import spec
from ..functions import text
from ..operators import benchmark, market


def _typed(raw: DataFrame) -> DataFrame:
    """Trimmed texts, whole rents, blank structures as ``all``; optional blanks become null."""
    have = {c: F.trim(F.col(c).cast("string")) for c in raw.columns}
    blank = lambda c: F.nullif(have.get(c, F.lit(None).cast("string")), F.lit(""))
    kinds = {"avg_rent_yen": text.whole_number(blank("avg_rent_yen")), "building_structure": F.coalesce(blank("building_structure"), F.lit("all"))}
    return raw.select(*(kinds.get(c, blank(c)).alias(c) for c in market.ROW))


def market_rows(spark: SparkSession, path: str) -> DataFrame:
    """Market rows from a JSON array (``.json``), JSON lines (``.jsonl``), a CSV with header or Parquet, by the path's suffix.

    The folders ``json`` and ``csv`` that ``sinks.write_market_rows`` makes are read as lines and as CSV.
    """
    kind = path.rstrip("/").replace("/", ".").rsplit(".", 1)[-1]
    if kind in ("json", "jsonl"):
        array = path.endswith(".json")
        return _typed(spark.read.schema(", ".join(f"{c} string" for c in market.ROW)).option("multiLine", array).json(path))
    if kind == "csv":
        return _typed(spark.read.option("header", True).option("escape", '"').csv(path))
    if kind == "parquet":
        return _typed(spark.read.parquet(path))
    raise ValueError(f"no reader for {path}")


def pasted_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """Market rows from CSV lines with or without header, of 11 fields or, without structure, 10; others are dropped."""
    full = ", ".join(f"{c} STRING" for c in market.ROW)
    short = [c for c in market.ROW if c != "building_structure"]
    bare = F.regexp_replace(column, '"[^"]*"', "")
    quoting = {"escape": '"'}  # a quote inside quotes stands twice
    # lines of both kinds in one pass; each is counted and read once, as the row of a generator that no condition passes
    counted = lines.where(~F.startswith(column, F.lit(market.ROW[0]))).select(F.col(column).alias("line"), F.size(F.split(bare, ",")).alias("n"))
    filled_in = text.bound(F.from_csv("line", ", ".join(f"{c} STRING" for c in short), quoting), lambda r: F.struct(*((r[c] if c in short else F.lit(None).cast("string")).alias(c) for c in market.ROW)))
    read = F.when(F.col("n") == 11, F.from_csv("line", full, quoting)).when(F.col("n") == 10, filled_in)
    rows = _typed(counted.select(F.explode(F.array(read)).alias("r")).where("r IS NOT NULL").select("r.*"))
    return rows.where("prefecture IS NOT NULL AND municipality IS NOT NULL AND layout_type IS NOT NULL AND avg_rent_yen IS NOT NULL")


def listings(spark: SparkSession, path: str) -> DataFrame:
    """Listings from JSON files, one object in each; the file's stem is the ``listing_id``."""
    keys = [f for f in spec.subject_schema().fields if f.name != "listing_id"]
    raw = spark.read.schema(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys)).option("multiLine", True).json(path)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return raw.select(stem.alias("listing_id"), *(f.name for f in keys))


def load_or_build_index(spark: SparkSession, path: str, raw: list[str], write: bool = True) -> DataFrame:
    """The stored index, else one built from the first raw file that can be read, stored for the next time."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        pass
    for candidate in raw:
        try:
            rows = market_rows(spark, candidate)
        except AnalysisException:
            continue
        index = benchmark.build_index(rows)
        if not write:
            return index
        index.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
    raise FileNotFoundError(f"no index at {path}, and none of {raw} can be read")


def missing_report(lines: DataFrame, column: str = "value") -> DataFrame:
    """Combinations named by the rows of a Markdown table: prefecture, municipality, layout, structure."""
    cells = F.split(F.regexp_replace(column, r"^\s*\|\s*|\s*\|\s*$", ""), r"\s*\|\s*")
    parts = lines.where(F.col(column).rlike(r"^\s*\|")).select(cells.alias("c")).where("size(c) >= 4")
    return parts.select(*(F.col("c")[i].alias(k) for i, k in enumerate(market.KEY))).where(F.col("layout_type").isin(spec.LAYOUTS))


def cached_pages(wanted: DataFrame, cache: DataFrame, fetch: tuple[str, ...] = ()) -> DataFrame:
    """Wanted pages, each once, from a store of earlier fetches, by the first 32 digits of the URL's digest; ``found`` tells whether the store has it, html is null where not.

    A store that has fetched a URL more than once names each fetch by the columns ``fetch``, which ``wanted`` has, too;
    of what else repeats there the least html counts.
    """
    keyed = wanted.withColumn("cache_key", cache_key(F.col("url")))
    keys = ["cache_key", *fetch]
    once = cache.groupBy(*keys).agg(F.min("html").alias("html"), F.lit(True).alias("__had")).withColumnsRenamed({k: f"__{k}" for k in keys})
    met = keyed.join(once, [keyed[k].eqNullSafe(once[f"__{k}"]) for k in keys], "left")
    return met.withColumn("found", F.coalesce("__had", F.lit(False))).select(*keyed.columns, "html", "found")


def cache_key(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 32)


def markdown_files(spark: SparkSession, path: str, analysis: tuple[str, ...] = ("analysis",), answers: tuple[str, ...] = ("answers",)) -> DataFrame:
    """Markdown documents with the kind that markers in their names give: integrated, analysis, answers or other."""
    docs = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return docs.withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1)).withColumn("kind", document_kind(F.col("name"), analysis, answers))


def document_kind(name: Column, analysis: tuple[str, ...], answers: tuple[str, ...]) -> Column:
    a, b = text.any_of(name, analysis), text.any_of(name, answers)
    return F.when(a & b, "integrated").when(a, "analysis").when(b, "answers").otherwise("other")
