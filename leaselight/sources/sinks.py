"""Writers of market rows, indexes, reports and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import bundles, market


def write_market_rows(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows as JSON lines and as CSV with header, fields in their fixed order, both gzipped."""
    ordered = rows.select(*(F.col(c) for c in market.ROW))
    ordered.write.mode(mode).option("compression", "gzip").json(f"{path}/json")
    ordered.write.mode(mode).option("header", True).option("escape", '"').option("compression", "gzip").csv(f"{path}/csv")


def append_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).csv(path)


def write_index(index: DataFrame, path: str) -> None:
    """The index, parted by level so that a lookup of one level reads that level only."""
    index.write.mode("overwrite").partitionBy("level").parquet(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines of a report in their order, in one file: reports are for reading, and short."""
    lines.coalesce(1).write.mode("overwrite").text(path)


def write_bundles(parts: DataFrame, path: str) -> None:
    """Each bundle as one document, and beside it a report of what does not hold together."""
    bundles.merged(parts).write.mode("overwrite").json(f"{path}/merged")
    bundles.report(bundles.findings(parts)).write.mode("overwrite").json(f"{path}/coherence")


def write_answers(response: DataFrame, path: str) -> None:
    """Nested answers, one JSON object a line."""
    response.write.mode("overwrite").json(path)


def append_once(rows: DataFrame, path: str, batch: str) -> None:
    """Append a batch that has a name: given again, it takes its own place instead of standing there twice.

    A batch is one folder below ``path`` and is replaced as a whole, so readers see it or do not.
    """
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/batch={batch}")


def write_regression(golden: DataFrame, findings: DataFrame, path: str) -> None:
    """One document of a golden run: how many inputs, how often each flag and template came up, and what the gate found."""
    hits = lambda rows, key: F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias(rows)
    flags = golden.select(F.explode("risk_flags.risk_flag_id").alias("id")).groupBy("id").agg(F.count("*").alias("n")).agg(hits("risk_flag_hits", "id"))
    templates = golden.groupBy(F.col("template_id").alias("id")).agg(F.count("*").alias("n")).agg(hits("template_hits", "id"))
    listed = findings.agg(F.array_sort(F.collect_list(F.struct("code", "name"))).alias("findings"))
    whole = golden.agg(F.count("*").alias("inputs")).join(flags).join(templates).join(listed)  # one row each
    whole.select(F.struct("inputs", "risk_flag_hits", "template_hits", "findings").alias("summary")).coalesce(1).write.mode("overwrite").json(path)
