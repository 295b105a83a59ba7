"""Bundles of spec documents: reading, and checks that what they refer to is declared.

A bundle is a row for each part (``bundle``, ``part``, ``document``: JSON text): ``S1`` fields, ``S2`` scoring, ``C1``
report templates, ``D1`` benchmark, ``V0`` vocabulary.  Every check is one of two kinds.  References are
rows (bundle, code, place, name, and the kinds of declaration that may explain the name); those
without a declaration are findings.  Shapes are conditions on a value.  So the checks of any number of bundles
are two projections and a join.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The files of a bundle, and that which holds all of them.
FILES = {"S1": "S1_InputSchema.json", "S2": "S2_ScoringSpec.json", "C1": "C1_ReportTemplates.json", "D1": "D1_BenchmarkSpec.json"}
WHOLE = "spec_bundle.json"
CONTEXT = ["input", "derived", "scoring", "grades", "field"]

_VARS = r'"var":\[?"([^"]+)"'
_PLACEHOLDERS = r"\{([A-Za-z0-9_]+)\}"


def newest(folders: Iterable[str], chosen: str | None = None) -> str | None:
    """The folder to read: the one that is chosen by hand, else that of the highest version at the end of its name."""
    version = lambda f: tuple(map(int, re.findall(r"\d+", re.search(r"v?([\d.]+)/?$", f)[1])))
    known = [f for f in folders if re.search(r"\d/?$", f)]
    return chosen or os.environ.get("SPEC_BUNDLE_DIR") or max(known, key=version, default=None)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The parts of the bundle in a folder: of its one file, or else of a file for each part; Spark lists and reads them, so any store will do."""
    files = spark.read.text(f"{folder.rstrip('/')}/*.json", wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1).alias("file"), F.col("value").alias("document"))
    named = F.create_map(*(F.lit(v) for part, file in FILES.items() for v in (file, part)))
    whole = files.where(F.col("file") == WHOLE)
    parts = [whole.select(F.lit(p).alias("part"), F.get_json_object("document", f"$.{p}").alias("document")) for p in (*FILES, "V0")]
    loose = files.withColumn("part", F.try_element_at(named, F.col("file"))).where("part IS NOT NULL").select("part", "document")
    found = loose if whole.isEmpty() else functools.reduce(DataFrame.union, parts).where("document IS NOT NULL")
    return found.select(F.lit(folder).alias("bundle"), "part", "document")


def write(spark: SparkSession, folder: str, files: dict[str, str]) -> None:
    """A few documents as files of a folder, through Spark's file systems."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name, document in files.items():
        where = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
        out = where.getFileSystem(conf).create(where, True)
        out.write(bytearray(document.encode()))
        out.close()


def merged(parts: DataFrame) -> DataFrame:
    """One JSON document for each bundle with all its parts."""
    pair = F.concat(F.lit('"'), "part", F.lit('":'), "document")
    return parts.groupBy("bundle").agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(pair)), ","), F.lit("}")).alias("document"))  # a bundle has five parts


def _of(parts: DataFrame, part: str) -> DataFrame:
    return parts.where(F.col("part") == part).select("bundle", F.try_parse_json("document").alias("d"))


def _items(parts: DataFrame, part: str, path: str) -> DataFrame:
    """(``bundle``, ``place``, ``x``) for the items of an array."""
    spread = _of(parts, part).select("bundle", F.posexplode(F.try_variant_get("d", f"$.{path}", "array<variant>")).alias("i", "x"))
    return spread.select("bundle", F.concat(F.lit(f"{part}.{path}["), F.col("i").cast("string"), F.lit("]")).alias("place"), "x")


def _text(path: str = "") -> Column:
    return F.array(F.try_variant_get("x", f"${path}", "string"))


def _all(path: str, pattern: str) -> Column:
    """What a pattern finds in the JSON text of a value."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.to_json(F.try_variant_get("x", f"${path}", "variant")), F.lit(pattern), F.lit(1))))


def _keys(path: str) -> Column:
    return F.map_keys(F.try_variant_get("x", f"${path}", "map<string,variant>"))


def _bare(names: Column) -> Column:
    return F.transform(names, lambda p: F.regexp_replace(p, "[{}]", ""))


def declared(parts: DataFrame) -> DataFrame:
    """(``bundle``, ``kind``, ``name``) of everything that a bundle declares."""
    rows = [_items(parts, "S1", "fields").select("bundle", F.lit("field").alias("kind"), F.explode(_text(".key")).alias("name"))]
    vocabulary = _of(parts, "V0").withColumnRenamed("d", "x")
    rows += [vocabulary.select("bundle", F.lit(kind).alias("kind"), F.explode(_keys(f".keys.{kind}")).alias("name")) for kind in CONTEXT if kind != "field"]
    enums = vocabulary.select("bundle", F.explode(F.try_variant_get("x", "$.enums", "map<string,array<string>>")).alias("kind", "names"))
    rows.append(enums.select("bundle", F.concat(F.lit("enum:"), "kind").alias("kind"), F.explode("names").alias("name")))
    rows.append(_items(parts, "V0", "report_placeholders").select("bundle", F.lit("placeholder").alias("kind"), F.explode(_bare(_text())).alias("name")))
    rows.append(_items(parts, "C1", "placeholders").select("bundle", F.lit("declared placeholder").alias("kind"), F.explode(_bare(_text())).alias("name")))
    rows.append(_items(parts, "V0", "risk_flags").select("bundle", F.lit("risk flag").alias("kind"), F.explode(_text(".id")).alias("name")))
    return functools.reduce(DataFrame.union, rows).where("name IS NOT NULL").distinct()


def referred(parts: DataFrame) -> DataFrame:
    """(``bundle``, ``severity``, ``code``, ``place``, ``name``, ``kinds``) of every name that must be declared."""
    table = [  # part, array, names, code, severity, kinds
        ("S1", "fields", _text(".key"), "V0_KEY", "error", ["input"]),
        ("S1", "mvp_required_fields", _text(), "V0_KEY", "error", ["input"]),
        ("S2", "features", _text(".input_key"), "INPUT_KEY_UNKNOWN", "error", ["field", "derived"]),
        ("S2", "risk_flag_rules", _all(".when", _VARS), "JSONLOGIC_VAR", "error", CONTEXT),
        ("S2", "tradeoff_rules", _all(".when", _VARS), "JSONLOGIC_VAR", "error", CONTEXT),
        ("S2", "what_if_rules", _all(".enabled_if", _VARS), "JSONLOGIC_VAR", "error", CONTEXT),
        ("S2", "risk_flag_rules", _text(".outputs.risk_flag_id"), "RISK_FLAG_ID", "error", ["risk flag"]),
        ("S2", "risk_flag_rules", _text(".outputs.severity"), "SEVERITY", "error", ["enum:severity"]),
        ("S2", "grade_thresholds.overall", _text(".grade"), "GRADE_ENUM", "error", ["enum:grade"]),
        ("D1", "coverage.prefectures", _text(), "ENUM", "error", ["enum:prefecture"]),
        ("D1", "coverage.layout_types", _text(), "ENUM", "error", ["enum:layout_type"]),
        ("D1", "coverage.hub_stations", _text(), "ENUM", "error", ["enum:hub_station"]),
        ("D1", "fallback_policy", _text(".benchmark_confidence"), "ENUM", "error", ["enum:benchmark_confidence"]),
        ("C1", "placeholders", _bare(_text()), "PLACEHOLDER_V0", "error", ["placeholder"]),
        ("C1", "rules", _all("", _PLACEHOLDERS), "PLACEHOLDER_UNDECLARED", "error", ["declared placeholder"]),
        ("C1", "rules", _all(".when", _VARS), "JSONLOGIC_VAR", "warn", CONTEXT),
        ("C1", "rules", _keys(".risk_flag_explanations_ko"), "RISK_FLAG_ID", "error", ["risk flag"]),
    ]
    rows = [
        _items(parts, part, path).select("bundle", F.lit(severity).alias("severity"), F.lit(code).alias("code"), "place", F.explode(names).alias("name"), F.array(*map(F.lit, kinds)).alias("kinds"))
        for part, path, names, code, severity, kinds in table
    ]
    return functools.reduce(DataFrame.union, rows).where("name IS NOT NULL")


def misshapen(parts: DataFrame) -> DataFrame:
    """Conditions that are no objects, lists that are none, and notes that do not belong into a contract."""
    rows = []
    for part, path, where, needed in (("S2", "risk_flag_rules", "when", False), ("S2", "tradeoff_rules", "when", False), ("S2", "what_if_rules", "enabled_if", False), ("C1", "rules", "when", True)):
        kind = F.schema_of_variant(F.try_variant_get("x", f"$.{where}", "variant"))
        wrong = ~F.startswith(kind, F.lit("OBJECT")) if not needed else F.coalesce(~F.startswith(kind, F.lit("OBJECT")), F.lit(True))
        rows.append(_items(parts, part, path).where(wrong).select("bundle", F.lit("WHEN_NOT_OBJECT").alias("code"), "place", F.lit(where).alias("name")))
    rows.append(_items(parts, "S1", "fields").where(F.try_variant_get("x", "$.key", "string") == "qa_notes").select("bundle", F.lit("QA_NOTES").alias("code"), "place", F.lit("qa_notes").alias("name")))
    for part, path in (("S1", "fields"), ("S2", "features"), ("C1", "rules")):
        kind = F.coalesce(F.schema_of_variant(F.try_variant_get("d", f"$.{path}", "variant")), F.lit("VOID"))
        rows.append(_of(parts, part).where(~F.startswith(kind, F.lit("ARRAY"))).select("bundle", F.lit("NO_ARRAY").alias("code"), F.lit(f"{part}.{path}").alias("place"), F.lit(path).alias("name")))
    return functools.reduce(DataFrame.union, rows).select("bundle", F.lit("error").alias("severity"), "code", "place", "name")


def findings(parts: DataFrame) -> DataFrame:
    """(``bundle``, ``severity``, ``code``, ``place``, ``name``): names that nobody declares, and wrong shapes."""
    wanted = referred(parts).withColumn("kind", F.explode("kinds")).join(declared(parts), ["bundle", "kind", "name"], "left_semi").select("bundle", "code", "place", "name").distinct()
    return referred(parts).drop("kinds").join(wanted, ["bundle", "code", "place", "name"], "left_anti").select("bundle", "severity", "code", "place", "name").union(misshapen(parts))


def report(found: DataFrame) -> DataFrame:
    """One JSON document for each bundle that has findings: how many errors and warnings, and what they are."""
    said = F.struct("severity", "code", "place", "name")
    by = found.groupBy("bundle").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warn").alias("warnings"), F.array_sort(F.collect_list(said)).alias("issues"))
    return by.select("bundle", F.to_json(F.struct("errors", "warnings", "issues")).alias("document"))
