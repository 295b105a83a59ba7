"""Validation of listings and of rule content against what is declared."""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import spec
from ..functions import rules, text

#: Types that a JSON value may have for each declared type, as Spark names a variant's type.
_JSON_TYPES = {"integer": ("BIGINT",), "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "boolean": ("BOOLEAN",), "string": ("STRING",), "enum": ("STRING",)}


def field_errors(columns: Iterable[str], fields: list[tuple] = spec.FIELDS) -> list[Column]:
    """One column for each rule: null, or ``rule:key``; in the order in which a reader would find them.

    Maxima of amounts of money are declared for input forms only and not enforced.
    """
    columns = set(columns)
    out = []
    for key, *_ in (f for f in fields if f[0] not in columns and f[2]):
        out.append(F.lit(f"missing:{key}"))
    known = [f for f in fields if f[0] in columns]
    out += [F.when(F.col(key).isNull(), f"missing:{key}") for key, _, required, *_ in known if required]
    if {"hub_station", "hub_station_other_name"} <= columns:
        out.append(F.when((F.col("hub_station") == "other") & (F.coalesce(F.trim("hub_station_other_name"), F.lit("")) == ""), "missing:hub_station_other_name"))
    for key, _, _, least, most, allowed, unit in known:
        if allowed:
            out.append(F.when(~F.col(key).isin(allowed), f"enum:{key}"))
        if least is not None:
            out.append(F.when(F.col(key) < least, f"min:{key}"))
        if most is not None and unit != "yen":
            out.append(F.when(F.col(key) > most, f"max:{key}"))
    return out


def validate(df: DataFrame, fields: list[tuple] = spec.FIELDS) -> DataFrame:
    """Add ``errors``, ``first_error`` (null if none) and ``valid``."""
    found = df.withColumn("errors", F.array_compact(F.array(*field_errors(df.columns, fields))))
    return found.withColumns({"first_error": F.get("errors", F.lit(0)), "valid": F.size("errors") == 0})


def visible(df_columns: Iterable[str]) -> Column:
    """The optional fields that a form shows for a row: one of them hangs on another's value."""
    return F.when(F.col("hub_station") == "other", F.array(F.lit("hub_station_other_name"))).otherwise(F.array().cast("array<string>")) if "hub_station" in set(df_columns) else F.array().cast("array<string>")


def parse_payloads(df: DataFrame, json_col: str = "payload", fields: list[tuple] = spec.FIELDS) -> DataFrame:
    """Typed listings from JSON texts: the declared columns, and ``payload_errors`` for what is unreadable, unknown or of another type.

    An explicit null is of another type, too; only a key that is absent is missing.
    """
    keys = [f[0] for f in fields]
    parsed = df.withColumn("__v", F.try_parse_json(json_col)).withColumn("__keys", F.json_object_keys(json_col))
    unknown = F.transform(F.array_sort(F.array_except("__keys", F.array(*map(F.lit, keys)))), lambda k: F.concat(F.lit("unknown:"), k))

    def mistyped(key: str, kind: str) -> Column:
        made = F.schema_of_variant(F.try_variant_get("__v", f"$.{key}", "variant"))
        fits = F.lit(False)
        for name in _JSON_TYPES[kind]:
            fits = fits | F.startswith(made, F.lit(name))
        return F.when(F.array_contains("__keys", key) & ~F.coalesce(fits, F.lit(False)), f"type:{key}")

    errors = F.when(F.col("__v").isNull() | F.col("__keys").isNull(), F.array(F.lit("unreadable"))).otherwise(F.concat(unknown, F.array_compact(F.array(*(mistyped(k, kind) for k, kind, *_ in fields)))))
    schema = spec.subject_schema()
    values = {k: F.try_variant_get("__v", f"$.{k}", schema[k].dataType.simpleString()) for k in keys}
    return parsed.withColumns({"payload_errors": errors} | values).drop("__v", "__keys")


def checked(df: DataFrame, row_rules: dict[str, dict[str, Any]]) -> DataFrame:
    """Add ``schema_errors`` by declared rules for each column: required, const, enum, minLength, pattern, minimum, maximum, minItems, maxItems."""
    tests = {
        "required": lambda c, v: c.isNull() if v else F.lit(False),
        "const": lambda c, v: c != F.lit(v),
        "enum": lambda c, v: ~c.isin(v),
        "minLength": lambda c, v: F.length(c) < v,
        "pattern": lambda c, v: ~F.rlike(c, F.lit(v)),
        "minimum": lambda c, v: c < v,
        "maximum": lambda c, v: c > v,
        "minItems": lambda c, v: F.size(c) < v,
        "maxItems": lambda c, v: F.size(c) > v,
    }
    wrong = [F.when(tests[rule](F.col(name), value), f"{rule}:{name}") for name, own in row_rules.items() for rule, value in own.items()]
    return df.withColumn("schema_errors", F.array_compact(F.array(*wrong)) if wrong else F.array().cast("array<string>"))


_NONE = "array<string>"


def _parts(columns: list[Column]) -> Column:
    return F.concat(F.array().cast(_NONE), *columns)


def _finding(condition: Column, rule: str, path: Column) -> Column:
    """One finding where the condition is known to hold, else none."""
    return F.when(condition, F.array(F.concat(F.lit(f"{rule}:"), path))).otherwise(F.array().cast(_NONE))


def _pointed(root: dict[str, Any], ref: str) -> Any:
    """The part of a schema that a local reference names."""
    node: Any = root
    for part in ref.removeprefix("#").strip("/").split("/"):
        node = node.get(part.replace("~1", "/").replace("~0", "~")) if isinstance(node, dict) else None
    return node if ref.startswith("#") else None


def schema_findings(value: Column, schema: dict[str, Any], path: Column | None = None, root: dict[str, Any] | None = None, depth: int = 32) -> Column:
    """What is wrong with a variant ``value`` by a JSON schema, as an array of ``rule:path``.

    The schema is known when the plan is made, so each keyword becomes an expression: $ref (local), allOf, if/then, type,
    enum, const, minLength, pattern, minimum, maximum, minItems, maxItems, items, required, properties and
    additionalProperties.  A value of another type is not looked into; a reference that names nothing, or
    leads through ``depth`` others, is a finding itself.
    """
    path, root = F.lit("$") if path is None else path, schema if root is None else root
    inner = lambda v, s, p: schema_findings(v, s, p, root, depth - 1)
    if "$ref" in schema:
        target = _pointed(root, schema["$ref"])
        return inner(value, target, path) if isinstance(target, dict) and depth else F.array(F.concat(F.lit("$ref:"), path))
    head = [inner(value, part, path) for part in schema.get("allOf", [])]
    if "if" in schema and "then" in schema:
        head.append(F.when(F.size(inner(value, schema["if"], path)) == 0, inner(value, schema["then"], path)).otherwise(F.array().cast(_NONE)))

    def judged(named: Column, members: Column) -> Column:
        is_kind = {
            "object": F.startswith(named, F.lit("OBJECT")), "array": F.startswith(named, F.lit("ARRAY")), "string": named == "STRING", "boolean": named == "BOOLEAN", "null": named == "VOID",
            "integer": (named == "BIGINT") | F.rlike(named, F.lit(r"^DECIMAL\([0-9]+,0\)$")), "number": (named == "BIGINT") | F.startswith(named, F.lit("DECIMAL")) | named.isin("DOUBLE", "FLOAT"),
        }
        kinds = schema.get("type", [])
        kinds = [kinds] if isinstance(kinds, str) else kinds
        fits = F.lit(not kinds)
        for kind in kinds:
            fits = fits | is_kind[kind]

        rest, as_json = [], lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"))
        said, number = F.to_json(value), F.try_variant_get(value, "$", "double")
        word, items = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "array<variant>")
        if "enum" in schema:
            rest.append(_finding(~said.isin([as_json(x) for x in schema["enum"]]), "enum", path))
        if "const" in schema:
            rest.append(_finding(said != as_json(schema["const"]), "const", path))
        bounds = {"minLength": ("string", lambda n: F.length(word) < n), "pattern": ("string", lambda p: ~F.rlike(word, F.lit(p))), "minimum": ("number", lambda n: number < n), "maximum": ("number", lambda n: number > n), "minItems": ("array", lambda n: F.size(items) < n), "maxItems": ("array", lambda n: F.size(items) > n)}
        rest += [_finding(is_kind[kind] & test(schema[rule]), rule, path) for rule, (kind, test) in bounds.items() if rule in schema]
        if isinstance(schema.get("items"), dict):
            each = F.transform(items, lambda x, i: inner(x, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
            rest.append(F.when(is_kind["array"], F.flatten(each)).otherwise(F.array().cast(_NONE)))
        below = lambda key: F.concat(path, F.lit("."), key)
        known, more = schema.get("properties", {}), schema.get("additionalProperties", True)
        rest += [_finding(is_kind["object"] & ~F.map_contains_key(members, F.lit(key)), "required", below(F.lit(key))) for key in schema.get("required", [])]
        rest += [F.when(is_kind["object"] & F.map_contains_key(members, F.lit(key)), inner(F.try_element_at(members, F.lit(key)), own, below(F.lit(key)))).otherwise(F.array().cast(_NONE)) for key, own in known.items()]
        if more is False or isinstance(more, dict):
            strange = F.array_sort(F.array_except(F.map_keys(members), F.array(*map(F.lit, known)).cast(_NONE)))
            found = F.transform(strange, lambda k: F.concat(F.lit("additional:"), below(k))) if more is False else F.flatten(F.transform(strange, lambda k: inner(F.try_element_at(members, k), more, below(k))))
            rest.append(F.when(is_kind["object"], found).otherwise(F.array().cast(_NONE)))
        return F.when(fits, _parts(rest)).otherwise(F.array(F.concat(F.lit("type:"), path)))

    # what a value is, and its members, are told once and not for each keyword and each member below
    told = {"named": F.schema_of_variant(value), "members": F.try_variant_get(value, "$", "map<string,variant>")}
    return _parts([*head, text.bound(F.struct(*(c.alias(k) for k, c in told.items())), lambda v: judged(v["named"], v["members"]))])


def checked_by_schema(df: DataFrame, schema: dict[str, Any], json_col: str = "payload") -> DataFrame:
    """Add ``findings`` of JSON texts by a schema; a text that is no JSON has the one finding ``unreadable:$``."""
    value = F.try_parse_json(json_col)
    return df.withColumn("__v", value).withColumn("findings", F.when(F.col("__v").isNull(), F.array(F.lit("unreadable:$"))).otherwise(schema_findings(F.col("__v"), schema))).drop("__v")


#: Names that rules and texts may use: inputs, measures, scores and grades.
DERIVED = ["monthly_fixed_cost_yen", "building_age_years", "initial_multiple", "initial_multiple_market_delta", "initial_multiple_market_delta_foreigner", "rent_delta_ratio", "benchmark_confidence", "area_access_score_0_100"]


def vocabulary(spark: SparkSession) -> DataFrame:
    scores = [f"{c}_{k}" for c in ("location", "condition", "cost", "overall") for k in ("score", "grade")]
    return spark.createDataFrame([(n,) for n in dict.fromkeys([f[0] for f in spec.FIELDS] + DERIVED + scores)], "name string")


def references(spark: SparkSession) -> DataFrame:
    """Every name that the rule content reads: (``part``, ``rule_id``, ``name``)."""
    from . import report

    rows = [("feature", f["id"], f["input"]) for f in spec.SCORING["features"]]
    rows += [("risk", r[0], v) for r in spec.RISK_RULES for v in sorted(rules.rule_vars(r[2]))]
    rows += [("tradeoff", r[0], v) for r in spec.TRADEOFF_RULES for v in sorted(rules.rule_vars(r[2]))]
    rows += [("whatif", r[0], v) for r in spec.WHATIF_RULES for v in sorted(rules.rule_vars(r[1]) | {r[3]})]
    rows += [("template", t[0], v) for t in spec.TEMPLATES for v in sorted(rules.rule_vars(t[2]))]
    rows += [("text", t[0], v) for t in spec.TEMPLATES for text in (t[3], *t[4], *t[5]) for v in report.placeholders(text)]
    return spark.createDataFrame(rows, "part string, rule_id string, name string")


def incoherent(used: DataFrame, known: DataFrame) -> DataFrame:
    """References to names that nobody declares."""
    return used.join(F.broadcast(known), "name", "left_anti").select("part", "rule_id", "name")
