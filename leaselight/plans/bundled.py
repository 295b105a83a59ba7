"""Evaluation by bundles: every listing follows the rules, bands and texts of the bundle that it names.

Bundles are read as data (``operators.bundles``: a row for each part) and compiled to
columns.  A listing is measured once, whatever its bundle; scores, grades, flags and
texts are then picked by the bundle's name within the same projection, so any number of
listings of any mixture of bundles takes one pass, and a bundle costs expressions only.
Bundles of equal content share their expressions.  Texts come in all languages that a
bundle has, as maps.

Edge cases: a listing whose bundle is null or unknown has measures but no scores, flags
or texts; a bundle without a part has no rules of that kind; a rule that cannot be read
is an error that names the bundle.  The content of all bundles is held on the driver, up
to ``MOST_BUNDLES`` different ones.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rules, scoring
from ..operators import report
from . import engine

MOST_BUNDLES = 200
_FLAGS = "array<struct<risk_flag_id: string, severity: string>>"
#: Texts of a template: what they are called in a bundle, before the language, and whether there are several.
TEXTS = {"summary": ("summary_", False), "evidence": ("evidence_bullets_", True), "negotiation": ("negotiation_suggestions_", True), "queries": ("alternative_search_queries_", True)}


class BundleError(ValueError):
    """A bundle that cannot be compiled."""


@dataclass(frozen=True)
class Plan:
    """The content of a bundle, in the shapes that the compilers of rules and features take."""

    features: list[dict[str, Any]] = field(default_factory=list)
    weights: dict[str, float] = field(default_factory=dict)
    bands: dict[str, list[list[Any]]] = field(default_factory=dict)
    flags: list[tuple[str, int, Any, str, str]] = field(default_factory=list)
    tradeoffs: list[tuple[int, Any, str]] = field(default_factory=list)
    templates: list[tuple[str, int, Any, dict[str, dict[str, Any]]]] = field(default_factory=list)


def _feature(f: dict[str, Any], shift: float) -> dict[str, Any]:
    given = f.get("params") or {}
    params: dict[str, Any] = {"default": given.get("default_score", 70)}
    if f["method"] == "bucket":
        params["buckets"] = given["buckets"]
        if given.get("apply_foreigner_adjustment") == "im_shift_months":
            params["shift"] = shift
    elif f["method"] == "linear":
        params |= {"x": [given["min_x"], given["max_x"]], "y": [given["min_score"], given["max_score"]], "clamp": given.get("clamp", False), "higher_is_better": given.get("direction", "higher_is_better") == "higher_is_better"}
    elif f["method"] == "lookup":
        params["table"] = given.get("table") or {}
    elif f["method"] == "boolean":
        params |= {"true": given["true_score"], "false": given["false_score"]}
    else:
        raise BundleError(f"unknown method {f['method']}")
    if "neutral_score_if_confidence_in" in given:
        params |= {"neutral_if": given["neutral_score_if_confidence_in"], "neutral_score": given.get("neutral_score", 70)}
    return {"component": f["component"], "input": f["input_key"], "method": f["method"], "weight": f.get("weight", 0.0), "params": params}


def _texts(rule: dict[str, Any]) -> dict[str, dict[str, Any]]:
    """By kind and language."""
    return {kind: {key.removeprefix(prefix): value for key, value in rule.items() if key.startswith(prefix)} for kind, (prefix, _) in TEXTS.items()}


def plan(documents: dict[str, str]) -> Plan:
    """The content of a bundle's parts ``S2`` and ``C1``."""
    s2, c1 = (json.loads(documents.get(p) or "{}") for p in ("S2", "C1"))
    shift = (s2.get("foreigner_adjustment") or {}).get("foreign_im_shift_months", 0.0)
    return Plan(
        [_feature(f, shift) for f in s2.get("features", [])],
        s2.get("weights", {}),
        {c: [[b["grade"], b["min_score"]] for b in bands] for c, bands in s2.get("grade_thresholds", {}).items()},
        [(r["id"], r.get("priority", 0), r["when"], r["outputs"]["risk_flag_id"], r["outputs"]["severity"]) for r in s2.get("risk_flag_rules", [])],
        [(r.get("priority", 0), r["when"], r["outputs"]["tradeoff_tag"]) for r in s2.get("tradeoff_rules", [])],
        [(r["id"], r.get("priority", 0), r["when"], _texts(r)) for r in c1.get("rules", []) if r.get("when") is not None],
    )


def plans(parts: DataFrame) -> list[tuple[list[str], Plan]]:
    """Names of bundles with equal content, and that content."""
    documents: dict[str, dict[str, str]] = {}
    for r in parts.where(F.col("part").isin("S2", "C1")).select("bundle", "part", "document").limit(2 * MOST_BUNDLES + 1).collect():
        documents.setdefault(r["bundle"], {})[r["part"]] = r["document"]
    if len(documents) > MOST_BUNDLES:
        raise BundleError(f"more than {MOST_BUNDLES} bundles at once")
    same: dict[str, list[str]] = {}
    for name in sorted(documents):
        same.setdefault(json.dumps(documents[name], sort_keys=True), []).append(name)
    out = []
    for content, names in same.items():
        try:
            out.append((names, plan(json.loads(content))))
        except (ValueError, KeyError, TypeError) as e:
            raise BundleError(f"bundle {names[0]}: {e}") from e
    return out


def _routed(all_plans: list[tuple[list[str], Plan]], make: Callable[[Plan], Column], kind: str) -> Column:
    """What the plan of a row's bundle makes of it; null without one."""
    chain = F.when(F.lit(False), F.lit(None).cast(kind))
    for names, own in all_plans:
        chain = chain.when(F.col("bundle").isin(names), make(own).cast(kind))
    return chain


def _first(rows: list[tuple[Column, Column]], kind: str) -> Column:
    chain = F.when(F.lit(False), F.lit(None).cast(kind))
    for when, value in rows:
        chain = chain.when(when, value)
    return chain


def _component(own: Plan, name: str, columns: list[str]) -> Column:
    scored = [(scoring.feature(f, columns), f["weight"]) for f in own.features if f["component"] == name]
    return scoring.rounded(scoring.component(scored, divide=True)) if scored else F.lit(70.0)


def _spoken(df: DataFrame, texts: dict[str, Any], several: bool) -> Column:
    """A map from language to the rendered text or texts."""
    made = lambda t: F.array(*(report.rendered(df, x) for x in t)).cast("array<string>") if several else report.rendered(df, t)
    kind = "map<string, array<string>>" if several else "map<string, string>"
    pairs = [c for language in sorted(texts) for c in (F.lit(language), made(texts[language] or ([] if several else "")))]
    return (F.create_map(*pairs) if pairs else F.create_map().cast(kind)).cast(kind)


def scored(measured: DataFrame, all_plans: list[tuple[list[str], Plan]]) -> DataFrame:
    """Add component scores, the overall score, and all four grades."""
    columns = measured.columns
    step = measured.withColumns({f"{c}_score": _routed(all_plans, lambda p, c=c: _component(p, c, columns), "double") for c in scoring.COMPONENTS})
    total = lambda p: scoring.rounded(functools.reduce(Column.__add__, (F.col(f"{c}_score") * float(p.weights.get(c, 0.0)) for c in scoring.COMPONENTS)))
    step = step.withColumn("overall_score", _routed(all_plans, total, "double"))
    return step.withColumns({f"{c}_grade": _routed(all_plans, lambda p, c=c: scoring.grade(F.col(f"{c}_score"), p.bands.get(c, [])), "string") for c in (*scoring.COMPONENTS, "overall")})


def reported(df: DataFrame, all_plans: list[tuple[list[str], Plan]]) -> DataFrame:
    """Add flags, trade-off and template, and its texts by language: ``summary``, ``evidence``, ``negotiation``, ``queries``."""
    columns = df.columns
    compiled = lambda when: rules.compile_rule(when, columns)
    step = df.withColumns({
        "risk_flags": _routed(all_plans, lambda p: report.risk_flags(columns, p.flags) if p.flags else F.array(), _FLAGS),
        "tradeoff_tag": _routed(all_plans, lambda p: _first([(compiled(w), F.lit(tag)) for _, w, tag in sorted(p.tradeoffs, key=lambda r: r[0])], "string"), "string"),
        "template_id": _routed(all_plans, lambda p: _first([(compiled(t[2]), F.lit(t[0])) for t in sorted(p.templates, key=lambda t: -t[1])], "string"), "string"),
    })

    def spoken(kind: str, several: bool) -> Column:
        cast = "map<string, array<string>>" if several else "map<string, string>"
        return _routed(all_plans, lambda p: _first([(F.col("template_id") == t[0], _spoken(df, t[3][kind], several)) for t in p.templates], cast), cast)

    return step.withColumns({kind: spoken(kind, several) for kind, (_, several) in TEXTS.items()})


def evaluate(subjects: DataFrame, index: DataFrame, as_of_year: int, parts: DataFrame) -> DataFrame:
    """``engine.evaluate`` of ``subjects`` with a column ``bundle``, by the bundles of ``parts``."""
    all_plans = plans(parts)
    measured = engine.measured(subjects, index, as_of_year)
    return reported(scored(measured, all_plans), all_plans)
