"""Declarative features compiled to columns: scores from 0 to 100, components, overall, grades."""

from __future__ import annotations

import functools
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, functions as F

COMPONENTS = ("location", "condition", "cost")


def rounded(x: Column, places: int = 6) -> Column:
    """Rounded; ties, which sums of doubles blur anyway, go up."""
    return F.bround(x + 1e-9, places)


def bucket(x: Column, params: dict[str, Any]) -> Column:
    """The first bucket, in list order, that holds the value."""
    chain = F
    for b in params["buckets"]:
        chain = chain.when(x <= b["max"] if "max" in b else x >= b["min"], F.lit(float(b["score"])))
    return chain.otherwise(float(params["default"]))


def linear(x: Column, params: dict[str, Any]) -> Column:
    (x0, x1), (y0, y1) = params["x"], params["y"]
    if x0 == x1:
        return F.lit(float(params["default"]))
    share = (x - float(x0)) / float(x1 - x0)
    if params.get("clamp"):
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    share = share if params.get("higher_is_better", True) else 1.0 - share
    return share * float(y1 - y0) + float(y0)


def lookup(x: Column, params: dict[str, Any]) -> Column:
    table = F.create_map(*(F.lit(v) for k, s in params["table"].items() for v in (k, float(s))))
    return F.coalesce(F.try_element_at(table, x), F.lit(float(params["default"])))


def boolean(x: Column, params: dict[str, Any]) -> Column:
    return F.when(x, float(params["true"])).otherwise(float(params["false"]))


METHODS = {"bucket": bucket, "linear": linear, "lookup": lookup, "boolean": boolean}


def feature(spec: dict[str, Any], columns: Iterable[str], confidence: str = "benchmark_confidence", null_policy: str = "skip") -> Column:
    """One feature's score; null where its input is (``skip``) or the default (``default``).

    A feature that is neutral at this confidence is so even where its input is null.
    """
    params, columns = spec["params"], set(columns)
    x = F.col(spec["input"]) if spec["input"] in columns else F.lit(None).cast("double")
    if params.get("shift"):
        x = F.greatest(F.lit(0.0), x - float(params["shift"]))
    missing = F.lit(None).cast("double") if null_policy == "skip" else F.lit(float(params.get("default", 70)))
    score = F.when(x.isNull(), missing).otherwise(METHODS[spec["method"]](x, params))
    if "neutral_if" in params and confidence in columns:
        score = F.when(F.col(confidence).isin(params["neutral_if"]), float(params["neutral_score"])).otherwise(score)
    return score


def component(scored: Iterable[tuple[Column, float]], divide: bool = False) -> Column:
    """Weighted sum, scaled up for features without a score; 70 if none has one.

    The sum is scaled to the weight of all features; ``divide`` by that weight gives a mean.
    """
    scored = list(scored)
    add = lambda parts: functools.reduce(Column.__add__, parts)
    total = sum(w for _, w in scored)
    had = add(F.when(s.isNotNull(), w).otherwise(0.0) for s, w in scored)
    value = add(F.coalesce(s * w, F.lit(0.0)) for s, w in scored) * F.lit(1.0 if divide else total)
    return F.when(had > 0, value / had).otherwise(70.0)


def component_scores(spec: dict[str, Any], columns: Iterable[str], null_policy: str = "skip") -> dict[str, Column]:
    return {c: component((feature(f, columns, null_policy=null_policy), f["weight"]) for f in spec["features"] if f["component"] == c) for c in COMPONENTS}


def overall(weights: dict[str, float]) -> Column:
    return rounded(functools.reduce(Column.__add__, (F.col(f"{c}_score") * weights[c] for c in COMPONENTS)))


def grade(score: Column, bands: list[list[Any]]) -> Column:
    """The highest band that the score reaches, else D."""
    chain = F
    for name, least in sorted(bands, key=lambda b: -b[1]):
        chain = chain.when(score >= least, name)
    return F.lit("D") if chain is F else chain.otherwise("D")
