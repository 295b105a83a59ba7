"""Which fields of a form are shown, as others' values tell, and rows without what is hidden.

A field may depend on another: it is shown while that one has a value (``equals``) or has
not (``not_equals``).  A null is no value: it equals nothing but a null that is asked for.
The dependencies are a graph; ``chained`` walks it level by level, so that a field
is hidden with the one that it hangs on.  Without that, only the value counts, shown or
not, as forms do that keep what was typed.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Field:
    """A field, the one that it depends on, and what that must or must not be."""

    key: str
    on: str | None = None
    value: Any = None
    negated: bool = False


def declared(fields: Iterable[dict[str, Any]]) -> list[Field]:
    """Fields of an input schema (``key``, ``depends_on``: ``key`` with ``equals`` or ``not_equals``)."""
    out = []
    for f in fields:
        on = f.get("depends_on") or {}
        told = "equals" in on or "not_equals" in on
        out.append(Field(f["key"], on["key"] if told else None, on.get("equals", on.get("not_equals")), "equals" not in on and told))
    return out


def levels(fields: list[Field]) -> tuple[list[list[Field]], list[str]]:
    """Fields by how many they hang on, one below the other, and the keys of those in cycles, or below one, which have no level."""
    out, left = [], list(fields)
    while left:
        waiting = {f.key for f in left}
        now = [f for f in left if f.on not in waiting]
        if not now:
            return out, sorted(waiting)
        out.append(now)
        left = [f for f in left if f.on in waiting]
    return out, []


def shown(fields: list[Field], columns: Iterable[str], chained: bool = False) -> dict[str, Column]:
    """For each field whether it is shown; one that depends on a column that is not there sees a null."""
    ordered, cycle = levels(fields)
    if chained and cycle:
        raise ValueError(f"fields depend on one another: {', '.join(cycle)}")
    have, out = set(columns), {}
    for f in [f for level in ordered for f in level] + [f for f in fields if f.key in cycle]:
        if f.on is None:
            out[f.key] = F.lit(True)
            continue
        value = F.col(f.on) if f.on in have else F.lit(None).cast("string")
        if chained and f.on in out:
            value = F.when(out[f.on], value)
        same = value.eqNullSafe(F.lit(f.value))
        out[f.key] = ~same if f.negated else same
    return {f.key: out[f.key] for f in fields}


def visible_fields(df: DataFrame, fields: list[Field], chained: bool = False, out: str = "visible") -> DataFrame:
    """Add the keys of the fields that each row shows, in their order."""
    return df.withColumn(out, F.array_compact(F.array(*(F.when(c, k) for k, c in shown(fields, df.columns, chained).items()))))


def pruned(df: DataFrame, fields: list[Field], chained: bool = False) -> DataFrame:
    """Hidden fields as null."""
    return df.withColumns({k: F.when(c, F.col(k)) for k, c in shown(fields, df.columns, chained).items() if k in df.columns})


def missing(df: DataFrame, fields: list[Field], required: Iterable[str] = (), chained: bool = False, out: str = "missing") -> DataFrame:
    """Add the keys of fields that are shown and have no value though they are required; one that depends on another is, while it is shown."""
    wanted = set(required) | {f.key for f in fields if f.on is not None}
    blank = lambda k: F.coalesce(F.trim(F.col(k).cast("string")), F.lit("")) == "" if k in df.columns else F.lit(True)
    return df.withColumn(out, F.array_compact(F.array(*(F.when(c & blank(k), k) for k, c in shown(fields, df.columns, chained).items() if k in wanted))))
