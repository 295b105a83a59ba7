"""JSON rules compiled to boolean columns.

A rule is an object of one operator and its operands.  Comparisons follow the
rule language, not SQL: null equals null, differs from all else, and is neither
less nor greater than anything.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, functions as F


class RuleError(ValueError):
    """A rule that cannot be compiled."""


_ORDER: dict[str, Callable[[Column, Column], Column]] = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}


def _operands(rule: Any) -> tuple[str, list[Any]]:
    if not isinstance(rule, dict) or len(rule) != 1:
        raise RuleError(f"not a rule: {rule!r}")
    name, value = next(iter(rule.items()))
    return name, value if isinstance(value, list) else [value]


def value(node: Any, columns: Iterable[str]) -> Column:
    """A literal, or a variable: dots go into structs; an unknown name is its default, else null."""
    if isinstance(node, dict) and "var" in node:
        name, *default = _operands(node)[1]
        known = name.split(".")[0] in set(columns)
        found = F.col(name) if known else F.lit(None)
        return F.coalesce(found, F.lit(default[0])) if default and known else F.lit(default[0]) if default else found
    if isinstance(node, dict):
        return compile_rule(node, columns)
    if isinstance(node, list):
        raise RuleError("a list is no single value")
    return F.lit(node)


def compile_rule(rule: Any, columns: Iterable[str]) -> Column:
    """The rule as a column that is true or false, never null."""
    columns = set(columns)
    if isinstance(rule, bool):
        return F.lit(rule)
    name, args = _operands(rule)
    if name in ("and", "or"):
        if not args:
            raise RuleError(f"{name} needs operands")
        return functools.reduce(Column.__and__ if name == "and" else Column.__or__, (compile_rule(a, columns) for a in args))
    if name == "!":
        return ~compile_rule(args[0], columns)
    if name == "in":
        needle, hay = value(args[0], columns), args[1]
        if isinstance(hay, list):
            return F.coalesce(needle.isin(*[h for h in hay if h is not None]), F.lit(False)) | (needle.isNull() if None in hay else F.lit(False))
        text = value(hay, columns)
        return F.coalesce(F.contains(text, needle), F.lit(False))
    if name == "var":
        return F.coalesce(value(rule, columns).cast("boolean"), F.lit(False))
    if len(args) != 2:
        raise RuleError(f"{name} takes two operands")
    a, b = value(args[0], columns), value(args[1], columns)
    if name == "==":
        return a.eqNullSafe(b)
    if name == "!=":
        return ~a.eqNullSafe(b)
    if name in _ORDER:
        return F.coalesce(_ORDER[name](a, b), F.lit(False))
    raise RuleError(f"unknown operator {name!r}")


def rule_vars(rule: Any) -> set[str]:
    """All variables that a rule reads."""
    if isinstance(rule, list):
        return set().union(*map(rule_vars, rule))
    if not isinstance(rule, dict):
        return set()
    name, args = _operands(rule)
    return {args[0]} if name == "var" else rule_vars(args)


def is_always_true(rule: Any) -> bool:
    return rule is True or rule == {"==": [1, 1]}


def first_match(rules: Iterable[tuple[Column, Any]], otherwise: Any = None) -> Column:
    """The value of the first rule, in this order, that holds."""
    chain = F
    for condition, result in rules:
        chain = chain.when(condition, result)
    return F.lit(otherwise) if chain is F else chain.otherwise(otherwise)


def select_rule(rules: Iterable[tuple[str, int, Any]], columns: Iterable[str]) -> Column:
    """The id of the matching rule of greatest priority; rules that always hold only serve where no other does."""
    ordered = sorted(rules, key=lambda r: (is_always_true(r[2]), -r[1]))
    return first_match((compile_rule(condition, columns), name) for name, _, condition in ordered)
