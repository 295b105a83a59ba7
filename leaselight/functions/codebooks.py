"""Codes of search forms: intervals and names to codes and back, as data, and the URLs that are built from them.

A codebook of limits has an ascending list of upper limits with a code for each: a value
is written as the code of the first limit that is not below it, and a code is read as its
limit.  A codebook of names has a code for each name; several names may share one, which
is then read as the first of them.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..spec import LAYOUTS
from . import text


@dataclass(frozen=True)
class Limits:
    """Upper limits and their codes, ascending."""

    steps: tuple[tuple[float, str], ...]

    def code(self, value: Column) -> Column:
        """The code of the first limit not below the value; null beyond the last."""
        listed = F.array(*(F.struct(F.lit(float(limit)).alias("limit"), F.lit(code).alias("code")) for limit, code in self.steps))
        return F.get(F.filter(listed, lambda s: s["limit"] >= value), F.lit(0))["code"]

    def limit(self, code: Column) -> Column:
        """The limit of a code; null for one that is not in the book."""
        return F.try_element_at(F.create_map(*(c for limit, name in self.steps for c in (F.lit(name), F.lit(float(limit))))), code)


@dataclass(frozen=True)
class Names:
    """Names and their codes; ``other`` is the code of any name that is not listed, ``none`` are names that ask for nothing."""

    codes: Mapping[str, str]
    other: str | None = None
    none: tuple[str, ...] = ()

    def code(self, name: Column) -> Column:
        listed = F.try_element_at(F.create_map(*(F.lit(v) for pair in self.codes.items() for v in pair)), name)
        return F.when(name.isNotNull() & ~name.isin(*self.none, ""), F.coalesce(listed, F.lit(self.other)))

    def name(self, code: Column) -> Column:
        first: dict[str, str] = {}
        for name, own in self.codes.items():
            first.setdefault(own, name)
        return F.try_element_at(F.create_map(*(F.lit(v) for pair in first.items() for v in pair)), code)


#: Codes of one provider's search form.
WALK = Limits(((1, "1"), (3, "2"), (5, "3"), (7, "4"), (10, "5"), (15, "6"), (20, "7")))
AGE = Limits(((0, "0"), (1, "1"), (3, "2"), (5, "3"), (7, "3.5"), (10, "4"), (15, "5"), (20, "6"), (25, "7"), (30, "8")))
STRUCTURE = Names({"rc": "1", "src": "1", "steel": "2", "light_steel": "2", "wood": "3"}, other="4", none=("all", "other"))
LAYOUT = Names(dict(zip(("1R", "1K", "1DK", "1LDK", "2K", "2DK", "2LDK", "3K", "3DK", "3LDK", "4K", "4DK", "4LDK"), "0123456789ABC")))
ROWS_ON_A_PAGE, WITH_FEES, BATH_PATH = "50", "1", "bath-toilet"


def list_url(base: Column, layout: Column, page: Column | None = None, area_low: Column | None = None, area_high: Column | None = None, walk: Column | None = None, age: Column | None = None, structure: Column | None = None, bath: Column | None = None) -> Column:
    """The URL of a result list with conditions, from one of that place (its path up to ``list``); null if it is none or the layout has no code.

    Conditions that are null, or beyond what the form knows, are left out.
    """
    given = lambda c: F.lit(None) if c is None else c
    whole = lambda c: given(c).cast("bigint").cast("string")
    place = text.found(base, "^([^?#]*?/list)(?:[/?#]|$)")
    steps = F.concat_ws("/", place, F.when(given(bath).cast("boolean"), BATH_PATH), F.when(given(page).cast("bigint") > 1, F.concat(F.lit("page"), whole(page))))
    asked = {"m": LAYOUT.code(F.upper(layout)), "rt": F.lit(ROWS_ON_A_PAGE), "k": F.lit(WITH_FEES), "sf": whole(area_low), "st": whole(area_high), "j": WALK.code(given(walk)), "h": AGE.code(given(age)), "kz": STRUCTURE.code(given(structure).cast("string"))}
    query = F.array_join(F.array_compact(F.array(*(F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), v)) for k, v in asked.items()))), "&")
    return F.when(place.isNotNull() & asked["m"].isNotNull(), F.concat(steps, F.lit("/?"), query))


def list_conditions(url: Column) -> Column:
    """What a result list's URL asks for: the inverse of ``list_url`` as far as codes tell."""
    asked = lambda name: text.found(url, f"[?&]{name}=([^&#]+)")
    return F.struct(
        text.area_code(url).alias("area_code"), LAYOUT.name(asked("m")).alias("layout_type"), text.number(asked("sf")).alias("area_low"), text.number(asked("st")).alias("area_high"), WALK.limit(asked("j")).alias("walk_max"), AGE.limit(asked("h")).alias("age_max"),
        STRUCTURE.name(asked("kz")).alias("structure"), F.contains(url, F.lit(f"/{BATH_PATH}/")).alias("bath"), F.coalesce(text.found(url, "/page([0-9]+)/").try_cast("bigint"), F.lit(1)).alias("page"),
    )


def first_source(asked: DataFrame, sources: DataFrame, mark: str, layouts: tuple[str, ...] = tuple(LAYOUTS)) -> DataFrame:
    """``asked`` (``prefecture``, ``municipality``, ``layout_type``) with the ``source_url`` that holds ``mark``, of its own layout, else of the first of ``layouts`` that has one.

    ``sources`` has these columns, ``source_url`` and ``pos``; of several URLs the first by ``pos`` serves.
    """
    place = ["prefecture", "municipality"]
    known = sources.where(F.contains("source_url", F.lit(mark))).groupBy(*place, F.upper("layout_type").alias("__layout")).agg(F.min_by("source_url", F.struct("pos", "source_url")).alias("source_url"))
    wanted = asked.select(*place, "layout_type").distinct()
    ranked = wanted.withColumn("__rows", F.array_distinct(F.array(F.upper("layout_type"), *map(F.lit, layouts)))).select("*", F.posexplode("__rows").alias("__rank", "__layout"))
    best = ranked.join(known, [*place, "__layout"]).groupBy(*place, "layout_type").agg(F.min_by("source_url", "__rank").alias("source_url"))
    return asked.join(best, [*place, "layout_type"], "left")
