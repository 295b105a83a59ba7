"""Comparable offers by a ladder of ever looser conditions, and the figure they give.

At each step a subject asks for limits, not for its own values.  Subjects with the
same limits in the same place get the same answer, so the ladder is climbed once for
each profile, not once for each subject.

No pair of a profile and an offer ever becomes a row.  Offers and profiles meet by place
and by what is asked of the station, a bucket of such groups in a task.  There profiles
that ask for the same values share a block of comparisons with the offers that have
them, and leave the ladder with the step that has found enough.  What is shuffled are
offers, once for each name of a station that somebody asks for and that theirs meets, and
profiles: both grow with the input.  A place with a station is the largest unit of a task.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .. import spec
from ..scratch import cut, few, shuffled
from ..functions import text
from . import names

STEPS = 4
#: Bucket limits of walking minutes and building ages.
WALK_BUCKETS = (1, 3, 5, 7, 10, 15, 20)
AGE_BUCKETS = (1, 3, 5, 7, 10, 15, 20, 25, 30)
LINES_WALK_BUCKETS = (3, 5, 7, 10, 15, 20, 30)
AREA_GRID = tuple(range(10, 105, 5))

#: The last step at which a dialect applies a condition (STEPS - 1: always).
LADDERS: dict[str, dict[str, int]] = {
    "cassette": {"area": 3, "age": 3, "walk": 3, "station": 3, "building_type": 1, "orientation": 0, "structure": 1, "bath": 2},
    "block": {"area": 1, "age": 2, "walk": 0, "station": 1, "orientation": 0, "structure": 1, "bath": 1},
    "lines": {"area": 3, "age": 3, "walk": 3, "station": 3, "orientation": 0, "structure": 1, "bath": 2},
}


def area_low(area: Column, step: int) -> Column:
    return F.greatest(F.lit(0), F.floor(area / 5) * 5 - 5 * step)


def area_high(area: Column, step: int) -> Column:
    return F.floor(area / 5) * 5 + 5 + 5 * step


def next_bucket(x: Column, buckets: tuple[int, ...], step: int) -> Column:
    """The first limit not below ``x``, moved up by ``step`` as far as there are limits; null beyond the last."""
    fitting = F.filter(F.array(*map(F.lit, buckets)), lambda b: b >= x)
    return F.when(F.size(fitting) > 0, fitting[F.least(F.lit(step), F.size(fitting) - 1)])


def snap_floor(x: Column, grid: tuple[int, ...] = AREA_GRID) -> Column:
    return F.array_max(F.filter(F.array(*map(F.lit, grid)), lambda g: g <= x))


def snap_ceil(x: Column, grid: tuple[int, ...] = AREA_GRID) -> Column:
    return F.array_min(F.filter(F.array(*map(F.lit, grid)), lambda g: g >= x))


def segment_area(x: Column) -> Column:
    return F.when(x < 15, "lt15").when(x < 20, "15_19").when(x < 25, "20_24").when(x < 30, "25_29").otherwise("ge30")


def segment_age(x: Column) -> Column:
    return F.when(x <= 5, "0_5").when(x <= 10, "6_10").when(x <= 20, "11_20").otherwise("ge21")


def segment_walk(x: Column) -> Column:
    return F.when(x <= 5, "le5").when(x <= 10, "6_10").when(x <= 15, "11_15").otherwise("ge16")


def age_limit(age: Column, step: int) -> Column:
    return F.greatest(F.lit(5), F.ceil(age / 5) * 5) + 5 * step


#: What a subject asks of offers at a step; null: nothing.
WANTED = {"area_low": "double", "area_high": "double", "age_max": "bigint", "walk_low": "bigint", "walk_high": "bigint", "station": "string", "building_type": "string", "orientation": "string", "structure": "string", "bath": "boolean"}


def wanted(dialect: str, step: int) -> Column:
    """The limits of a step as one struct of ``WANTED``: bucket limits, not the subject's own values."""
    area, age, walk = F.col("area_sqm"), F.col("building_age_years"), F.col("station_walk_min")
    by_structure = F.when(F.col("building_structure").isin("rc", "src", "steel"), "mansion").when(F.col("building_structure").isin("wood", "light_steel"), "apartment")
    cassette = dialect == "cassette"
    walk_high = next_bucket(walk, WALK_BUCKETS, step) if cassette else next_bucket(walk, LINES_WALK_BUCKETS, 0) + 5 * step if dialect == "lines" else walk + 3
    asked = {
        "area": {"area_low": area_low(area, step), "area_high": area_high(area, step)},
        "age": {"age_max": next_bucket(age, AGE_BUCKETS, step) if cassette else age_limit(age, step)},
        "walk": {"walk_low": walk - 3 if dialect == "block" else F.lit(None), "walk_high": walk_high},
        "station": {"station": F.nullif(F.col("nearest_station_name"), F.lit(""))},
        "building_type": {"building_type": by_structure},
        "orientation": {"orientation": F.nullif(F.col("orientation"), F.lit("UNKNOWN"))},
        "structure": {"structure": F.when(~F.col("building_structure").isin("other", "all", ""), F.col("building_structure"))},
        "bath": {"bath": F.col("bathroom_toilet_separate")},
    }
    limits = {k: v for name, last in LADDERS[dialect].items() if step <= last for k, v in asked[name].items()}
    return F.struct(*(limits.get(k, F.lit(None)).cast(kind).alias(k) for k, kind in WANTED.items()))


PLACE = ["prefecture", "municipality", "layout_type"]
#: 128 bits that name a place and what is asked there; for 10**12 profiles two share a name with a chance of 10**-15.
PROFILE = ["profile", "profile_2"]
#: Conditions that ask for a value, and the column of an offer that has it.
EQUAL = {"orientation": "orientation", "structure": "building_structure", "bath": "bathroom_toilet_separate"}
#: Square metres of a class of area.
AREA_CLASS = 5


def asked(subjects: DataFrame, dialect: str, step: int) -> DataFrame:
    """``subjects`` with what they ask for at a step as ``want``, and a short name for that and the place (``PROFILE``)."""
    return _profiled(subjects.withColumn("want", wanted(dialect, step)))


def _profiled(subjects: DataFrame) -> DataFrame:
    absent = functools.reduce(Column.__add__, (F.col(f"want.{c}").isNull().cast("int") * 2**i for i, c in enumerate(WANTED)))  # hashes pass over nulls
    return subjects.withColumns({"profile": F.xxhash64(*PLACE, "want", absent), "profile_2": F.xxhash64(F.lit("second"), absent, *PLACE, "want")})


def _name(dialect: str, column: str) -> Column:
    """What of a station's name is compared: one dialect knows variants of writing, of widths and of names."""
    return text.station(text.nfkc(F.col(column))) if dialect == "cassette" else F.col(column)


def contained_pairs(wanted_names: DataFrame, offered_names: DataFrame, dialect: str = "lines") -> DataFrame:
    """Pairs (``station``, ``station_name``) of distinct names of which either contains the other; there are as many names as stations, however many offers."""
    own = cut(wanted_names.select("station").distinct().withColumn("own", _name(dialect, "station")))
    others = cut(offered_names.select("station_name").distinct().withColumn("other", _name(dialect, "station_name")))
    met = names.either_contains(own, others, "own", "other")
    return own.join(met, "own").join(others, "other").select("station", "station_name")


def station_pairs(subjects: DataFrame, offers: DataFrame, dialect: str) -> DataFrame:
    """``contained_pairs`` of what subjects ask for and offers have, written out."""
    return cut(contained_pairs(subjects.select(F.col("nearest_station_name").alias("station")), offers.select("station_name"), dialect))


#: 128 bits that name a place and what is asked there at all steps.
LADDER = ["ladder", "ladder_2"]
#: Limits of a step as numbers.
_LIMITS = ["area_low", "area_high", "age_max", "walk_low", "walk_high"]
#: Offers that a bucket of groups aims at, and comparisons made at once.
BUCKET_ROWS, AT_ONCE = 100_000, 2_000_000
_NULL = np.iinfo(np.int64).min


def _placed() -> Column:
    return functools.reduce(Column.__and__, (F.col(c).isNotNull() for c in PLACE))


def _group(station: Column) -> Column:
    """A number for a place and what is asked of the station there (null: nothing); zero where the place is not known."""
    return F.when(_placed(), F.when(station.isNull(), F.xxhash64(F.lit("anywhere"), *PLACE)).otherwise(F.xxhash64(*PLACE, station))).otherwise(F.lit(0))


def _code(value: Column) -> Column:
    return F.when(value.isNotNull(), F.xxhash64(value.cast("string")))


def laddered(subjects: DataFrame, dialect: str) -> DataFrame:
    """``subjects``, written out with what they ask for at each step (``want_0``..), and a name for all of it and the place (``LADDER``)."""
    wants = [f"want_{step}" for step in range(STEPS)]
    named = cut(subjects.withColumns({w: wanted(dialect, step) for step, w in enumerate(wants)}))  # each limit is used many times
    absent = [functools.reduce(Column.__add__, (F.col(f"{w}.{c}").isNull().cast("int") * 2**i for i, c in enumerate(WANTED))) for w in wants]  # hashes pass over nulls
    return named.withColumns({"ladder": F.xxhash64(*PLACE, *wants, *absent), "ladder_2": F.xxhash64(F.lit("second"), *absent, *PLACE, *wants)})


def profiles(subjects: DataFrame) -> DataFrame:
    """The distinct ladders of ``laddered`` subjects as numbers, with the ``station`` that they ask for."""
    limits = [F.col(f"want_{step}.{k}").cast("double").alias(f"{k}_{step}") for step in range(STEPS) for k in _LIMITS]
    values = [_code(F.col(f"want_0.{k}")).alias(k) for k in ("building_type", *EQUAL)]
    return subjects.select(*LADDER, *PLACE, F.col("want_0.station").alias("station"), *values, *limits).dropDuplicates(LADDER)


def candidates(keys: DataFrame, offers: DataFrame, pairs: DataFrame, anywhere: bool, named: bool) -> DataFrame:
    """Offers as numbers, once for each group (``keys`` has their ``key``) in which somebody asks: of the place (``anywhere``), and of the place with a station that theirs meets (``named``)."""
    known = offers.where(_placed()).withColumn("layout_type", F.upper("layout_type"))
    parts = [known.withColumn("key", _group(F.lit(None).cast("string")))] if anywhere else []
    parts += [known.join(few(pairs), "station_name").withColumn("key", _group(F.col("station"))).select("key", *known.columns)] if named else []
    of = functools.reduce(lambda a, b: a.unionByName(b), parts).join(few(keys), "key", "left_semi")
    whole = [F.col(c).cast("bigint").alias(c) for c in ("rent_yen", "admin_fee_yen", "page", *(("pos",) if "pos" in of.columns else ()))]
    real = [F.col(c).cast("double").alias(c) for c in ("area_sqm", "building_age_years", "walk_min")]
    read = ["detail_url", *(_code(F.col(f"told_{k}")).alias(f"told_{k}") for k in EQUAL)] if "detail_url" in of.columns else []
    return of.select("key", *whole, *real, _code(F.col("building_type")).alias("building_type"), *(_code(F.col(c)).alias(k) for k, c in EQUAL.items()), *read)


_ANSWER = T.StructType([*(T.StructField(c, T.LongType()) for c in LADDER), T.StructField("step", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("benchmark_yen", T.LongType()), T.StructField("method", T.StringType()), T.StructField("benchmark_rent_yen", T.LongType()), T.StructField("detail_n", T.LongType()), T.StructField("detail_matched_n", T.LongType()), T.StructField("last", T.BooleanType())])


def _whole(table: pa.Table, column: str) -> np.ndarray:
    return table[column].fill_null(int(_NULL)).to_numpy()


def _real(table: pa.Table, column: str) -> np.ndarray:
    return table[column].cast(pa.float64()).to_numpy().astype(float)


def _figures(found: np.ndarray, values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``robust_aggregate`` of the ``values`` that each row of ``found`` holds, as far as they are ``known``: the figure (NaN: none), how many there are, and whether it is a median."""
    order = np.flatnonzero(known)[np.argsort(values[known], kind="stable")]
    had, x = found[:, order], values[order].astype(float)
    if not len(order):
        none = np.zeros(len(found))
        return none + np.nan, none.astype(int), none > 0
    rank = np.cumsum(had, axis=1, dtype=np.int32)
    n = rank[:, -1].astype(np.int64)
    low, high = x[np.argmax(had, axis=1)], x[len(x) - 1 - np.argmax(had[:, ::-1], axis=1)]
    at = lambda k: x[np.minimum((rank < k[:, None]).sum(axis=1), len(x) - 1)]
    with np.errstate(divide="ignore", invalid="ignore"):
        wide = (n >= 3) & (low > 0) & (high / low > spec.OUTLIER_RATIO)
    picked = (low + high) / 2
    if wide.any():
        own = n[wide]
        rank = rank[wide]
        picked[wide] = at((own + 1) // 2) / 2 + at(own // 2 + 1) / 2
    return np.where(n > 0, np.rint(picked), np.nan), n, wide


class _Group:
    """Offers of a place, or of a place and what meets a station, in the order of what makes two of them one."""

    def __init__(self, had: pa.Table, least: int, quota: int | None, stop_pages: bool):
        self.least, self.quota, self.stop_pages = least, quota, stop_pages
        rent, fee, area = _whole(had, "rent_yen"), _whole(had, "admin_fee_yen"), _real(had, "area_sqm")
        order = np.lexsort((area, fee, rent))
        had = had.take(pa.array(order))
        self.rent, self.fee, self.area = rent[order], fee[order], area[order]
        same = np.nan_to_num(self.area, nan=-1e300)
        new = (np.diff(self.rent) != 0) | (np.diff(self.fee) != 0) | (np.diff(same) != 0)
        self.offer = np.cumsum(np.append(np.zeros(min(1, len(order)), np.int64), new))  # one number for offers that are one
        self.age, self.walk, self.page = _real(had, "building_age_years"), _real(had, "walk_min"), _whole(had, "page")
        self.kind, self.values = _whole(had, "building_type"), [_whole(had, k) for k in EQUAL]
        if quota:
            self.told, self.pos = [_whole(had, f"told_{k}") for k in EQUAL], _whole(had, "pos")
            urls = had["detail_url"].combine_chunks().dictionary_encode()
            ranks = np.empty(len(urls.dictionary), np.int64)
            ranks[np.array(urls.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)).argsort()] = np.arange(len(ranks))
            places = urls.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            self.url = np.where(places < 0, -1, ranks[places] if len(ranks) else -1)

    def within(self, rows: np.ndarray, limits: dict[str, np.ndarray]) -> np.ndarray:
        """For each profile which of ``rows`` are within its limits: those without a limit pass, and of asked ones a missing value fails."""
        wide = {k: v[:, None] for k, v in limits.items()}
        area, age, walk = self.area[rows], self.age[rows], self.walk[rows]
        out = np.isnan(wide["area_low"]) | ((area >= wide["area_low"]) & (area <= wide["area_high"]))
        out &= np.isnan(wide["age_max"]) | (age <= wide["age_max"])
        out &= np.isnan(wide["walk_high"]) | ((walk <= wide["walk_high"]) & (np.isnan(wide["walk_low"]) | (walk >= wide["walk_low"])))
        return out

    def step(self, kind: int, values: list[int], limits: dict[str, np.ndarray]) -> list[np.ndarray]:
        """Answers of a step for profiles that ask for one ``kind`` and ``values`` (``_NULL``: for none), by their limits."""
        of_kind = (self.kind == kind) | (self.kind == _NULL) if kind != _NULL else np.ones(len(self.kind), bool)
        complete = of_kind.copy()
        for want, have in zip(values, self.values):
            if want != _NULL:
                complete &= have == want
        rows = np.flatnonzero(complete)
        reading = self.quota and any(v != _NULL for v in values)
        listed = self.listed(of_kind, values) if reading else None
        n = len(limits["age_max"])
        out = [np.zeros(n, np.int64), np.full(n, np.nan), np.full(n, "none", object), np.full(n, np.nan), np.zeros(n, np.int64), np.zeros(n, np.int64)]
        by = max(1, AT_ONCE // max(1, len(rows), 0 if listed is None else len(listed[0])))
        for first in range(0, n, by):
            some = {k: v[first : first + by] for k, v in limits.items()}
            told = self.found(rows, some, listed)
            for whole, part in zip(out, told):
                whole[first : first + by] = part
        return out

    def found(self, rows: np.ndarray, limits: dict[str, np.ndarray], listed: tuple[np.ndarray, np.ndarray] | None) -> list[np.ndarray]:
        met = self.within(rows, limits)
        offers, starts = np.unique(self.offer[rows], return_index=True)
        one = met if len(starts) == len(rows) else np.logical_or.reduceat(met, starts, axis=1)
        if self.stop_pages and len(starts):
            one = self.up_to_page(met, rows, starts)
        at = rows[starts]
        more, detail_n, matched_n = [], np.zeros(len(met), np.int64), np.zeros(len(met), np.int64)
        if listed is not None:
            few = np.flatnonzero(one.sum(axis=1) < self.least)
            near = self.within(listed[0], {k: v[few] for k, v in limits.items()})
            for i, own in zip(few.tolist(), near):
                new, detail_n[i], matched_n[i] = self.read(set(offers[one[i]].tolist()), np.flatnonzero(own), *listed)
                more += [(i, row) for row in new]
        if more:  # what details have added stands beside the complete offers
            extra = np.zeros((len(one), len(more)), bool)
            extra[[i for i, _ in more], np.arange(len(more))] = True
            one, at = np.concatenate([one, extra], axis=1), np.concatenate([at, [row for _, row in more]])
        rent, fee = self.rent[at], self.fee[at]
        known = rent != _NULL
        total = np.where(known, rent + np.where(fee == _NULL, 0, fee), -1)
        value, n, median = _figures(one, total, known & (total >= 0))
        method = np.select([n == 0, n == 1, n == 2, median], ["none", "single", "mean", "median"], "midrange")
        return [one.sum(axis=1), value, method, _figures(one, rent, known & (rent >= 0))[0], detail_n, matched_n]

    def up_to_page(self, met: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Offers up to the page on which there are enough, as ``up_to_page`` of frames: those without a page come first, and are left out where one with a page ends it."""
        none, unmet = np.iinfo(np.int64).max - 1, np.iinfo(np.int64).max
        page = np.where(self.page[rows] == _NULL, none, self.page[rows])
        least = np.minimum.reduceat(np.where(met, page, unmet), starts, axis=1)  # a null is passed over by a minimum
        one = least != unmet
        ordered = np.sort(np.where(least == none, _NULL, least), axis=1)
        stop = ordered[:, self.least - 1] if ordered.shape[1] >= self.least else np.full(len(met), unmet)
        return one & (((stop == _NULL) | (stop == unmet))[:, None] | (least <= stop[:, None]))

    def listed(self, of_kind: np.ndarray, values: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Offers that lack some of the asked values and have the others, in the order in which details are read, and whether what their details tell fits."""
        lacks = [(have == _NULL) & (want != _NULL) for want, have in zip(values, self.values)]
        missing = np.sum(lacks, axis=0)
        fine = of_kind & (missing > 0) & (self.url >= 0)
        for want, have in zip(values, self.values):
            if want != _NULL:
                fine &= (have == want) | (have == _NULL)
        rows = np.flatnonzero(fine)
        area = np.nan_to_num(self.area, nan=-1e300)
        rows = rows[np.lexsort([x[rows] for x in (*lacks[::-1], area, self.fee, self.rent, self.url, self.pos, self.page, missing)])]
        fits = np.ones(len(rows), bool)
        for want, lack, told in zip(values, lacks, self.told):
            fits &= ~lack[rows] | (told[rows] == want)
        return rows, fits

    def read(self, had: set[int], near: np.ndarray, rows: np.ndarray, fits: np.ndarray) -> tuple[list[int], int, int]:
        """Details read one by one, until there are enough offers or the quota is used: rows of new offers, how many were read, and how many fitted."""
        new, urls, matched = [], set(), 0
        for i in near.tolist():
            if len(had) >= self.least or len(urls) >= self.quota:
                break
            row = rows[i]
            if self.url[row] in urls:
                continue  # of offers of one URL the first counts
            urls.add(self.url[row])
            matched += int(fits[i])
            if fits[i] and self.offer[row] not in had:
                had.add(self.offer[row])
                new.append(int(row))
        return new, len(urls), matched


def _slices(keys: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[int, int]]]:
    """An order by key, and where each key's rows stand in it."""
    order = np.argsort(keys, kind="stable")
    own, starts = np.unique(keys[order], return_index=True)
    return order, dict(zip(own.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(keys)])))


def _alike(values: list[np.ndarray], limits: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """What profiles ask for at a step, each once: the place of one that asks for it, in order of ``values``; which of these each profile has; and where other values begin."""
    columns = [*values, *(np.nan_to_num(x, nan=-1e300) for x in limits)]
    order = np.lexsort(columns[::-1])
    first = np.append(True, np.zeros(len(order) - 1, bool))
    other = first.copy()
    for i, x in enumerate(columns):
        changed = np.diff(x[order]) != 0
        first[1:] |= changed
        if i < len(values):
            other[1:] |= changed
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(first) - 1
    return order[first], of, [*np.flatnonzero(other[first]).tolist(), int(first.sum())]


def _climber(dialect: str, steps: tuple[int, ...], least: int, quota: int | None, stop_pages: bool):
    """Turns a bucket of profiles and of offers into answers (``_ANSWER``), one for each profile and step that it takes."""
    active = {step: {k for k, last in LADDERS[dialect].items() if step <= last} for step in steps}

    def run(asking: pa.Table, had: pa.Table) -> pa.Table:
        order, groups = _slices(_whole(asking, "key"))
        asking = asking.take(pa.array(order))
        order, offered = _slices(_whole(had, "key"))
        had = had.take(pa.array(order))
        names = np.stack([_whole(asking, c) for c in LADDER])
        kinds, values = _whole(asking, "building_type"), [_whole(asking, k) for k in EQUAL]
        rows = []
        for key, (start, end) in groups.items():
            a, b = offered.get(key, (0, 0))
            group = _Group(had.slice(a, b - a), least, quota, stop_pages)
            open_ = np.arange(start, end)
            own_rows = asking.slice(start, end - start)
            for step in steps:
                limits = {k: _real(own_rows, f"{k}_{step}")[open_ - start] for k in _LIMITS}
                own = [x[open_] if k in active[step] else np.full(len(open_), _NULL) for k, x in zip(("building_type", *EQUAL), (kinds, *values))]
                asks, of, edges = _alike(own, list(limits.values()))
                told = [group.step(int(own[0][asks[i]]), [int(x[asks[i]]) for x in own[1:]], {k: v[asks[i:j]] for k, v in limits.items()}) for i, j in zip(edges, edges[1:])]
                told = [np.concatenate(part)[of] for part in zip(*told)]
                enough = told[0] >= least
                rows.append((names[:, open_], np.full(len(open_), step), *told))
                open_ = open_[~enough]
                if not len(open_):
                    break
        if not rows:
            return pa.table([pa.array([], t) for t in _ARROW], names=_ANSWER.names)
        joined = [np.concatenate(c, axis=-1) for c in zip(*rows)]
        last = (joined[2] >= least) | (joined[1] == STEPS - 1)
        given = [*joined[0], *joined[1:], last]
        return pa.table([pa.array(x, t, from_pandas=True) if x.dtype == object or x.dtype.kind == "U" else pa.array(np.nan_to_num(x), pa.float64(), mask=np.isnan(x)).cast(t) if x.dtype.kind == "f" else pa.array(x).cast(t) for x, t in zip(given, _ARROW)], names=_ANSWER.names)

    return run


_ARROW = [{T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string(), T.BooleanType(): pa.bool_()}[f.dataType] for f in _ANSWER.fields]


def answers(asking: DataFrame, offers: DataFrame, pairs: DataFrame, dialect: str, least: int = 2, quota: int | None = None, stop_pages: bool = False) -> DataFrame:
    """One row for each of the ``profiles`` and each step that it takes, written out (``_ANSWER``); with the ``last`` one it has found enough or no step is left."""
    upto = LADDERS[dialect]["station"]
    parts, n = [], offers.count()
    for steps in (tuple(range(upto + 1)), tuple(range(upto + 1, STEPS))):
        if not steps:
            continue
        named = steps[0] <= upto
        own = asking.withColumn("key", _group(F.col("station") if named else F.lit(None).cast("string")))
        if parts:
            own = own.join(shuffled(parts[-1].where(F.col("step") == upto).where(~F.col("last")).select(*LADDER)), LADDER, "left_semi")
        keys = cut(own.groupBy("key").agg(F.bool_or(F.col("station").isNull()).alias("free"), F.bool_or(F.col("station").isNotNull()).alias("asked")))
        free, by_name = keys.agg(F.coalesce(F.bool_or("free"), F.lit(False)), F.coalesce(F.bool_or("asked"), F.lit(False))).first()
        of = candidates(keys.select("key"), offers, pairs, free or not (named and by_name), named and by_name)
        buckets = max(2 * offers.sparkSession.sparkContext.defaultParallelism, math.ceil(n / BUCKET_ROWS))
        dealt = [df.withColumn("bucket", F.pmod("key", F.lit(buckets))).repartition(buckets, "bucket").groupBy("bucket") for df in (own.drop(*PLACE, "station"), of)]
        parts.append(cut(dealt[0].cogroup(dealt[1]).applyInArrow(_climber(dialect, steps, least, quota, stop_pages), _ANSWER), release=True))
    return functools.reduce(DataFrame.unionByName, parts)


_OFFER_KEY = ["rent_yen", "admin_fee_yen", "area_sqm", "layout_type"]


def keep_first(offers: DataFrame, keys: list[str] = _OFFER_KEY, order: tuple[str, ...] = ("page", "pos"), within: tuple[str, ...] = ()) -> DataFrame:
    """The first of offers with equal keys (nulls equal), in this order."""
    ranked = offers.withColumn("__rank", F.row_number().over(Window.partitionBy(*within, *keys).orderBy(*order)))
    return ranked.where("__rank = 1").drop("__rank")


def robust_aggregate(value: Column) -> dict[str, Column]:
    """One, the mean of two, the midrange of more, or their median if they spread too far; nulls and negatives don't count."""
    x = F.when(value >= 0, value)
    n, low, high, middle = F.count(x), F.min(x), F.max(x), F.median(x)
    spread = F.when(low > 0, high / low)
    picked = F.when((n >= 3) & F.coalesce(spread > spec.OUTLIER_RATIO, F.lit(False)), middle).otherwise((low + high) / 2)
    method = F.when(n == 0, "none").when(n == 1, "single").when(n == 2, "mean").when(F.coalesce(spread > spec.OUTLIER_RATIO, F.lit(False)), "median").otherwise("midrange")
    return {"value": F.bround(picked).cast("bigint"), "method": method, "n": n, "min": low, "max": high, "median": middle, "ratio": spread}


def confidence(n: Column, step: Column) -> Column:
    return F.when(n < 2, "none").when(step == 0, F.when(n >= 3, "high").otherwise("mid")).when(step == 1, F.when(n >= 3, "mid").otherwise("low")).otherwise("low")


def live_levels() -> list[str]:
    """Names of all levels that comparable offers may give: met at once, or by relaxed conditions."""
    return [f"{kind}_{dialect}" for dialect in LADDERS for kind in ("live", "relaxed")]


USED = ["listing_id", *PLACE, "area_sqm", "building_age_years", "station_walk_min", "building_structure", "nearest_station_name", "orientation", "bathroom_toilet_separate"]
#: What makes two offers of a place one.
_SAME = ["rent_yen", "admin_fee_yen", "area_sqm"]


def quota_of(least: int) -> int:
    """Detail pages that a step may read for a subject."""
    return max(12, 8 * least)


def one_detail(details: DataFrame) -> DataFrame:
    """One row for each ``detail_url``: of what repeated rows say of a field, the least."""
    return details.where("detail_url IS NOT NULL").groupBy("detail_url").agg(*(F.min(c).alias(f"told_{k}") for k, c in EQUAL.items()))


def prepared(offers: DataFrame, details: DataFrame | None = None, quota: int | None = None) -> DataFrame:
    """Offers as the ladder reads them, written out; with a quota beside what their details tell, else with what they lack filled from all details."""
    known = [*PLACE, "station_name", *EQUAL.values(), "building_type", "area_sqm", "building_age_years", "walk_min", "rent_yen", "admin_fee_yen", "page"]
    if details is None:
        return cut(offers.select(*known))
    if not quota:
        return cut(enrich(offers, details).select(*known), release=True)
    return cut(offers.join(shuffled(one_detail(details)), "detail_url", "left").select(*known, "detail_url", "pos", *(f"told_{k}" for k in EQUAL)), release=True)


def _climbed(subjects: DataFrame, offers: DataFrame, dialect: str, least: int, skip: tuple[str, ...], quota: int | None, stop_pages: bool, pairs: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Subjects that are ``laddered``, and the ``answers`` to their profiles."""
    own = subjects.withColumns({c: F.lit(None).cast(subjects.schema[c].dataType) for c in skip}).withColumn("layout_type", F.upper("layout_type")).select(*USED)
    own = laddered(own, dialect)
    asking = cut(profiles(own))
    pairs = cut(contained_pairs(asking.select("station"), offers.select("station_name"), dialect)) if pairs is None else pairs
    return own, answers(asking, offers, pairs, dialect, least, quota, stop_pages)


def climb(subjects: DataFrame, offers: DataFrame, dialect: str, least: int = 2, skip: tuple[str, ...] = (), details: DataFrame | None = None, quota: int | None = None, stop_pages: bool = False, pairs: DataFrame | None = None) -> list[DataFrame]:
    """For each step the subjects that take it (``USED``), with their profile, ``want``, ``n`` and figures of the step; ``offers`` are ``prepared``, with the details if a quota is given, ``pairs`` those of ``station_pairs``."""
    own, told = _climbed(subjects, offers, dialect, least, skip, quota, stop_pages, pairs)
    wants = [f"want_{step}" for step in range(STEPS)]
    met = own.select(*USED, *LADDER, *wants).join(shuffled(told), LADDER).withColumn("want", F.element_at(F.array(*wants), F.col("step") + 1)).drop(*wants)
    met = cut(met, release=True)  # subjects are shuffled once, not again for each step
    return [_profiled(met.where(F.col("step") == step)) for step in range(STEPS)]


def settled(subjects: DataFrame, offers: DataFrame, dialect: str, least: int = 2, skip: tuple[str, ...] = (), quota: int | None = None, stop_pages: bool = False) -> DataFrame:
    """One row for each subject, of ``prepared`` offers: chosen step, n, figures, confidence and level."""
    own, told = _climbed(subjects, offers, dialect, least, skip, quota, stop_pages, None)
    figures = ["n", "benchmark_yen", "method", "benchmark_rent_yen"]
    # the last step with any offers is the chosen one
    best = told.groupBy(*LADDER).agg(F.max(F.when(F.col("n") > 0, F.struct("step", *figures))).alias("best"))
    out = own.select("listing_id", *LADDER).join(shuffled(best), LADDER).select("listing_id", F.col("best.step").alias("chosen_step"), F.coalesce("best.n", F.lit(0)).alias("n"), "best.benchmark_yen", F.coalesce("best.method", F.lit("none")).alias("method"), "best.benchmark_rent_yen")
    level = F.when(F.col("n") == 0, "none").when(F.col("chosen_step") == 0, f"live_{dialect}").otherwise(f"relaxed_{dialect}")
    return out.withColumn("benchmark_confidence", confidence(F.col("n"), F.col("chosen_step"))).withColumn("matched_level", level)


def live_benchmark(subjects: DataFrame, offers: DataFrame, dialect: str, least: int = 2, skip: tuple[str, ...] = (), details: DataFrame | None = None, quota: int | None = None, stop_pages: bool = False) -> DataFrame:
    """One row for each subject: chosen step, n, robust figure of monthly totals and of rents, confidence, level.

    The chosen step is the first with ``least`` distinct offers, else the last with any;
    a subject without any has n = 0, no figures and the confidence and level ``none``.
    ``skip`` names subject columns that are not asked for.  ``details`` (``detail_url``
    and fields) fills what offers lack: all of it, or with ``quota`` up to so many rows for
    a profile and step, and only while it has found too few.  Those of offers that lack least
    are read first, then by page, position, URL and the offer's figures; an offer without a
    URL cannot be read.  With ``stop_pages`` a step counts only offers up to the page on
    which it has found enough.
    """
    return settled(subjects, prepared(offers, details, quota), dialect, least, skip, quota if details is not None else None, stop_pages)


def up_to_page(distinct: DataFrame, by: list[str], least: int) -> DataFrame:
    """Rows up to the ``page`` on which the running number of a group's rows reaches ``least``; all of them where none does."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("page"))
    stop = F.min(F.when(F.col("__rank") == least, F.col("page"))).over(Window.partitionBy(*by))
    return distinct.withColumn("__rank", rank).withColumn("__stop", stop).where("__stop IS NULL OR page <= __stop").drop("__rank", "__stop")


def answered() -> Column:
    """A figure, and any confidence in it."""
    return (F.col("benchmark_confidence") != "none") & F.col("benchmark_yen").isNotNull()


def provider_fallback(results: list[DataFrame], names: tuple[str, ...] = tuple(LADDERS)) -> DataFrame:
    """Of results in order of preference, the first with a figure and any confidence for each subject, else the last tried.

    ``attempts`` lists what was tried up to the one that was taken, each as ``name:confidence``.
    """
    tried = functools.reduce(DataFrame.unionByName, (r.withColumns({"provider": F.lit(i), "tried": F.concat(F.lit(f"{name}:"), "benchmark_confidence")}) for i, (r, name) in enumerate(zip(results, names))))
    good = answered()
    columns = [c for c in results[0].columns if c != "listing_id"]
    taken = F.struct(F.when(good, F.col("provider")).otherwise(len(results)).alias("order"), (-F.col("provider")).alias("late"), "provider", *columns)
    one = tried.groupBy("listing_id").agg(F.min(taken).alias("t"), F.array_sort(F.collect_list(F.struct("provider", "tried"))).alias("all"))
    attempts = F.array_join(F.transform(F.filter("all", lambda x: x["provider"] <= F.col("t.provider")), lambda x: x["tried"]), ",")
    return one.select("listing_id", *(F.col(f"t.{c}").alias(c) for c in columns), "t.provider", attempts.alias("attempts"))


def fallback(subjects: DataFrame, offers: DataFrame, dialects: tuple[str, ...] = tuple(LADDERS), least: int = 2) -> DataFrame:
    """``provider_fallback`` of ladders, each climbed only by subjects that those before have left without an answer."""
    ready, results = prepared(offers), []
    for dialect in dialects:
        results.append(cut(settled(subjects, ready, dialect, least)))
        subjects = subjects.join(shuffled(results[-1].where(~answered()).select("listing_id")), "listing_id", "left_semi")
    return provider_fallback(results, dialects)


def page_stop(found: DataFrame, least: int = 2) -> DataFrame:
    """Rows up to the page on which a subject's running number of matches within a step reaches ``least``."""
    return up_to_page(found, ["listing_id", "step"], least)


def coverage(offers: DataFrame, by: str = "page") -> DataFrame:
    """How many offers of each page have each field."""
    fields = ["area_sqm", "walk_min", "building_age_years", "orientation", "building_structure", "bathroom_toilet_separate", "building_type"]
    return offers.groupBy(by).agg(F.count("*").alias("fetched_n"), *(F.count(f).alias(f"has_{f}") for f in fields))


def enrich(offers: DataFrame, details: DataFrame, budget: int | None = None) -> DataFrame:
    """Fill fields that offers lack from the rows of their ``detail_url``; with a budget, of so many URLs only: those of offers that lack least first, then by position and URL."""
    if budget is not None:
        need = functools.reduce(Column.__add__, (F.col(c).isNull().cast("int") for c in EQUAL.values()))
        lacking = offers.where((need > 0) & F.col("detail_url").isNotNull()).groupBy("detail_url").agg(F.min(F.struct(need.alias("need"), "pos")).alias("first"))
        details = details.join(lacking.orderBy("first", "detail_url").limit(budget), "detail_url", "left_semi")  # a top-k, not a global sort
    joined = offers.join(shuffled(one_detail(details)), "detail_url", "left")
    return joined.withColumns({c: F.coalesce(c, f"told_{k}") for k, c in EQUAL.items()}).select(offers.columns)
