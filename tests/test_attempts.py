"""Counts without pairs against a loop over pairs; quotas of details; names by their index."""

import random

import pytest
from pyspark.sql import functions as F

from leaselight.operators import attempts, comparables, names

STATIONS = ["難波", "なんば", "Ａ", "A", "A2", "ＡＢ", "B" * 300, "", None]


def subjects(spark, rng, n):
    pick = rng.choice
    rows = [(i, "tokyo", pick(["m", "n"]), pick(["1k", "1K"]), pick([None, 10.0, 17.5, 20.0, 24.9]), pick([None, 0, 3, 9, 40]), pick([None, 1, 7, 25]), pick(["rc", "wood", "other", None]), pick(STATIONS), pick(["N", "UNKNOWN", None]), pick([True, False, None])) for i in range(n)]
    return spark.createDataFrame(rows, "listing_id long, prefecture string, municipality string, layout_type string, area_sqm double, building_age_years long, station_walk_min long, building_structure string, nearest_station_name string, orientation string, bathroom_toilet_separate boolean")


def offers(spark, rng, n):
    pick = rng.choice
    rows = [("tokyo", pick(["m", "m", "n", None]), "1K", pick([None, 5.0, 10.0, 15.0, 19.9, 20.0, 25.0]), pick([None, 0, 1, 5, 30]), pick([None, 1, 5, 6, 20]), pick(["rc", "wood", None]), pick(STATIONS), pick(["N", "S", None]), pick([True, False, None]), pick(["mansion", "apartment", None]), 50_000 + 10 * i, 0, i % 3, i, pick([f"u{i}", None])) for i in range(n)]
    return spark.createDataFrame(rows, "prefecture string, municipality string, layout_type string, area_sqm double, building_age_years long, walk_min long, building_structure string, station_name string, orientation string, bathroom_toilet_separate boolean, building_type string, rent_yen long, admin_fee_yen long, page long, pos long, detail_url string")


def alike(a, b, dialect):
    plain = {"Ａ": "A", "ＡＢ": "AB", "なんば": "難波"}
    if dialect == "cassette":
        a, b = plain.get(a, a), plain.get(b, b)
    return bool(a) and bool(b) and (a in b or b in a)


def verdict(want, o, dialect):
    """The first condition that fails, else what is not told, by reading the limits."""
    def within(low, x, high):
        return high is None or (x is not None and x <= high and (low is None or x >= low))

    tests = [("area", within(want["area_low"], o["area_sqm"], want["area_high"])), ("age", within(None, o["building_age_years"], want["age_max"])), ("walk", within(want["walk_low"], o["walk_min"], want["walk_high"])),
             ("station", want["station"] is None or alike(want["station"], o["station_name"], dialect)), ("building_type", None in (want["building_type"], o["building_type"]) or want["building_type"] == o["building_type"])]
    untold = []
    for name, column in comparables.EQUAL.items():
        tests.append((name, None in (want[name], o[column]) or want[name] == o[column]))
        if want[name] is not None and o[column] is None:
            untold.append(f"untold_{name}")
    return next((name for name, fine in tests if not fine), None), untold


@pytest.mark.parametrize("dialect", list(comparables.LADDERS))
def test_counts_equal_a_loop_over_pairs(spark, dialect):
    rng = random.Random(5)
    asking, of = subjects(spark, rng, 40), offers(spark, rng, 90)
    rows = of.collect()
    for step in (0, 2):
        profiles = comparables.asked(asking.withColumn("layout_type", F.upper("layout_type")), dialect, step)
        found = {(r["profile"], r["profile_2"]): r for r in attempts.profile_counts(profiles, of, dialect).collect()}
        for p in profiles.collect():
            want = {c: dict.fromkeys([*attempts.REASONS, "untold", *attempts.UNTOLD, "complete_n", "fetched_n"], 0) for c in "x"}["x"]
            for o in rows:
                if o["municipality"] == p["municipality"]:
                    reason, untold = verdict(p["want"], o, dialect)
                    want["fetched_n"] += 1
                    want[reason or ("untold" if untold else "complete_n")] += 1
                    for u in [] if reason else untold:
                        want[u] += 1
            got = found[p["profile"], p["profile_2"]]
            assert {k: got[k] for k in want} == want


def test_nothing_offered_and_nobody_asking(spark):
    rng = random.Random(6)
    none, some = offers(spark, rng, 3).where("false"), subjects(spark, rng, 3)
    tried = attempts.log(comparables.climb(some, comparables.prepared(none), "cassette"), none, "cassette")
    assert tried.count() == 12 and tried.agg(F.sum("fetched_n")).first()[0] == 0
    assert attempts.log(comparables.climb(some.where("false"), comparables.prepared(none), "lines"), none, "lines").count() == 0


def detailed(spark, offers_, told, quota, least=2):
    one = "x long, prefecture string, municipality string, layout_type string, area_sqm double, building_age_years long, station_walk_min long, building_structure string, nearest_station_name string, orientation string, bathroom_toilet_separate boolean"
    asking = spark.createDataFrame([(1, "p", "m", "1K", 20.0, 3, 5, "rc", None, "N", None)], one).withColumnRenamed("x", "listing_id")
    rows = [("p", "m", "1K", 20.0, 3, 5, structure, None, facing, None, None, rent, 0, page, pos, url) for structure, facing, rent, page, pos, url in offers_]
    of = spark.createDataFrame(rows, offers(spark, random.Random(0), 1).schema)
    details = spark.createDataFrame(told, "detail_url string, orientation string, building_structure string, bathroom_toilet_separate boolean")
    step = comparables.climb(asking, comparables.prepared(of, details, quota), "cassette", least, details=details, quota=quota)[0].first()
    return step["n"], step["detail_n"], step["detail_matched_n"], step["benchmark_rent_yen"]


def test_details_are_read_in_order_and_within_the_quota(spark):
    bare = [(None, None, 100 + i, 1, i, f"u{i}") for i in range(9)]
    told = [(f"u{i}", "N" if i in (4, 6, 7) else "S", "rc", True) for i in range(9)]
    assert detailed(spark, bare, told, 4) == (0, 4, 0, None)  # the fitting ones come too late
    assert detailed(spark, bare, told, 5) == (1, 5, 1, 104)
    assert detailed(spark, bare, told, 20) == (2, 7, 2, 105)  # stops with the second, the last is not read
    nearer = [*bare, ("rc", None, 500, 9, 99, "u7")]
    assert detailed(spark, nearer, told, 1) == (1, 1, 1, 500)  # what lacks least is read first, whatever its page
    assert detailed(spark, [("rc", "N", 300, 1, 50, None), *bare], told, 20) == (2, 5, 1, 202)  # one that is complete needs one more
    assert detailed(spark, [("rc", "N", 300, 1, 50, None), ("rc", "N", 301, 1, 50, None), *bare], told, 20)[:3] == (2, 0, 0)  # enough: nothing is read
    assert detailed(spark, [(None, None, 100, 1, 0, None), *bare], told[:3], 20) == (0, 9, 0, None)  # no URL, no details: nothing learnt
    twice = told + [("u4", "E", None, None)]
    assert detailed(spark, bare, twice, 20)[:3] == (2, 8, 2)  # of two rows of a URL the least value counts: east is before north


def test_names_against_all_pairs(spark):
    rng = random.Random(7)
    made = lambda: "".join(rng.choices("ab", k=rng.randrange(0, 6)))
    one, two = [(made(),) for _ in range(60)] + [(None,)], [(made(),) for _ in range(60)] + [(None,)]
    found = names.either_contains(spark.createDataFrame(one, "a string"), spark.createDataFrame(two, "b string"), "a", "b")
    pairs = sorted({(a, b) for (a,) in one for (b,) in two if a and b and (a in b or b in a)})
    assert sorted(map(tuple, found.collect())) == pairs


def test_long_names_cost_their_length(spark):
    """The index has no more rows than names have characters, twice."""
    long = spark.createDataFrame([("".join(f"{i:02d}-{j:05d}." for j in range(1_100)),) for i in range(20)], "b string")
    inner = long.select(F.substring("b", 5000, 40).alias("a"))
    assert names.contained(inner, long, "a", "b").count() == 20
    assert names.contained(long.withColumnRenamed("b", "a"), long, "a", "b").count() == 20


def test_widths_meet(spark):
    own = spark.createDataFrame([("Ａ１駅",), ("ﾅﾝﾊﾞ",)], "station string")
    others = spark.createDataFrame([("A1",), ("ナンバ",)], "station_name string")
    assert sorted(map(tuple, comparables.contained_pairs(own, others, "cassette").collect())) == [("Ａ１駅", "A1"), ("ﾅﾝﾊﾞ", "ナンバ")]
    assert comparables.contained_pairs(own, others, "lines").count() == 0


def test_cells_stand_once_where_stations_are_asked_for(spark):
    """Offers are counted for their stations, and for a place as a whole only if somebody asks for it so."""
    counted = attempts.cells(offers(spark, random.Random(8), 60))
    assert counted.where(F.col("station_name") == "*").count() == 0
    by_name = attempts._by_group(counted, True, False)
    assert by_name.count() <= counted.count() and by_name.agg(F.sum("n")).first()[0] == counted.where("station_name IS NOT NULL").agg(F.sum("n")).first()[0]
    assert attempts._by_group(counted, False, True).agg(F.sum("n")).first()[0] == counted.agg(F.sum("n")).first()[0]
