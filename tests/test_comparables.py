"""The ladder: what it meets grows with the offers, and what it says about those who find nothing."""

from pyspark.sql import functions as F

from leaselight.operators import comparables


def subjects(spark, n):
    i = F.col("id")
    return spark.range(n).select(
        i.alias("listing_id"), F.lit("tokyo").alias("prefecture"), F.concat(F.lit("m"), i % 2).alias("municipality"), F.lit("1k").alias("layout_type"), (20 + i % 7).cast("double").alias("area_sqm"), (3 + i % 5).alias("building_age_years"), (1 + i % 6).alias("station_walk_min"),
        F.element_at(F.array(*map(F.lit, ("rc", "wood", "other"))), (i % 3 + 1).cast("int")).alias("building_structure"), F.concat(F.lit("S"), i % 3).alias("nearest_station_name"), F.element_at(F.array(F.lit("N"), F.lit("UNKNOWN")), (i % 2 + 1).cast("int")).alias("orientation"), (i % 4 == 0).alias("bathroom_toilet_separate"),
    )


def offers(spark, n):
    i = F.col("id")
    return spark.range(n).select(
        F.lit("tokyo").alias("prefecture"), F.concat(F.lit("m"), i % 2).alias("municipality"), F.lit("1K").alias("layout_type"), (18 + i % 11).cast("double").alias("area_sqm"), (i % 9).alias("building_age_years"), (i % 8).alias("walk_min"), F.when(i % 3 > 0, "rc").alias("building_structure"),
        F.concat(F.lit("S"), i % 4).alias("station_name"), F.when(i % 5 > 0, "N").alias("orientation"), (i % 2 == 0).alias("bathroom_toilet_separate"), F.lit(None).cast("string").alias("building_type"), (50_000 + i * 7).alias("rent_yen"), F.lit(0).cast("bigint").alias("admin_fee_yen"), (i % 10).alias("page"), i.alias("pos"),
    )


def test_candidates_grow_with_the_offers(spark, monkeypatch):
    """Four times the subjects and offers give about four times the candidates, not sixteen times."""
    met, own = [], comparables.candidates

    def counted(*given):
        found = own(*given)
        met.append(found.count())
        return found

    monkeypatch.setattr(comparables, "candidates", counted)
    for dialect in ("cassette", "block"):
        sums = []
        for n in (2_000, 8_000):
            met.clear()
            assert comparables.live_benchmark(subjects(spark, n), offers(spark, n), dialect).count() == n
            sums.append(sum(met))
        assert 0 < sums[1] <= 5 * sums[0], dialect


def test_subjects_without_a_match(spark):
    asked = subjects(spark, 4).withColumn("municipality", F.lit("elsewhere"))
    rows = comparables.live_benchmark(asked, offers(spark, 50), "lines").collect()
    assert len(rows) == 4 and {(r.n, r.chosen_step, r.benchmark_yen, r.benchmark_confidence, r.matched_level) for r in rows} == {(0, None, None, "none", "none")}
    assert comparables.live_benchmark(subjects(spark, 3), offers(spark, 0), "block").count() == 3
    assert comparables.live_benchmark(subjects(spark, 0), offers(spark, 9), "cassette").count() == 0


def test_station_names(spark):
    own = spark.createDataFrame([("なん ば駅",), ("S1",), ("",), (None,), ("x" * 300,)], "station string")
    others = spark.createDataFrame([("難波",), ("S12",), ("駅",), (None,), ("y" * 300 + "S1",)], "station_name string")
    pairs = lambda dialect: sorted(map(tuple, comparables.contained_pairs(own, others, dialect).collect()))
    assert pairs("cassette") == [("S1", "S12"), ("S1", "y" * 300 + "S1"), ("なん ば駅", "難波")]
    assert pairs("lines") == [("S1", "S12"), ("S1", "y" * 300 + "S1"), ("なん ば駅", "駅")]


def test_pages_and_attempts(spark):
    found = spark.createDataFrame([("a", 1, 5), ("a", 3, 6), ("a", 3, 7), ("a", 4, 8), ("b", 9, 1)], "k string, page int, v int")
    assert sorted(r.v for r in comparables.up_to_page(found, ["k"], 2).collect()) == [1, 5, 6, 7]
    result = lambda rows: spark.createDataFrame(rows, "listing_id long, benchmark_yen long, benchmark_confidence string")
    one, two = result([(1, 5, "none"), (2, 7, "high"), (3, None, "none")]), result([(1, 6, "low"), (2, 8, "mid"), (3, None, "none")])
    got = {r.listing_id: (r.provider, r.benchmark_yen, r.attempts) for r in comparables.provider_fallback([one, two], ("x", "y")).collect()}
    assert got == {1: (1, 6, "x:none,y:low"), 2: (0, 7, "x:high"), 3: (1, None, "x:none,y:none")}


def test_no_row_for_a_pair(spark, monkeypatch):
    """An offer whose station is asked for by one name is dealt once in a round, however many ask for it."""
    met, own = [], comparables.candidates

    def counted(*given):
        found = own(*given)
        met.append(found.count())
        return found

    monkeypatch.setattr(comparables, "candidates", counted)
    assert comparables.live_benchmark(subjects(spark, 400), offers(spark, 600), "cassette").count() == 400
    assert met and max(met) <= 600
