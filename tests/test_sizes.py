"""What grows with the input neither passes through the driver nor is compared again for each who asks the same."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from leaselight.operators import attempts, comparables

from .test_comparables import offers, subjects


def broadcast_joins(df, key):
    """Joins on a key for which Spark would send one side through the driver."""
    return re.findall(rf"BroadcastHashJoin \[[^\]]*{key}[^\n]*", df._jdf.queryExecution().executedPlan().toString())


def test_counts_are_not_broadcast(spark):
    """However small the files of a few rows are: of millions they are small as well."""
    ready = comparables.prepared(offers(spark, 60))
    steps = comparables.climb(subjects(spark, 40), ready, "cassette")
    assert not any(broadcast_joins(s, "ladder") for s in steps)
    counts = attempts.profile_counts(steps[0].select(*comparables.PROFILE, *comparables.PLACE, "want"), ready, "cassette")
    assert not broadcast_joins(counts, "box") and not broadcast_joins(counts, "profile")
    assert not broadcast_joins(attempts.log(steps, ready, "cassette"), "profile")


def asking_alike(n):
    """``n`` profiles of one place that ask for the same at all steps, each with a name of its own, and one that asks for less."""
    own = {"key": [7] * (n + 1), "ladder": [*range(n + 1)], "ladder_2": [0] * (n + 1), "building_type": [None] * (n + 1), **{k: [None] * (n + 1) for k in comparables.EQUAL}}
    limits = {"area_low": 20.0, "area_high": 30.0, "age_max": 10.0, "walk_low": None, "walk_high": None}
    own |= {f"{k}_{step}": [v] * n + [None] for step in range(comparables.STEPS) for k, v in limits.items()}
    kinds = {c: pa.float64() if c[-2:-1] == "_" and c[-1].isdigit() and c != "ladder_2" else pa.int64() for c in own}
    return pa.table({c: pa.array(v, kinds[c]) for c, v in own.items()})


def test_equal_questions_are_answered_once(monkeypatch):
    compared, within = [], comparables._Group.within

    def counted(self, rows, limits):
        compared.append(len(rows) * len(limits["age_max"]))
        return within(self, rows, limits)

    monkeypatch.setattr(comparables._Group, "within", counted)
    had = {"key": [7] * 40, "rent_yen": [50_000 + 10 * i for i in range(40)], "admin_fee_yen": [0] * 40, "page": [1] * 40, "area_sqm": [15.0 + i for i in range(40)], "building_age_years": [float(i % 20) for i in range(40)], "walk_min": [5.0] * 40, "building_type": [None] * 40, **{k: [None] * 40 for k in comparables.EQUAL}}
    had = pa.table({c: pa.array(v, pa.float64() if isinstance(v[0], float) else pa.int64()) for c, v in had.items()})
    answers = comparables._climber("block", (2, 3), 2, None, False)(asking_alike(500), had).to_pylist()
    assert sum(compared) == 2 * 40  # not 501 * 40
    fitting = [r for r in had.to_pylist() if 20 <= r["area_sqm"] <= 30 and r["building_age_years"] <= 10]
    assert sorted((a["ladder"], a["step"], a["n"], a["last"]) for a in answers) == [*((i, 2, len(fitting), True) for i in range(500)), (500, 2, 40, True)]
    assert {a["benchmark_yen"] for a in answers if a["ladder"] < 500} == {int(np.rint((fitting[0]["rent_yen"] + fitting[-1]["rent_yen"]) / 2))}


def test_steps_shuffle_subjects_once(spark):
    """What a subject takes is met with its answers once and written; a step only reads it."""
    steps = comparables.climb(subjects(spark, 40), comparables.prepared(offers(spark, 60)), "lines")
    assert [s.count() > 0 for s in steps][0] and not any("Join" in s._jdf.queryExecution().optimizedPlan().toString() for s in steps)


def test_cells_without_stations(spark):
    """Where nobody asks for a station, offers are not told apart by theirs."""
    own = offers(spark, 60)
    own = own.unionByName(own.withColumn("station_name", own.station_name.substr(1, 0)))
    known, whole = attempts.cells(own), attempts.cells(own, named=False)
    assert "station_name" not in whole.columns and whole.count() < known.count()
    assert whole.agg({"n": "sum"}).first()[0] == known.agg({"n": "sum"}).first()[0] == 120


def test_answers_are_not_broadcast(spark):
    """Subjects meet their answers, and offers their details, by shuffles, in each form of the ladder."""
    own, had = subjects(spark, 40), offers(spark, 60).withColumn("detail_url", F.col("pos").cast("string"))
    details = had.select("detail_url", "orientation", "building_structure", "bathroom_toilet_separate")
    for dialect, form in (("cassette", {}), ("lines", {"stop_pages": True}), ("cassette", {"details": details, "quota": 16})):
        assert not broadcast_joins(comparables.live_benchmark(own, had, dialect, **form), "ladder")
    assert not broadcast_joins(comparables.enrich(had, details), "detail_url")
