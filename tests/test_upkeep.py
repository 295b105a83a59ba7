"""Visibility, sketches, codebooks, encodings, streams with state, writers that may repeat, archives, bundles."""

import json
import random

import pytest
from pyspark.sql import functions as F

from leaselight.functions import codebooks, text
from leaselight.operators import documents, market, sketches, visibility
from leaselight.plans import bundled, pages
from leaselight.sources import sinks
from leaselight.streaming import market as stream
from tests.test_rules import GOOD, TOWN, index


def test_visibility_by_levels_and_cycles(spark):
    fields = visibility.declared([{"key": "c", "depends_on": {"key": "b", "equals": 2}}, {"key": "a"}, {"key": "b", "depends_on": {"key": "a", "equals": "x"}}, {"key": "d", "depends_on": {"key": "b", "not_equals": 2}}, {"key": "e", "depends_on": {"key": "gone", "equals": None}}])
    assert [[f.key for f in level] for level in visibility.levels(fields)[0]] == [["a", "e"], ["b"], ["c", "d"]]
    df = spark.createDataFrame([("x", 2, "c", None), ("y", 2, "c", "d"), (None, None, None, "d")], "a string, b int, c string, d string")
    shown = lambda chained: [r.visible for r in visibility.visible_fields(df, fields, chained).collect()]
    assert shown(False) == [["c", "a", "b", "e"], ["c", "a", "e"], ["a", "d", "e"]]
    assert shown(True) == [["c", "a", "b", "e"], ["a", "d", "e"], ["a", "d", "e"]]
    assert [tuple(r)[:4] for r in visibility.pruned(df, fields, True).collect()] == [("x", 2, "c", None), ("y", None, None, "d"), (None, None, None, "d")]
    assert [r.missing for r in visibility.missing(df, fields, ["a"]).collect()] == [["e"], ["e"], ["a", "e"]]
    round_ = visibility.declared([{"key": "a", "depends_on": {"key": "b", "equals": 1}}, {"key": "b", "depends_on": {"key": "a", "equals": 1}}, {"key": "z"}])
    assert visibility.levels(round_) == ([[visibility.Field("z")]], ["a", "b"])
    with pytest.raises(ValueError, match="a, b"):
        visibility.shown(round_, ["a", "b"], chained=True)
    assert set(visibility.shown(round_, ["a", "b"])) == {"a", "b", "z"}


def test_sketches_merge_within_their_error(spark):
    rng = random.Random(3)
    values = [int(rng.paretovariate(1.2) * 1000) for _ in range(20_000)]
    rows = spark.createDataFrame([("p", f"m{i % 3}", f"s{i % 40}" if i % 50 else None, "1K", v, i % 7) for i, v in enumerate(values)], "prefecture string, municipality string, station_name string, layout_type string, rent_yen long, access int").repartition(13)
    told = {(r.level, r.municipality, r.station_name): r for r in sketches.summary(rows, score="access").collect()}
    top = told["prefecture", None, None]
    assert top.n_rows == 20_000 and top.mean_score == pytest.approx(sum(i % 7 for i in range(20_000)) / 20_000)
    for share, got in ((0.25, top.p25), (0.5, top.p50), (0.75, top.p75)):
        below, upto = (sum(v < got for v in values) / 20_000, sum(v <= got for v in values) / 20_000)
        assert below - sketches.RANK_ERROR <= share <= upto + sketches.RANK_ERROR
    assert sum(r.n_rows for k, r in told.items() if k[0] == "municipality") == 20_000
    few = sketches.summary(rows.limit(150), score=None)
    assert few.where("level = 'prefecture'").count() == 0 and few.where("mean_score IS NOT NULL").count() == 0
    assert sketches.summary(rows.where("false")).count() == 0


def test_codebooks_invert(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    for book in (codebooks.WALK, codebooks.AGE):
        for limit, code in book.steps:
            assert one(book.code(F.lit(limit))) == code and one(book.limit(F.lit(code))) == limit
        assert one(book.code(F.lit(book.steps[-1][0] + 1))) is None and one(book.limit(F.lit("?"))) is None
    assert [one(codebooks.STRUCTURE.code(F.lit(s))) for s in ("src", "wood", "block", "all", "", None)] == ["1", "3", "4", None, None, None]
    assert one(codebooks.LAYOUT.name(codebooks.LAYOUT.code(F.lit("4DK")))) == "4DK"
    url = one(codebooks.list_url(F.lit("https://e.example/tokyo/area/13108/list/page3/?m=2&x=1"), F.lit("1k"), page=F.lit(2), walk=F.lit(6), bath=F.lit(True)))
    assert url == "https://e.example/tokyo/area/13108/list/bath-toilet/page2/?m=1&rt=50&k=1&j=4"
    read = one(codebooks.list_conditions(F.lit(url)))
    assert (read.area_code, read.layout_type, read.walk_max, read.age_max, read.bath, read.page) == ("13108", "1K", 7.0, None, True, 2)
    assert one(codebooks.list_url(F.lit("https://e.example/rent/"), F.lit("1K"))) is None and one(codebooks.list_url(F.lit("https://e.example/list"), F.lit("9K"))) is None


def test_sources_by_ranked_layouts(spark):
    sources = spark.createDataFrame([("t", "m", "1DK", "https://a.example/2", 2), ("t", "m", "1DK", "https://a.example/1", 1), ("t", "m", "1LDK", "https://a.example/3", 0), ("t", "m", "1R", "https://b.example/", 0), ("t", "m", "2K", None, 0)], "prefecture string, municipality string, layout_type string, source_url string, pos int")
    asked = spark.createDataFrame([("t", "m", "1LDK"), ("t", "m", "1K"), ("t", "n", "1K"), ("t", None, "1K")], "prefecture string, municipality string, layout_type string")
    got = {(r.municipality, r.layout_type): r.source_url for r in codebooks.first_source(asked, sources, "a.example").collect()}
    assert got == {("m", "1LDK"): "https://a.example/3", ("m", "1K"): "https://a.example/1", ("n", "1K"): None, (None, "1K"): None}


def test_first_encoding_without_fault(spark):
    rows = [(said.encode(code), hint, said) for said, code, hint in (("青葉①", "cp932", None), ("青葉", "shift_jis", None), ("青葉", "utf-8", None), ("青葉", "euc_jp", "euc_jp"), ("青葉", "cp932", "utf-8"), ("青葉", "utf-8", "no such"), ("é", "latin-1", "latin-1"))]
    got = spark.createDataFrame([(bytearray(b), h) for b, h, _ in rows], "raw binary, hint string").select(text.decoded(F.col("raw"), F.col("hint"))).collect()
    assert [r[0] for r in got] == [said for *_, said in rows]
    odd = spark.createDataFrame([(bytearray(b"\xff\xfea\x81"), None), (None, None), (bytearray(b""), None)], "raw binary, hint string").select(text.decoded(F.col("raw"), F.col("hint"))).collect()
    assert odd[0][0].endswith("a�") and [r[0] for r in odd[1:]] == [None, ""]


MARKET = "prefecture string, municipality string, layout_type string, building_structure string, avg_rent_yen long, source_name string, source_updated_at string"


def test_stream_store_equals_the_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [("t", f"m{rng.randrange(3)}", rng.choice(["1K", "1R"]), rng.choice(["rc", "wood", "all", "", None]), rng.choice([None, *range(50_000, 50_040)]), rng.choice(["a", None]), "2024") for _ in range(300)] + [(None, "m", "1K", "rc", 1, "a", "2024")]
    batches = [rows[:120], rows[100:200], rows[150:] + rows[:30]]
    store = str(tmp_path / "store")
    frames = [spark.createDataFrame(b, MARKET) for b in batches]
    for n, f in enumerate(frames):
        stream.absorb(store, f, n)
    whole = stream.benchmark.usable(spark.createDataFrame(rows, MARKET)).dropDuplicates(list(stream.SAME))
    want = sorted(map(tuple, stream.levels(whole.groupBy(*market.KEY, "avg_rent_yen").agg(F.count("*").alias("n"))).collect()), key=repr)
    medians = {tuple(r)[:5]: (r.benchmark_rent_yen_median, r.n_rows) for r in stream.benchmark.build_index(whole.where("avg_rent_yen IS NOT NULL")).select("level", *market.KEY, "benchmark_rent_yen_median", "n_rows").collect()}
    assert {tuple(r)[:5]: r[5:] for r in want} == medians
    read = lambda version=None: sorted(map(tuple, stream.read_index(spark, store, version).collect()), key=repr)
    assert read() == want
    first = read(0)
    stream.absorb(store, frames[2], 2)  # replayed: nothing changes
    assert read() == want and read(0) == first != want
    stream.compact(spark, store, 2)
    stream.absorb(store, spark.createDataFrame([("t", "m9", "1K", "rc", 70_000, "z", "2025")], MARKET), 3)
    assert len(read()) == len(want) + 2 and stream.versions(spark, store).count() == 4
    shuffled = str(tmp_path / "other")
    for n, f in enumerate(reversed(frames)):
        stream.absorb(shuffled, f, n)
    assert sorted(map(tuple, stream.read_index(spark, shuffled).collect()), key=repr) == want


def test_writers_that_may_repeat(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    for _ in range(2):
        sinks.append_once(rows, str(tmp_path / "log"), "one")
    sinks.append_once(rows.limit(1), str(tmp_path / "log"), "two")
    assert spark.read.option("header", True).csv(str(tmp_path / "log")).count() == 3
    golden = spark.createDataFrame([("x", [("FAR", "mid")], "T1"), ("y", [], "T1")], "listing_id string, risk_flags array<struct<risk_flag_id: string, severity: string>>, template_id string")
    sinks.write_regression(golden, spark.createDataFrame([("flag", "SMALL")], "code string, name string"), str(tmp_path / "golden"))
    said = json.loads(spark.read.text(str(tmp_path / "golden")).first()[0])["summary"]
    assert said == {"inputs": 2, "risk_flag_hits": {"FAR": 1}, "template_hits": {"T1": 2}, "findings": [{"code": "flag", "name": "SMALL"}]}
    lines = market.summary_lines(spark.createDataFrame([("rc",), ("rc",), ("all",)], "building_structure string"), rows, "2024-01-01", ["rc", "wood"]).orderBy("rank")
    assert [r.value for r in lines.collect()][3:] == ["**Rows:** 3", "**Missing combinations:** 2", "", "## Rows by structure", "- **rc:** 2", "- **wood:** 0"]


def test_archive_moves(spark):
    files = spark.createDataFrame([("c/x", "x_final.md", "integrated"), ("c/x", "a.md", "analysis"), ("c/x", "a.md", "analysis"), ("c/x", "old.tar.md", "answers"), ("c/x", "note.txt", "other"), ("c/y", "a.md", "analysis")], "folder string, name string, kind string")
    archived = spark.createDataFrame([("c/x", "a.md"), ("c/x", "a.1.md"), ("c/x", "a.2.md"), ("c/x", "a.4.md"), ("c/y", "a.md")], "folder string, name string")
    got = {(r.folder, r.name, r.target) for r in documents.archive_moves(files, archived, "_final.md").collect()}
    assert got == {("c/x", "a.md", "_archive/a.3.md"), ("c/x", "old.tar.md", "_archive/old.tar.md")}


def test_bundles_route_rows(spark):
    one = {**GOOD, "building_built_year": 2020}
    rows = spark.createDataFrame([{**one, "listing_id": n, "bundle": b} for n, b in (("1", "p"), ("2", "same"), ("3", None), ("4", "none"), ("5", "bare"))])
    documents_ = pages.RULE_BUNDLES["plain"]
    parts = spark.createDataFrame([(b, p, d) for b in ("p", "same") for p, d in documents_.items()] + [("bare", "S2", '{"weights": {}}')], "bundle string, part string, document string")
    assert [names for names, _ in bundled.plans(parts)] == [["bare"], ["p", "same"]]
    got = {r.listing_id: r for r in bundled.evaluate(rows, index(spark, TOWN), 2024, parts).collect()}
    assert got["1"].overall_score == got["2"].overall_score and got["1"].summary == got["2"].summary and set(got["1"].summary) == {"ko", "ja"}
    assert got["1"].queries["ja"] == ["1K 賃貸", "星野 徒歩8分"]
    assert all(got[n].overall_score is None and got[n].template_id is None for n in "34")
    assert (got["5"].overall_score, got["5"].overall_grade, got["5"].risk_flags, got["5"].template_id) == (0.0, "D", [], None)
    broken = spark.createDataFrame([("b", "S2", '{"features": [{"component": "cost", "input_key": "x", "method": "guess"}]}')], "bundle string, part string, document string")
    with pytest.raises(bundled.BundleError, match="bundle b"):
        bundled.plans(broken)
