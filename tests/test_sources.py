"""Readers, writers, upkeep of market rows, streams and the driver's entry points."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from leaselight import catalog, spec
from leaselight.operators import benchmark, bundles, documents, market
from leaselight.plans import pages
from leaselight.sources import readers, sinks
from leaselight.streaming import listings as stream
from tests.test_rules import GOOD, TOWN, index

ROWS = [{"prefecture": "tokyo", "municipality": "月見市", "layout_type": "1K", "building_structure": s, "avg_rent_yen": r, "source_name": "a"} for s, r in (("", "95000.0"), ("rc", " 100000"), ("wood", "80000"))]


def test_market_rows(spark, tmp_path):
    (tmp_path / "rows.json").write_text(json.dumps(ROWS))
    (tmp_path / "rows.csv").write_text(",".join(ROWS[0]) + "\n" + "\n".join(",".join(r.values()) for r in ROWS))
    for kind in ("json", "csv"):
        got = readers.market_rows(spark, f"{tmp_path}/rows.{kind}").collect()
        assert sorted((r.building_structure, r.avg_rent_yen) for r in got) == [("all", 95_000), ("rc", 100_000), ("wood", 80_000)]
        assert got[0].source_url is None
    with pytest.raises(ValueError):
        readers.market_rows(spark, "rows.xls")
    sinks.write_market_rows(readers.market_rows(spark, f"{tmp_path}/rows.json"), f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out/json").count() == 3
    for kind in ("json", "csv"):  # what is written is read again
        assert sorted(r.avg_rent_yen for r in readers.market_rows(spark, f"{tmp_path}/out/{kind}").collect()) == [80_000, 95_000, 100_000]
    built = readers.load_or_build_index(spark, f"{tmp_path}/index", [f"{tmp_path}/no.json", f"{tmp_path}/rows.json"])
    assert readers.load_or_build_index(spark, f"{tmp_path}/index", []).count() == built.count() == 4
    with pytest.raises(FileNotFoundError):
        readers.load_or_build_index(spark, f"{tmp_path}/none", [f"{tmp_path}/no.csv"])


def test_pasted_and_reports(spark, tmp_path):
    lines = spark.createDataFrame([("region_country,prefecture",), ("JP,tokyo,月見市,1K,rc,90000,a,u,2024,2024,\"n, m\"",), ("JP,tokyo,月見市,1K,80000,a,u,2024,2024,n",), ("JP,tokyo,,1K,80000,a,u,2024,2024,n",), ("x",)], "value string")
    got = readers.pasted_rows(lines).orderBy("avg_rent_yen").collect()
    assert [(r.building_structure, r.avg_rent_yen, r.method_notes) for r in got] == [("all", 80_000, "n"), ("rc", 90_000, "n, m")]
    gone = spark.createDataFrame([("tokyo", "月見市", "1K", "src")], "prefecture string, municipality string, layout_type string, building_structure string")
    sinks.write_lines(market.report_lines(gone, spark), f"{tmp_path}/report")
    assert [tuple(r) for r in readers.missing_report(spark.read.text(f"{tmp_path}/report")).collect()] == [("tokyo", "月見市", "1K", "src")]


def test_listings_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/listing_001.json").write_text(json.dumps({k: v for k, v in GOOD.items() if k != "listing_id"}))
    assert readers.listings(spark, f"{tmp_path}/in").first().listing_id == "listing_001"
    (tmp_path / "jsonl").mkdir()
    (tmp_path / "jsonl/1.json").write_text(json.dumps(GOOD) + "\n" + json.dumps({**GOOD, "listing_id": "bad", "layout_type": "9K"}))
    scored = stream.scored(stream.read_listings(spark, f"{tmp_path}/jsonl"), index(spark, TOWN), 2024)
    stream.write_scored(scored, f"{tmp_path}/scored", f"{tmp_path}/ck").awaitTermination(120)
    assert [r.listing_id for r in spark.read.parquet(f"{tmp_path}/scored").collect()] == ["a"]


def test_caches_and_kinds(spark):
    cache = spark.createDataFrame([("u",)], "url string").select(readers.cache_key(F.col("url")).alias("cache_key"), F.lit("<p>").alias("html"))
    assert [r.html for r in readers.cached_pages(spark.createDataFrame([("u",), ("v",)], "url string"), cache).orderBy("url").collect()] == ["<p>", None]
    kinds = [spark.range(1).select(readers.document_kind(F.lit(n), ("analysis",), ("answers",))).first()[0] for n in ("analysis.md", "answers.md", "analysis answers.md", "x.md")]
    assert kinds == ["analysis", "answers", "integrated", "other"]
    files = spark.createDataFrame([("f", "a", 1, 2), ("f", "b", 1, 3), ("f", "c", 0, 9)], "folder string, path string, size int, modified int")
    assert documents.best_file(files).first().path == "b"


def test_pages_enough(spark):
    rows = spark.createDataFrame([("tokyo", "m", "1K", p, s) for p in (1, 2, 3) for s in ("wood", "rc")], "prefecture string, municipality string, layout_type string, page int, building_structure string")
    assert market.page_budget(rows, ["wood", "rc"], least=2).agg(F.max("page")).first()[0] == 2
    assert market.page_budget(rows, ["wood", "rc", "src"], least=2).count() == 6


def test_index_sources_and_keywords(spark):
    rows = spark.createDataFrame([("tokyo", "m", "1K", "rc", 10, "a", "2024"), ("tokyo", "m", "1K", "rc", 21, "a", "2024")], "prefecture string, municipality string, layout_type string, building_structure string, avg_rent_yen long, source_name string, source_updated_at string")
    top = benchmark.build_index(rows, sources=True).where("level = 'structure'").first()
    assert (top.benchmark_rent_yen_median, top.n_rows, len(top.sources)) == (15, 2, 1)
    code = spark.range(1).select(market.keyword_code(F.lit("大阪市東淀川区"), [("淀川", "1"), ("東淀川", "2")])).first()[0]
    assert code == "1"


def test_entry(spark):
    names, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(names) and len(names) >= 30
    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert spec.load  # a spec file of one's own replaces parts of the built-in one


def test_bundles(spark, tmp_path, monkeypatch):
    one = pages.bundles(spark.range(13, 14), "id")
    texts = {r.part: r.document for r in one.collect()}
    (tmp_path / "spec_v0.1.2").mkdir()
    (tmp_path / "spec_v0.1.2" / bundles.WHOLE).write_text("{" + ",".join(f'"{p}":{d}' for p, d in texts.items()) + "}")
    (tmp_path / "spec_v0.1.10").mkdir()
    for part, file in bundles.FILES.items():
        (tmp_path / "spec_v0.1.10" / file).write_text(texts[part].replace("DEAR", "LOST"))
    whole, loose = (bundles.read(spark, str(tmp_path / f"spec_v0.1.{n}")) for n in (2, 10))
    assert {r.part for r in whole.collect()} == {"S1", "S2", "C1", "D1", "V0"} and bundles.findings(whole).count() == 0
    vocabulary = one.where("part = 'V0'").withColumn("bundle", F.lit(str(tmp_path / "spec_v0.1.10")))
    found = bundles.findings(loose.unionByName(vocabulary)).collect()
    assert [(r.code, r.place, r.name) for r in found] == [("RISK_FLAG_ID", "S2.risk_flag_rules[0]", "LOST")]
    monkeypatch.delenv("SPEC_BUNDLE_DIR", raising=False)
    folders = ["/x/spec_v0.1.2", "/x/spec_v0.1.10", "/x/other"]
    assert bundles.newest(folders) == "/x/spec_v0.1.10" and bundles.newest(folders, "/y") == "/y" and bundles.newest([]) is None
    sinks.write_bundles(loose.unionByName(vocabulary), str(tmp_path / "out"))
    assert '"errors":1' in spark.read.text(str(tmp_path / "out" / "coherence")).first()[0].replace("\\", "") and spark.read.json(str(tmp_path / "out" / "merged")).count() == 1
    shapes = spark.createDataFrame([("b", "S1", '{"fields": {}}'), ("b", "C1", '{"rules": [{"id": 1}]}'), ("b", "S2", "no json")], "bundle string, part string, document string")
    assert sorted((r.code, r.place) for r in bundles.findings(shapes).collect()) == [("NO_ARRAY", "S1.fields"), ("NO_ARRAY", "S2.features"), ("WHEN_NOT_OBJECT", "C1.rules[0]")]


def test_repeated_urls_in_a_store(spark):
    """A wanted page comes once, however often its URL was fetched, and of named fetches its own."""
    pages_ = spark.createDataFrame([(1, "u", "<p>"), (2, "u", "<pp>"), (3, "u", "<ppp>")], "page_id int, url string, html string")
    cache = pages_.where("page_id < 3").select("page_id", readers.cache_key(F.col("url")).alias("cache_key"), "html")
    wanted = pages_.select("page_id", "url")
    assert sorted((r.page_id, r.html) for r in readers.cached_pages(wanted, cache).collect()) == [(1, "<p>"), (2, "<p>"), (3, "<p>")]
    assert sorted((r.page_id, r.html, r.found) for r in readers.cached_pages(wanted, cache, ("page_id",)).collect()) == [(1, "<p>", True), (2, "<pp>", True), (3, None, False)]


def test_written_rows_take_less_than_their_text(spark, tmp_path):
    rows = spark.range(2_000).select(*(F.lit("0").alias(c) if c == "avg_rent_yen" else F.concat(F.lit(f"some {c} "), F.col("id") % 7).alias(c) for c in market.ROW))
    sinks.write_market_rows(rows, f"{tmp_path}/out")
    assert all(sum(f.stat().st_size for f in (tmp_path / "out" / kind).iterdir()) < 60_000 for kind in ("json", "csv"))
    assert all(readers.market_rows(spark, f"{tmp_path}/out/{kind}").count() == 2_000 for kind in ("json", "csv"))


def test_arriving_rows_are_written_by_many_tasks(spark):
    """No part of the arriving rows passes through one task."""
    catalog.streamed_index(spark, "/root/testdata/sf0.001").count()
    folders = glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/arriving-*")
    assert folders and len(glob.glob(f"{max(folders, key=os.path.getmtime)}/*.parquet")) == 3 * spark.sparkContext.defaultParallelism
