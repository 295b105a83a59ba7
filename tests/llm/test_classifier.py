"""The compression classifier: blocks, fitting on marked text, and held-out accuracy."""

import math
import random
from pathlib import Path

import pytest
import zstandard
from pyspark.sql import functions as F

from leaselight.llm import classifier, queries


def corpus(rng, n):
    good = ["river", "stone", "evening", "walked", "quiet", "the", "and", "window", "letter", "garden"]
    bad = ["WIN!!!", "$$$", "click", "###", "free%%%", "BUY", "now&&&", "!!!"]
    rows = []
    for i in range(n):
        label = int(rng.random() < 0.7)
        rows.append((i, " ".join(rng.choices(good if label else bad, k=rng.randrange(5, 300))), label))
    return rows


def test_fit_and_score(spark):
    rows = corpus(random.Random(1), 400)
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(900, None, "s"), (901, "", "s"), (1, rows[1][1], "s"), (None, "river", "s")], "doc_id long, text string, Score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 300] + [(5000, 1), (7, None), (None, 0), (0, rows[0][2])], "doc_id long, quality int")
    model = classifier.fit(docs, labels)
    out = classifier.score(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    got = {r.doc_id: r.score for r in out}
    assert all((got[i] >= 0.5) == bool(y) for i, _, y in rows if i >= 300)
    assert got[900] == got[901]
    again = classifier.fit(docs.repartition(5), labels.repartition(2))
    assert again == model


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    for labels in ([], [(1, 1)]):
        model = classifier.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert [r.score for r in classifier.score(docs, model).collect()] == [0.5]
    assert classifier.score(docs.where(F.lit(False)), model).count() == 0


def test_labels_without_documents_and_repeated_ids(spark):
    rows = corpus(random.Random(3), 300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] * 3 + [(0, "another text")] * 500, "doc_id long, text string")
    own = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    strangers = spark.range(10_000, 310_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    model = classifier.fit(docs, own.union(strangers))
    assert model == classifier.fit(docs.distinct(), own) and model.good and model.bad


def test_long_texts_are_learnt_from(spark):
    """Blocks come from all along a text, however long it is."""
    rng = random.Random(4)
    long = lambda y: " ".join([*rng.choices(["river", "stone", "evening", "quiet"] if y else ["WIN!!!", "$$$", "BUY", "free%%%"], k=6000)])
    docs = spark.createDataFrame([(i, long(i % 2)) for i in range(160)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).where("doc_id < 120")
    assert docs.where(F.length("text") <= 20_000).count() == 0
    model = classifier.fit(docs, labels)
    assert model.good and model.bad
    assert all((r.score >= 0.5) == bool(r.doc_id % 2) for r in classifier.score(docs, model).where("doc_id >= 120").collect())


def test_blocks_of_a_long_text_are_spread_over_it():
    text = "".join(f"{i:08d}" for i in range(50_000))
    own, picked = classifier.blocks(text), classifier.sampled_blocks(text)
    at = [own.index(b) for b in picked]
    assert len(picked) == classifier.TEXT_BLOCKS and at == sorted(at)
    assert all(any(lo <= i < lo + len(own) // 4 for i in at) for lo in range(0, len(own) - len(own) // 4, len(own) // 4))
    assert classifier.sampled_blocks("short") == classifier.blocks("short")



def test_scores_against_plain_compression(spark):
    """Every score once more, block by block, from what the model holds."""
    rows = corpus(random.Random(5), 250) + [(900, None, 1), (901, "", 0), (902, "river stone é " * 4000, 1)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = classifier.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"))
    packed = lambda data, content: sum(len(zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=False, write_checksum=False, write_dict_id=False).compress(data[i : i + 512])) for i in range(0, max(1, len(data)), 512))
    texts = {i: (t or "").encode() for i, t, _ in rows}
    for r in classifier.score(docs, model).collect():
        data = texts[r.doc_id]
        good, bad = packed(data, model.good), packed(data, model.bad)
        x = ((bad - good) / (bad + good), (bad + good) / 2 / (len(data) + 8), math.log1p(len(data)))
        total = model.intercept + sum((v - m) / s * w for v, m, s, w in zip(x, model.mean, model.scale, model.weights))
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)


def test_blocks_cover_whole_texts():
    text = "é" * 10_000
    assert b"".join(classifier.blocks(text)).decode() == text and classifier.blocks("") == [b""]


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="needs the driver's tables")
def test_held_out_accuracy(spark):
    data = "/root/testdata/sf0.01"
    found = queries.op2_classifier(spark, data).where("held_out").join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id")
    right, n = found.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert n > 50 and right > 0.93
