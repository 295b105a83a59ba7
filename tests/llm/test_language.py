"""Language identification: features, training, edge cases, and held-out accuracy."""

import math
import random
import unicodedata
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from leaselight.llm import language, queries

WORDS = {"en": "the and of with that there house water thing", "de": "der und nicht über straße schön haus wasser ding", "fr": "le et où très être maison eau chose déjà"}


def rows(rng, n):
    out = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        out.append((i, " ".join(rng.choices(WORDS[lang].split(), k=rng.randrange(3, 40))), lang))
    return out


def test_counts_are_all_ngrams():
    text = "Añb añb"
    low = text.lower()
    want = sum(len(low) - k + 1 for k in language.SIZES)
    assert language.counts(text).sum() == want and language.counts("").sum() == 0
    grams = Counter(low[i : i + k] for k in language.SIZES for i in range(len(low) - k + 1))
    assert sorted(language.counts(text)[language.counts(text) > 0].tolist()) == sorted(grams.values())


def test_frequencies_count_all_documents(spark):
    own = rows(random.Random(2), 60)
    df = spark.createDataFrame(own, "doc_id long, text string, lang string").repartition(4)
    got = language.document_frequencies(df)
    want = np.zeros(language.DIM + 1, dtype=np.int64)
    for _, t, _ in own:
        want[:-1] += language.counts(t) > 0
        want[-1] += 1
    assert (got == want).all()


def test_fit_and_identify(spark):
    own = rows(random.Random(3), 300)
    df = spark.createDataFrame([(i, t, lang if i % 9 else None, "x") for i, t, lang in own], "doc_id long, text string, lang string, SCORE string")
    model = language.fit(df.where("doc_id < 200"))
    again = language.fit(df.where("doc_id < 200").repartition(3))
    assert model.languages == ("de", "en", "fr") and np.allclose(model.weights, again.weights)
    assert 0 < (model.weights != 0).mean() < 0.5  # the penalty leaves most weights zero
    odd = spark.createDataFrame([(1000, None, None, "x"), (1001, "", None, "x"), (1002, "12 + 3 = 15 !", None, "x"), (1003, "½ ² ① Ⅷ 々".replace("々", "") + "_", None, "x"), (None, "où très", "fr", "x")], df.schema)
    out = language.identify(df.union(odd), model).collect()
    got = {r.doc_id: (r.lang_pred, r.score) for r in out}
    assert all(got[i][0] == lang for i, _, lang in own if i >= 200)
    assert got[1000] == got[1001] == got[1002] == got[1003] == ("und", 0.0) and got[None][0] == "fr"
    assert all(0 <= s <= 1 for _, s in got.values())


def plain_guess(model, text):
    """Features and probabilities once more, n-gram by n-gram."""
    if not any(unicodedata.category(c).startswith("L") for c in text or ""):
        return "und", 0.0
    low, found = text.lower(), Counter()
    for size in (1, 2, 3):
        for i in range(len(low) - size + 1):
            value = 0
            for k in range(size):
                value = (value * 0x9E3779B97F4A7C15 + ord(low[i + k]) + k + 1) % 2**64
            found[((value ^ value >> 31) * 0xBF58476D1CE4E5B9 % 2**64) >> (64 - language.BITS)] += 1
    x = {f: math.log(1 + n) * model.idf[f] for f, n in found.items()}
    norm = math.sqrt(sum(v * v for v in x.values()))
    logits = [(sum(v / norm * model.weights[f][k] for f, v in x.items()) + model.bias[k]) / model.temperature for k in range(len(model.languages))]
    p = [math.exp(v - max(logits)) for v in logits]
    return model.languages[p.index(max(p))], max(p) / sum(p)


def test_guesses_against_plain_loops(spark):
    own = rows(random.Random(5), 120) + [(500, "Ünïcode ½ 日本語 text", "en"), (501, "²", "en"), (502, "a", "de"), (503, None, "fr"), (504, "der " * 3000, "de")]
    df = spark.createDataFrame(own, "doc_id long, text string, lang string")
    model = language.fit(df.where("doc_id % 5 <> 0"))
    for r in language.identify(df, model).collect():
        lang, score = plain_guess(model, r.text)
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-9), r.text


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    model = language.fit(df)
    assert [(r.lang_pred, r.score) for r in language.identify(df, model).collect()] == [("und", 0.0)]
    assert language.identify(df.where(F.lit(False)), model).count() == 0


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="needs the driver's tables")
def test_held_out_accuracy(spark):
    data = "/root/testdata/sf0.01"
    found = queries.op8_language(spark, data).where("held_out").join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n = found.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.count("*")).first()
    assert n > 100 and right > 0.98


def test_a_language_of_one_id_is_learnt(spark):
    """However its hash falls: every text of one id counts, and rows that repeat count once."""
    rng = random.Random(8)
    words = {"en": "the of and water night house was with people".split(), "de": "der und nicht wasser haus ist mit leute durch".split()}
    text = lambda lang: " ".join(rng.choices(words[lang], k=12))
    for one in ("k2", "d1", "k5"):
        own = [(f"e{i}", text("en"), "en") for i in range(2000)] + [(one, text("de"), "de") for _ in range(2000)] + [("same", "der die das", "nl")] * 2000
        model = language.fit(spark.createDataFrame(own, "doc_id string, text string, lang string"))
        asked = spark.createDataFrame([(1, text("de")), (2, text("en"))], "doc_id long, text string")
        assert model.languages == ("de", "en", "nl")
        assert {r.doc_id: r.lang_pred for r in language.identify(asked, model).collect()} == {1: "de", 2: "en"}


def test_empty_tables(spark):
    own = spark.createDataFrame([("a", "the night", "en")], "doc_id string, text string, lang string")
    assert language.fit(own.where("false")).languages == ()
    assert language.identify(own.where("false"), language.fit(own)).collect() == []
