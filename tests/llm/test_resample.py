"""Resampling against plain counts, and the suffix arrays against plain n-grams."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from leaselight.llm import queries, resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def features(text, size=2):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, size + 1) for i in range(len(w) - k + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % resample.BUCKETS


def plain(docs, target):
    s, t = (Counter(bucket(f) for text in texts for f in features(text)) for texts in ([d[1] for d in docs], target))
    S, T, n = sum(s.values()), sum(t.values()), resample.BUCKETS
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + n) / ((s[b] + 1) * (T + n))))
    rows = []
    for doc_id, text in docs:
        f = features(text)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text)) >= 20])
    rated = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for i, r in enumerate(rated[: 25 * len(rated) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def write(spark, tmp_path, docs, target):
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return sorted(map(tuple, queries.op12_resample(spark, str(tmp_path)).collect()), key=repr)


def test_query_equals_plain_counts(spark, tmp_path):
    vocabulary = ["Alpha", "beta", "GAMMA", "été", "ÉTÉ", "数", "7", "x_y", "a-b"]
    docs = [(i, " ".join(vocabulary[(i * j + j // 3) % len(vocabulary)] for j in range(i % 60))) for i in range(120)]
    docs += [(1, docs[50][1]), (1, docs[50][1]), (None, docs[50][1]), (None, None), (500, ""), (501, "!!! \t\n"), (502, "word " * 60_000), (503, "un" * 100_000)]
    target = ["beta gamma alpha", "beta", None, "", "数 été"]
    assert write(spark, tmp_path, docs, target) == plain(docs, target)


def test_nothing_to_draw_from(spark, tmp_path):
    assert write(spark, tmp_path, [], ["a b"]) == []


def test_no_target_and_few_words(spark, tmp_path):
    docs = [(1, "a b c"), (2, None)]
    found = write(spark, tmp_path, docs, [])
    assert found == plain(docs, []) and all(r[4] is None for r in found)


def test_extra_columns_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b " * 20, 5, 6, "kept")], "doc_id long, text string, rank int, Weight int, more string")
    found = resample.resample(docs, docs.select("text"), percent=100)
    assert found.columns == ["doc_id", "text", "more", "n_words", "n_features", "weight", "score", "rank"]
    assert found.first()["rank"] == 1


@pytest.mark.parametrize("size", [1, 2, 3])
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.text(alphabet="aAbB é-", max_size=40), max_size=6))
def test_suffix_arrays_enumerate_every_ngram(size, texts):
    found, of, n_words = resample.buckets([t.encode() for t in texts], size, 97)
    assert n_words.tolist() == [len(words(t)) for t in texts]
    for i, t in enumerate(texts):
        for k in range(size):
            own = found[k][of == i]
            w = words(t)
            assert own.tolist() == [zlib.crc32(" ".join(w[j : j + k + 1]).encode()) % 97 if j + k < len(w) else -1 for j in range(len(w) + 1)]


def test_a_run_is_hashed_once(monkeypatch):
    seen = []
    monkeypatch.setattr(resample.zlib, "crc32", lambda b, before=0: seen.append(b) or len(seen))
    resample.buckets([b"to be or not to be", b"to be"])
    assert sorted(seen) == sorted({b"to", b"be", b"or", b"not", b" be", b" or", b" not", b" to"})


def test_gain_rounds_down():
    assert resample.gains(np.array([3, 0]), np.array([0, 3])).tolist() == [math.floor(1000 * math.log(5 / 20)), math.floor(1000 * math.log(20 / 5))]
