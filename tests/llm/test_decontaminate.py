"""Decontamination against a scan of every window, on both ways of joining."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from leaselight.llm import decontaminate


def plain(text, items, n=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own, hit, ids = split(text), set(), set()
    for item_id, item in items:
        words = split(item)
        size = min(n, len(words))
        grams = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()
        for i in range(len(own) - size + 1):
            if size and tuple(own[i : i + size]) in grams:
                hit |= set(range(i, i + size))
                ids.add(item_id)
    return len(own), len(hit), sorted(str(i) for i in ids if i is not None)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(2)
    words = ["the", "Of", "and", "x1", "é", "to", "in"]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 25)))) for i in range(30)] + [(3, "the of"), (None, "a null id item of more than ten words here to be found"), (40, None), (41, ""), (1, "zz"), (1, "zz")]
    docs = []
    for i in range(120):
        passage = rng.choice(items)[1] or ""
        docs.append((i, " ".join(rng.choices([*words, "other", "word"], k=rng.randrange(0, 40))) + (f"\n{passage.upper()}! end" if i % 3 == 0 else ""), "n"))
    docs += [(200, None, None), (201, "", "x"), (5, "zz", "x"), (5, "zz", "x"), (None, "zz zz", "x")]
    return (spark.createDataFrame(docs, "doc_id long, text string, n_words string"), spark.createDataFrame(items, "item_id long, text string"), items)


@pytest.mark.parametrize("bound", [decontaminate.BROADCAST_BYTES, 0])
def test_against_every_window(tables, bound):
    docs, benchmark, items = tables
    found = decontaminate.find(docs, benchmark, broadcast_bytes=bound).collect()
    assert len(found) == docs.count()
    for r in found:
        assert (r.n_words, r.n_hit, r.item_ids) == plain(r.text, items), r.text
        assert sum(len(decontaminate.words(r.text[s.begin : s.end])) for s in r.spans) == r.n_hit


def test_removal(tables):
    docs, benchmark, items = tables
    found = decontaminate.find(docs, benchmark)
    assert {r.n_hit for r in decontaminate.drop_documents(found).collect()} == {0}
    cleaned = {(r.doc_id, r.text) for r in decontaminate.remove_spans(found).collect()}
    assert (5, " ") in cleaned and (200, None) in cleaned and (201, "") in cleaned


def test_empty_tables(tables):
    docs, benchmark, _ = tables
    none = F.lit(False)
    assert decontaminate.find(docs.where(none), benchmark).count() == 0
    assert {r.n_hit for r in decontaminate.find(docs, benchmark.where(none)).collect()} == {0}


def test_few_windows_enter_the_join(spark):
    """Beyond the broadcast, the filter holds back nearly every window that the benchmark lacks, and none that it has."""
    rng = random.Random(4)
    items = [" ".join(rng.choices([f"b{i}" for i in range(400)], k=rng.randrange(3, 40))) for _ in range(200)]
    sizes = sorted({min(10, len(t.split())) for t in items})
    frame = spark.createDataFrame([(t,) for t in items], "item_text string").repartition(3)
    n_windows = sum(len(decontaminate.windows(t.encode().split(), 10)) for t in items)
    bloom = decontaminate.bloom_filter(frame, sizes, 10, n_windows)
    bits = len(bloom) * 64
    passes = lambda h: bool(np.all([bloom[int(at[0]) >> 6] >> np.uint64(int(at[0]) & 63) & np.uint64(1) for at in decontaminate.bloom_bits(np.array([h], dtype=np.uint64), bits)]))
    for t in items:
        own = t.encode().split()
        (_, hashes), = decontaminate.window_hashes(own, [min(10, len(own))])
        assert all(map(passes, hashes.tolist()))
    other = decontaminate.window_hashes([f"o{i}".encode() for i in range(5000)], sizes)
    assert np.mean([passes(h) for _, hashes in other for h in hashes[:300].tolist()]) < 0.06
