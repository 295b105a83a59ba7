"""Substring dedup against a table of all windows."""

import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from leaselight.llm import recompress

WINDOW = 20


def plain(rows):
    """Removed word places by row; rows are (doc_id, text)."""
    last = float("inf")
    words = [(t or "").encode().split() for _, t in rows]
    keys = [last if i is None else i for i, _ in rows]
    first = {}
    for key, own in zip(keys, words):
        for s in range(len(own) - WINDOW + 1):
            gram = tuple(own[s : s + WINDOW])
            first[gram] = min(first.get(gram, last), key)
    out = []
    for key, own in zip(keys, words):
        seen, gone = set(), set()
        for s in range(len(own) - WINDOW + 1):
            gram = tuple(own[s : s + WINDOW])
            if first[gram] < key or gram in seen:
                gone |= set(range(s, s + WINDOW))
            seen.add(gram)
        out.append((len(own), len(gone), b" ".join(w for i, w in enumerate(own) if i not in gone).decode()))
    return out


def texts(rng):
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "The", "the"]
    free = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passages = [free(rng.randrange(15, 60)) for _ in range(12)] + [["a"] * 70, ["a", "b"] * 30, ["x", "y", "y", "z"] * 12]
    out = []
    for _ in range(150):
        words = free(rng.randrange(60))
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            words += p[a:] if rng.random() < 0.5 else p
            words += free(rng.randrange(3))
        out.append(rng.choice([" ", "\n", "\t "]).join(words))
    return out + [out[3], out[7], out[7].replace("w1", "W1"), None, "", " ", " ".join(["a"] * 19), " ".join(["a"] * 20), " ".join(["a"] * 21)]


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, N_words string").repartition(3)
    want = sorted((-1 if i is None else i, t or "", *r) for (i, t), r in zip(rows, plain(rows)))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "", r.n_words, r.n_removed, r.kept_text) for r in recompress.dedup(df).collect())
    assert got == want


def test_against_all_windows(spark):
    for seed in (1, 2):
        rng = random.Random(seed)
        own = texts(rng)
        ids = list(range(len(own)))
        rng.shuffle(ids)
        check(spark, list(zip(ids, own)))


def test_repeated_and_missing_ids(spark):
    own = texts(random.Random(3))
    rows = [(i // 2 if i % 5 else None, t) for i, t in enumerate(own)]
    check(spark, rows + rows[20:40])


def thue_morse(n, a="a", b="b"):
    return [b if i.bit_count() % 2 else a for i in range(n)]


def test_words_and_texts_that_polynomials_confuse(spark):
    """Thue-Morse sequences and their complements share any polynomial hash modulo 2**64, be they letters or words."""
    rng = random.Random(6)
    own = [f"w{i}" for i in range(19)]
    u, v = "".join(thue_morse(2048)), "".join(thue_morse(2048, "b", "a"))
    rows = [(0, " ".join([*own, u])), (1, " ".join([*own, v])), (2, " ".join(thue_morse(2048, "le", "la"))), (3, " ".join(thue_morse(2048, "la", "le")))]
    assert [plain(rows)[i][1] for i in (0, 1)] == [0, 0]
    for i, size in enumerate((7, 8, 9, 16, 127, 128, 129, 1024, 4096)):  # words that differ in one letter only
        word = "".join(rng.choices("ab", k=size))
        at = rng.randrange(size)
        rows += [(10 + 3 * i + k, " ".join([*(f"v{i}x{j}" for j in range(19)), w])) for k, w in enumerate((word, word, word[:at] + "c" + word[at + 1 :]))]
    check(spark, rows)


def test_many_rows_without_an_id(spark):
    own = texts(random.Random(7))
    check(spark, [(None if i % 3 else i, t) for i, t in enumerate(own)] + [(None, own[0])] * 70)
    check(spark, [(None, t) for t in own])


def test_many_rows_of_one_id(spark):
    """Texts of one id do not remove from each other, but are removed from and remove by what stands before and after them."""
    own = texts(random.Random(8))
    check(spark, [(i if i < 20 or i > 140 else 50, t) for i, t in enumerate(own)] + [(50, own[3])] * 70 + [(200, own[i]) for i in range(15, 30)] * 5)


def test_work_follows_the_rows_of_one_id(spark):
    """4,000 rows of one id are told no more than as many ids are."""
    rng = random.Random(9)
    rows = [(7, " ".join(rng.choices([f"w{i}" for i in range(5000)], k=300))) for _ in range(4000)]
    began = time.monotonic()
    found = recompress.dedup(spark.createDataFrame(rows, "doc_id long, text string")).agg(F.sum("n_removed"), F.sum("n_words")).first()
    assert tuple(found) == (0, 4000 * 300) and time.monotonic() - began < 60  # quadratic work took over 60 s for 1,000


def test_equal_windows_have_equal_anchors():
    rng = random.Random(4)
    parse = recompress.Parse(pa.array(texts(rng)), WINDOW)
    by_gram = {}
    for s, name in zip(parse.starts.tolist(), parse.anchors().tolist()):
        by_gram.setdefault(tuple(parse.names[s : s + WINDOW].tolist()), set()).add(name)
    assert all(len(names) == 1 for names in by_gram.values()) and len(by_gram) > 1000


def test_words_and_spans():
    own = ["a b\x0bc\x85d  é", None, "", " x", "x", "\n", "ab", "b\x1cc", "é x" * 30]
    parse = recompress.Parse(pa.array(own).slice(0), 2)
    words = [w for t in own for w in (t or "").encode().split()]
    assert parse.counts.tolist() == [len((t or "").encode().split()) for t in own]
    assert len({*zip(words, parse.names.tolist())}) == len({*words}) == len({*parse.names.tolist()})
    assert recompress.Parse(pa.array(own).slice(3, 3), 2).counts.tolist() == [1, 1, 0]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert recompress.dedup(df).count() == 0
    assert recompress.dedup(df.select("doc_id", F.lit("a b").alias("text"))).columns == ["doc_id", "text", "n_words", "n_removed", "kept_text"]
