"""Fingerprints and components against definitions spelled out."""

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from leaselight.llm import simhash


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(prints, radius=2, alike=lambda i, j: True):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius and alike(i, j):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [root(i) for i in range(len(prints))]


def clustered(rng, n):
    """Random points, dense balls, and chains that only links across cuts hold together."""
    out = [rng.getrandbits(64) for _ in range(n // 2)] + [0]
    while len(out) < n:
        p = rng.choice(out)
        for _ in range(rng.randrange(1, 4)):
            p ^= 1 << rng.randrange(64)
        out.append(p)
    return list(dict.fromkeys(out))


def test_fingerprints():
    rng = random.Random(3)
    texts = [None, "", " \n", "One", "one Two", "A b\x0bC d\x1ce é  É", *(" ".join(rng.choices("ab Cd é ef".split(), k=k)) for k in range(1, 60))]
    assert [simhash.fingerprint(t) for t in texts] == [plain_print(t) for t in texts]


def test_links_within():
    rng = random.Random(4)
    points = clustered(rng, 600)
    simhash_block, simhash.BLOCK = simhash.BLOCK, 2_000
    try:
        label = simhash.link_within(np.array(points, dtype=np.uint64), np.ones(len(points), dtype=bool), 2)
    finally:
        simhash.BLOCK = simhash_block
    assert label.tolist() == plain_components(points)


def test_components_over_shards(spark):
    rng = random.Random(5)
    points = clustered(rng, 3000)
    signed = np.array(points, dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(p, p) for p in signed], "node long, simhash long").repartition(3)
    edges = simhash.links(df, shard_size=100, sample_size=1000)
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    want = plain_components(points)
    groups, mine = {}, {}
    for p, w in zip(signed, want):
        groups.setdefault(w, set()).add(p)
        mine.setdefault(got.get(p, p), set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_shards_beyond_the_sample_are_dealt_in_blocks(spark):
    """Few points of the sample, so that shards stay large: no task meets more than its rows, no link is lost."""
    rng = random.Random(11)
    points = clustered(rng, 2000)
    signed = np.array(points, dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(p, p) for p in signed], "node long, simhash long").repartition(3)
    want = plain_components(points)
    for task_rows in (200, 700):
        got = {r.node: r.root for r in simhash.components(simhash.links(df, shard_size=100, sample_size=100, task_rows=task_rows)).collect()}
        groups = {}
        for p, w in zip(signed, want):
            groups.setdefault(w, set()).add(got.get(p, p))
        assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)


def test_shards_of_uniform_points_stay_bounded():
    """Routed as ten million: the figures that the README states."""
    rng = np.random.default_rng(12)
    n, every = 10_000_000, 77
    tree = simhash.VantageTree(rng.integers(0, 2**64, n // every, dtype=np.uint64), every, simhash.SHARD_SIZE, 2)
    points, rows = rng.integers(0, 2**64, 200_000, dtype=np.uint64), {}
    homes = np.zeros(len(points), dtype=np.int64)
    for shard, places, side in tree.route(points):
        rows[shard] = rows.get(shard, 0) + len(places)
        homes[places] += side == 0
    assert (homes == 1).all()  # every point meets its own shard once
    assert max(rows.values()) * n / len(points) < 55_000 and sum(rows.values()) < 11 * len(points)


def test_verified_links():
    rng = random.Random(6)
    points = clustered(rng, 300)
    kinds = np.array([rng.choice([0, 0, 1]) for _ in points])
    label = simhash.link_within(np.array(points, dtype=np.uint64), np.ones(len(points), dtype=bool), 5, lambda i, others: kinds[others] == kinds[i])
    assert label.tolist() == plain_components(points, 5, lambda i, j: kinds[i] == kinds[j]) != plain_components(points, 5)


def edited(rng, words, edits):
    out = list(words)
    for at in rng.sample(range(len(out)), edits):
        out[at] = f"new{rng.randrange(10**6)}"
    return out


def jaccard(a, b):
    x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_similar_texts(spark):
    """Near copies of 0.85 and more link, texts that only share a passage do not; small blocks change nothing."""
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(60)]
    texts = [passage + [f"w{rng.randrange(5000)}" for _ in range(150)] for _ in range(120)]
    copies = [(i, edited(rng, texts[i], 3)) for i in range(40)]
    assert all(jaccard(texts[i], c) > 0.83 for i, c in copies)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(1000 + i, " ".join(c).upper()) for i, c in copies] + [(2000, None), (2001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept, size = [], simhash.similar_links.__defaults__
    for group_size in (simhash.GROUP_SIZE, 20):
        simhash.similar_links.__defaults__ = (group_size,)
        try:
            found = simhash.near_duplicates(docs, shingle=5, radius=14, similarity=0.8)
            kept.append({r.doc_id: r.component_id for r in found.collect()})
        finally:
            simhash.similar_links.__defaults__ = size
    assert kept[0] == kept[1] == {i: i for i in range(120)} | {1000 + i: i for i, _ in copies} | {2000: 2000, 2001: 2000}


def test_sketches():
    rng = random.Random(8)
    for n, edits in ((30, 1), (400, 10), (3000, 60)):
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        other = edited(rng, words, edits)
        one, two = (np.frombuffer(simhash.profile(" ".join(t))[1], dtype=np.uint8) for t in (words, other))
        assert abs(float(simhash.estimated_similarity(one, two[None])[0]) - jaccard(words, other)) < 0.1
    assert simhash.profile(None) == (0, bytes(simhash.BINS), []) and simhash.profile("a b")[0] == simhash.fingerprint("a b", 5)


def test_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(2000, 2300)] + [(5, 5)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 1000 for i in [1000, *range(2000, 2300)]}


def test_documents(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(5, base, "a"), (3, base, "b"), (9, base.upper(), None), (7, "quite another text here", "c"), (None, base, "d"), (8, None, "e"), (4, " ", "f"), (6, "", "g"), (7, "quite another text here", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    found = simhash.near_duplicates(df)
    got = sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in found.collect())
    assert len(got) == 9 and {c for i, _, c in got if i in (5, 3, 9, -1)} == {3} and {c for i, _, c in got if i in (8, 4, 6)} == {4}
    assert all(p == f"{plain_print(t):016x}" for i, t, _ in rows for d, p, _ in got if d == (i or -1))
    kept = simhash.keep_one(df, found)
    assert kept.columns == df.columns and sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 3, 4, 7]
    assert simhash.near_duplicates(df.where(F.lit(False))).count() == 0


def test_repeated_lines(spark):
    """One line more, once or many times, leaves the set of shingles nearly as it is, whatever it does to the fingerprint."""
    rng = random.Random(9)
    texts = {}
    for i, (n, k) in enumerate([(100, 5), (120, 6), (300, 10)] * 20):
        body, line = ([f"w{rng.randrange(10**6)}" for _ in range(m)] for m in (n, 8))
        texts[i], texts[1000 + i] = body + line, body + line * k
    assert sum((simhash.fingerprint(" ".join(texts[i]), 5) ^ simhash.fingerprint(" ".join(texts[1000 + i]), 5)).bit_count() > 14 for i in range(60)) > 20
    assert all(jaccard(texts[i], texts[1000 + i]) > 0.9 for i in range(60))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    found = simhash.near_duplicates(docs, shingle=5, radius=14, similarity=0.8)
    assert {r.doc_id: r.component_id for r in found.collect()} == {i: i % 1000 for i in texts}


def test_links_at_the_threshold(spark):
    """Pairs on both sides of the similarity, against the Jaccard similarity of words; blocks of any size change nothing."""
    rng = random.Random(10)
    texts, alike = {}, []
    for i in range(200):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([30, 150, 600]))]
        texts[i], texts[1000 + i] = words, edited(rng, words, max(1, round(len(words) * rng.uniform(0.01, 0.035))))
        alike.append(jaccard(texts[i], texts[1000 + i]))
    assert sum(0.77 < x < 0.8 for x in alike) > 15 < sum(0.8 <= x < 0.83 for x in alike)
    chain = [f"w{rng.randrange(10**6)}" for _ in range(600)]
    for i in range(2000, 2030):  # one rough component; every text is near the one before, few are near others
        texts[i], chain = chain, edited(rng, chain, rng.choice([8, 12, 14]))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    ids = list(texts)
    shingles = [{tuple(texts[i][k : k + 5]) for k in range(len(texts[i]) - 4)} for i in ids]
    near = lambda i, j: len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])
    roots = plain_components([0] * len(ids), 0, near)
    size = simhash.EXACT_SIZE
    for simhash.EXACT_SIZE in (size, 4):
        try:
            got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, shingle=5, similarity=0.8).collect()}
        finally:
            simhash.EXACT_SIZE = size
        assert got == {i: ids[r] for i, r in zip(ids, roots)}


def test_similarity_asks_the_fingerprints(spark, monkeypatch):
    """Near fingerprints alone make candidates: with sketches that find nothing, an appended word is still found."""
    words = [f"w{i}" for i in range(600)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, " ".join(reversed(words))), (4, ""), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near = int(simhash.fingerprint(rows[0][1], 5) ^ simhash.fingerprint(rows[1][1], 5)).bit_count()
    monkeypatch.setattr(simhash, "similar_links", lambda classes, similarity: spark.createDataFrame([], "a long, b long"))
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, shingle=5, radius=max(2, near), similarity=0.8).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}
