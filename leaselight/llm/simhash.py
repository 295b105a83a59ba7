"""SimHash near-duplicates: exact Hamming links found through vantage-point trees.

Every text gets a 64-bit fingerprint of its word shingles.  Distinct fingerprints,
not documents, are linked, so a group of copies of any size is one point.  A tree
of vantage points, built from a bounded sample, cuts the fingerprint space into
shards: within ``mu`` of a vantage point, or beyond.  By the triangle inequality a link
across that cut joins a point at distance ``mu - radius + 1 .. mu`` to one at
``mu + 1 .. mu + radius``.  These two bands alone meet in a third shard, and are cut
further in the same way.  A shard that the sample could not cut small enough is dealt in
blocks.  Each shard finds its links exactly, by the same cuts further down, and reports
them as stars; the stars are joined to components over all shards by alternating large-
and small-star rounds.

Fingerprints count repeated shingles, a Jaccard similarity does not: of two texts with
nearly one shingle set, of which one repeats a line, they may differ by any number of
bits.  With a ``similarity`` distinct shingle sets, not documents, are linked.
Candidates are, as above, sets with fingerprints within the radius, and beside them those
that fingerprints miss: they share one of ``KEYS`` least shingle hashes (sets that are
0.8 alike share one of eight but for a chance of 0.000003) and have sketches that do not
rule the similarity out.  Candidates make rough components; within each,
the Jaccard similarity of all pairs of shingle sets is computed from the texts, and
only pairs that reach ``similarity`` link.  A crowded group, such as all texts that hold
one common passage, is dealt in blocks, so no task meets it whole.

Edge cases: a null text has no words; texts without words have fingerprint zero and
link like any other; a text of fewer words than a shingle is one shingle; repeated
rows each get a result; rows without an id get one and take part in linking, but
never name a component (null, if no member has an id).
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .arrow import give_back, text_slices, with_struct
from .scratch import cut

BITS = 64
SEED = 42
#: Rows aimed at in a shard and never exceeded in one task, and the largest sample that the tree is built from.
SHARD_SIZE, TASK_ROWS = 40_000, 120_000
SAMPLE_SIZE = 131_072
#: Points of the sample below which a shard is not cut, and rows that are routed at once.
LEAST_SAMPLE, ROUTED = 32, 200_000
#: Comparisons made at once within a shard, and shingles whose bits are counted at once.
BLOCK = 4_000_000
COUNTED = 65_536

#: Bins of the sketch of a shingle set, and least hashes that part candidates for a similarity.
BINS, KEYS = 256, 8
#: Members of a candidate group, and rows of small groups, that meet in one task.
GROUP_SIZE, GROUP_ROWS = 4_000, 4_000
#: Members of a rough component that meet in one task, by number and by characters of text.
EXACT_SIZE, EXACT_CHARS = 1_000, 8_000_000
#: Standard errors by which a sketch's estimate may fall below the similarity before a pair is no candidate (a chance of 0.0000003).
ERRORS = 5
#: Slack of links that sketches alone decide, as in ``test_pipeline``; no link is made so.
SLACK = 0.02
_MIX = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53],
    dtype=np.uint64,
)

_PRINTS = T.StructType([T.StructField("simhash", T.LongType())])
_PROFILE = T.StructType([*_PRINTS.fields, T.StructField("sketch", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("node", T.LongType())])


def shingle_hashes(text: str | None, shingle: int = 3, seed: int = SEED) -> np.ndarray:
    """Hashes of all shingles, repeats included; words are cut at ASCII white space, A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) > shingle else [b" ".join(words)]
    return np.fromiter(map(functools.partial(xxhash.xxh64_intdigest, seed=seed), grams), dtype=np.uint64, count=max(1, len(words) - shingle + 1))


def fingerprint(text: str | None, shingle: int = 3, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; zero for a text without words."""
    return _majority(shingle_hashes(text, shingle, seed))


def _majority(hashes: np.ndarray) -> int:
    n = len(hashes)
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, n, COUNTED):
        bits = np.unpackbits(hashes[i : i + COUNTED].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def profile(text: str | None, shingle: int = 5) -> tuple[int, bytes, list[int]]:
    """The fingerprint, the set's sketch (for each bin of hashes a byte of the least one, zero if it is empty) and least hashes under ``KEYS`` mixes."""
    return _profile(shingle_hashes(text, shingle))[:3]


def _profile(hashes: np.ndarray) -> tuple[int, bytes, list[int], int]:
    """As ``profile``, and a digest of the set."""
    sketch = np.zeros(BINS, dtype=np.uint8)
    if not len(hashes):
        return 0, sketch.tobytes(), [], 0
    distinct = np.unique(hashes)
    bins = distinct // np.uint64(2**64 // BINS)
    first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
    sketch[bins[first]] = distinct[first] % np.uint64(255) + np.uint64(1)
    spread = distinct ^ (distinct >> np.uint64(31))
    return _majority(hashes), sketch.tobytes(), [int((spread * m).min().view(np.int64)) for m in _MIX[:KEYS]], int(np.uint64(xxhash.xxh64_intdigest(distinct.tobytes(), seed=SEED)).view(np.int64))


def estimated_similarity(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The Jaccard similarity of a set with others, from their sketches: equal bins among those that either fills."""
    return ((others == one) & (one > 0)).sum(axis=1) / np.maximum(1, ((others > 0) | (one > 0)).sum(axis=1))


def with_fingerprints(df: DataFrame, text_col: str = "text", out_col: str = "simhash", shingle: int = 3) -> DataFrame:
    """Add the fingerprint of every whole text as a ``bigint`` that holds the 64 bits."""

    @F.arrow_udf(_PRINTS)
    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            values = np.array([fingerprint(t, shingle) for part in text_slices(texts) for t in part], dtype=np.uint64)
            yield pa.StructArray.from_arrays([pa.array(values.view(np.int64))], _PRINTS.names)

    return with_struct(df, prints(F.col(text_col)), _PRINTS, {"simhash": out_col})


def with_profiles(df: DataFrame, text_col: str = "text", shingle: int = 5) -> DataFrame:
    """Add ``simhash``, ``sketch`` and ``keys`` of every whole text, and ``node``, the digest of its set of shingles."""

    @F.arrow_udf(_PROFILE)
    def profiles(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [_profile(shingle_hashes(t, shingle)) for part in text_slices(texts) for t in part]
            prints = np.array([r[0] for r in rows], dtype=np.uint64).view(np.int64)
            yield pa.StructArray.from_arrays([pa.array(prints), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], pa.int64())], _PROFILE.names)
        give_back()

    return with_struct(df, profiles(F.col(text_col)), _PROFILE)


def distances(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


def best_cut(points: np.ndarray, a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.uint64, int] | None:
    """The vantage point, of three, and the ``mu`` that leave the least to compare; None if none parts the points.

    ``a`` and ``b`` are places of ``points`` that meet each other; without ``b`` those of ``a`` meet.
    """
    best, found = 0.9 * len(a) * len(a if b is None else b), None
    ordered = a[np.argsort(points[a], kind="stable")]
    for quarter in (1, 2, 3):
        vantage = points[ordered[len(a) * quarter // 4]]
        x = np.bincount(distances(points[a], vantage), minlength=BITS + 1)
        y = x if b is None else np.bincount(distances(points[b], vantage), minlength=BITS + 1)
        (xi, xn, xf), (yi, yn, yf) = (_bands(c, radius) for c in (x, y))
        work = xi * yi + (len(a) - xi) * (y.sum() - yi) + xn * yf + (0 if b is None else xf * yn)
        mu = int(np.argmin(work))
        if work[mu] < best:
            best, found = work[mu], (vantage, mu)
    return found


def _bands(counts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every ``mu`` how many points are within it, and how many of these, and of the others, at most ``radius`` from the cut."""
    inner = np.cumsum(counts, dtype=np.float64)
    near = inner - np.append(np.zeros(radius), inner[:-radius])
    far = np.append(inner[radius:], np.full(radius, inner[-1])) - inner
    return inner, near, far


def parted(points: np.ndarray, a: np.ndarray, b: np.ndarray | None, vantage: np.uint64, mu: int, radius: int) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """What a cut makes of sets that meet: the inner ones, the outer ones, and the bands that meet across it (two pairs of bands where two sets meet)."""
    d = distances(points[a], vantage)
    inside, near, far = d <= mu, (d <= mu) & (d > mu - radius), (d > mu) & (d <= mu + radius)
    if b is None:
        return [(a[inside], None), (a[~inside], None), (a[near], a[far])]
    e = distances(points[b], vantage)
    within, close, beyond = e <= mu, (e <= mu) & (e > mu - radius), (e > mu) & (e <= mu + radius)
    return [(a[inside], b[within]), (a[~inside], b[~within]), (a[near], b[beyond]), (a[far], b[close])]


class VantageTree:
    """Cuts of the fingerprint space: ``nodes[i]`` is (vantage point, mu, children); children below zero are shards.

    ``each`` is how many points one of the sample stands for, ``size`` how many rows a shard may have by this estimate.
    """

    def __init__(self, sample: np.ndarray, each: int, size: int, radius: int) -> None:
        self.radius, self.nodes, self.shards = radius, [], 0
        self.root = -1
        todo = [(np.arange(len(sample)), None, None, 0)]
        while todo:
            a, b, parent, child = todo.pop()
            rows, cut_at = len(a) + (0 if b is None else len(b)), None
            if rows * each > size and rows >= LEAST_SAMPLE and len(a) and (b is None or len(b)):
                cut_at = best_cut(sample, a, b, radius)
            if cut_at is None:
                self.shards += 1
                at = -self.shards
            else:
                at = len(self.nodes)
                parts = parted(sample, a, b, *cut_at, radius)
                self.nodes.append((*cut_at, [0] * len(parts)))
                todo += [(*part, at, i) for i, part in enumerate(parts)]
            if parent is None:
                self.root = at
            else:
                self.nodes[parent][2][child] = at

    def route(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray, int]]:
        """(shard, places of points, side) for every shard that they reach; all points of side 0 meet, those of side 1 meet those of side 2."""
        none = np.zeros(0, dtype=np.int64)
        todo = [(self.root, np.arange(len(points)), None)]
        while todo:
            at, a, b = todo.pop()
            if at >= 0:
                vantage, mu, children = self.nodes[at]
                parts = parted(points, a, b, vantage, mu, self.radius)
                todo += [(child, x, y) for child, (x, y) in zip(children, parts) if len(x) or len(none if y is None else y)]
            elif b is None:
                yield -at, a, 0
            else:
                yield from ((-at, places, side) for places, side in ((a, 1), (b, 2)) if len(places))


class Labels:
    """Components under growing sets of links."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.parent[a], self.parent[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))
            self.settle()

    def settle(self) -> None:
        while not np.array_equal(up := self.parent[self.parent], self.parent):
            self.parent = up


def link_within(points: np.ndarray, home: np.ndarray, radius: int, alike: Callable[[int, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """Component labels of ``points`` under all links of at most ``radius`` between home points or, where there are others, between home points and others.

    ``alike(i, others)`` verifies links; it is not asked about points that are one component already.
    """
    labels = Labels(len(points))
    todo = [(np.flatnonzero(home), None if home.all() else np.flatnonzero(~home))]
    while todo:
        a, b = todo.pop()
        every = a if b is None else b
        if not len(a) or not len(every):
            continue
        cut_at = best_cut(points, a, b, radius) if len(a) * len(every) > BLOCK else None
        if cut_at:
            todo += parted(points, a, b, *cut_at, radius)
            continue
        step = max(1, BLOCK // len(every))
        for i in range(0, len(a), step):
            near = np.bitwise_count(points[a[i : i + step], None] ^ points[None, every]) <= radius
            if alike is None:
                x, y = np.nonzero(near)
                labels.join(a[i : i + step][x], every[y])
                continue
            for one, row in zip(a[i : i + step].tolist(), near):
                others = every[row]
                others = others[labels.parent[others] != labels.parent[one]]
                if len(others):
                    others = others[alike(one, others)]
                    labels.join(np.full(len(others), one), others)
    return labels.parent


def links(prints: DataFrame, radius: int = 2, shard_size: int = SHARD_SIZE, sample_size: int = SAMPLE_SIZE, task_rows: int = TASK_ROWS) -> DataFrame:
    """Links (``a``, ``b``) whose components are those of all pairs of distinct points (``node``, ``simhash``) within ``radius``.

    A shard of more than half of ``task_rows`` is dealt in blocks, of which every two meet in a task.
    """
    n = prints.count()
    every = max(4, math.ceil(n / sample_size))
    sample = prints.where(F.pmod(F.xxhash64("node"), F.lit(every)) == 0).select("simhash")  # about sample_size values at most
    tree = VantageTree(np.array([r[0] for r in sample.collect()], dtype=np.int64).view(np.uint64), every, shard_size, radius)

    def routed(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).combine_chunks()
        for shard, places, side in tree.route(table.column("simhash").to_numpy().view(np.uint64)):
            own = table.take(pa.array(places)).combine_chunks()
            columns = [c.combine_chunks() for c in own.columns]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), shard)), pa.array(np.full(len(places), side)), *columns], ["shard", "side", *own.schema.names])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= ROUTED:
                yield from routed(held)
                held, rows = [], 0
        if held:
            yield from routed(held)

    def linked(table: pa.Table) -> pa.Table:
        nodes, points, side = (table.column(c).to_numpy() for c in ("node", "simhash", "side"))
        if side.min() == 2 or side.max() == 1:  # a block in which one side is missing
            return pa.table({"a": nodes[:0], "b": nodes[:0]})
        label = link_within(points.view(np.uint64), side < 2, radius)
        moved = label != np.arange(len(points))
        return pa.table({"a": nodes[moved], "b": nodes[label[moved]]})

    rows = cut(prints.select("node", "simhash").mapInArrow(dealt, "shard long, side long, node long, simhash long"))
    sizes = rows.groupBy("shard").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") * 2 / task_rows).cast("int")
    met = rows.join(sizes, "shard").withColumn("parts", blocks).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("shard", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "side", "node", "simhash")
    return met.groupBy("shard", "low", "high").applyInArrow(linked, "a long, b long")


def link_alike(home: np.ndarray, alike: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """Component labels under all links that ``alike(i, others)`` finds and that touch a home point; it is not asked about points that are one component already."""
    labels = Labels(len(home))
    for one in np.flatnonzero(home).tolist():
        others = labels.parent != labels.parent[one]
        others[:one] &= ~home[:one]  # seen from the other one
        others = np.flatnonzero(others)
        if len(others):
            others = others[alike(one, others)]
            labels.join(np.full(len(others), one), others)
    return labels.parent


def dealt_pairs(members: DataFrame, parts: Column, group: str) -> DataFrame:
    """``members`` of groups once for every pair of blocks that they are in: all members of ``meeting`` meet, and pairs count that touch a ``home`` one."""
    parted = members.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    parted = parted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    meeting = F.xxhash64(group, F.least("part", "other"), F.greatest("part", "other"))
    return parted.withColumn("meeting", meeting).withColumn("home", F.col("part") <= F.col("other")).drop("parts", "part", "other")


def linked_by(verifier: Callable[[pa.Table], Callable[[int, np.ndarray], np.ndarray]]) -> Callable[[pa.Table], pa.Table]:
    """Turns the rows of a bucket into links (``a``, ``b``), group by group; ``verifier`` makes a group's ``alike``."""

    def linked(table: pa.Table) -> pa.Table:
        table = table.sort_by("meeting")
        nodes, home, groups = (table.column(c).to_numpy() for c in ("node", "home", "meeting"))
        edges = np.flatnonzero(np.diff(groups)) + 1
        found = [(nodes[:0], nodes[:0])]
        for a, b in zip(np.append(0, edges).tolist(), np.append(edges, len(groups)).tolist()):
            if b - a < 2:
                continue
            label = link_alike(home[a:b], verifier(table.slice(a, b - a)))
            moved = np.flatnonzero(label != np.arange(b - a))
            found.append((nodes[a + moved], nodes[a + label[moved]]))
        give_back()
        return pa.table({"a": np.concatenate([f[0] for f in found]), "b": np.concatenate([f[1] for f in found])})

    return linked


def may_be_alike(one: np.ndarray, others: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sketches do not rule out that sets are ``similarity`` alike; the fewer bins are filled, the less they rule out."""
    filled = np.maximum(1, ((others > 0) | (one > 0)).sum(axis=1))
    return estimated_similarity(one, others) >= similarity - ERRORS * np.sqrt(similarity * (1 - similarity) / filled)


def similar_links(classes: DataFrame, similarity: float, group_size: int = GROUP_SIZE) -> DataFrame:
    """Candidate links (``a``, ``b``) between classes (``node``, ``sketch``, ``keys``) that share a key and whose sketches do not rule out that they are ``similarity`` alike.

    A key with more than ``group_size`` classes is dealt in blocks, of which every two meet in a group of their own.
    """
    n = classes.count()
    keyed = classes.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")  # a sketch travels only where it meets another
    met = keyed.join(shared, "key").join(classes.select("node", "sketch"), "node")
    dealt = dealt_pairs(met, F.ceil(F.col("n") / group_size).cast("int"), "key").select("node", "sketch", "meeting", "home")
    dealt = dealt.withColumn("bucket", F.pmod("meeting", F.lit(max(1, n * KEYS // GROUP_ROWS))))

    def by_sketch(table: pa.Table) -> Callable[[int, np.ndarray], np.ndarray]:
        own = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, BINS)
        return lambda i, others: may_be_alike(own[i], own[others], similarity)

    return dealt.groupBy("bucket").applyInArrow(linked_by(by_sketch), "a long, b long")


def alike_sets(sets: list[np.ndarray], similarity: float) -> Callable[[int, np.ndarray], np.ndarray]:
    """Exact verifier of non-empty sets of hashes."""
    sizes = np.array([len(x) for x in sets])
    names = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own, mark = np.split(names, np.cumsum(sizes)[:-1]), np.zeros(len(names), dtype=bool)

    def alike(i: int, others: np.ndarray) -> np.ndarray:
        mark[own[i]] = True
        starts = np.cumsum(sizes[others]) - sizes[others]
        both = np.add.reduceat(mark[np.concatenate([own[j] for j in others.tolist()])].astype(np.int64), starts)
        mark[own[i]] = False
        return both >= similarity * (sizes[i] + sizes[others] - both) - 1e-9

    return alike


def fingerprint_links(prints: DataFrame, radius: int = 2, shard_size: int = SHARD_SIZE, sample_size: int = SAMPLE_SIZE) -> DataFrame:
    """Links (``a``, ``b``) whose components are those of all nodes with fingerprints (``node``, ``simhash``, repeats included) within ``radius``: each distinct fingerprint is one point of the vantage tree, named by its least node."""
    points = cut(prints.groupBy("simhash").agg(F.min("node").alias("least")))
    own = prints.join(points, "simhash").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    # nodes of several fingerprints may name several points: a point goes by its fingerprint until links are found
    found = links(points.select(F.col("simhash").alias("node"), "simhash"), radius, shard_size, sample_size)
    name = lambda side: points.select(F.col("simhash").alias(side), F.col("least").alias(f"least_{side}"))
    met = found.join(name("a"), "a").join(name("b"), "b").select(F.col("least_a").alias("a"), F.col("least_b").alias("b"))
    return own.unionByName(met.where("a <> b"))


def exact_links(members: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Links (``a``, ``b``) whose components are those of all pairs within a ``group`` whose shingle sets are ``similarity`` alike.

    ``members`` has ``node``, ``group`` and the ``text_key`` of a text of that node, ``texts`` has ``text_key`` and ``text``, repeats included.
    """
    once = texts.groupBy("text_key").agg(F.first("text").alias("text"))
    # long enough to be worth writing once: sizes decide how the groups are dealt
    held = cut(members.join(once, "text_key").select("node", "group", "text"))
    sizes = held.groupBy("group").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    total = held.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = F.greatest(F.ceil(F.col("n") / EXACT_SIZE), F.least(F.col("n"), F.ceil(F.col("chars") / EXACT_CHARS))).cast("int")
    dealt = dealt_pairs(held.join(sizes, "group"), parts, "group").select("node", "text", "meeting", "home")
    dealt = dealt.withColumn("bucket", F.pmod("meeting", F.lit(max(64, math.ceil(total / EXACT_CHARS)))))

    def by_text(table: pa.Table) -> Callable[[int, np.ndarray], np.ndarray]:
        return alike_sets([np.unique(shingle_hashes(t.as_py(), shingle)) for t in table.column("text")], similarity)

    return dealt.groupBy("bucket").applyInArrow(linked_by(by_text), "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(``node``, ``root``) for every node of ``edges`` (``a``, ``b``), the root being the least node of its component.

    Large-star and small-star rounds; each is a map-side combined minimum and a
    join that Spark may split where a hub is hot.  Written out after every round.
    """
    pairs = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    for _ in range(rounds):
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        pairs = cut(small)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


#: A root's nodes are spread over this many rows of the join that brings each node its component.
SALTS = 16


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, similarity: float | None = None, shard_size: int = SHARD_SIZE, sample_size: int = SAMPLE_SIZE) -> DataFrame:
    """One row for each document: its id, ``fingerprint`` (16 hexadecimal digits) and ``component_id``, the least id that it reaches.

    Fingerprints link within ``radius``.  With a ``similarity`` texts link if the Jaccard
    similarity of their sets of shingles reaches it; those whose fingerprints are within ``radius`` are candidates, and so are others that share a least hash.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if similarity is None:
        rows = cut(with_fingerprints(texts, shingle=shingle).select("doc_id", F.col("simhash").alias("node"), "simhash"))
        classes = cut(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("simhash").alias("simhash")))
        linked = components(links(classes, radius, shard_size, sample_size))
    else:
        keyed = texts.withColumn("text_key", F.xxhash64("text"))
        rows = cut(with_profiles(keyed, shingle=shingle).select("doc_id", "node", "simhash", "sketch", "keys", "text_key"))
        classes = cut(rows.groupBy("node").agg(F.min("doc_id").alias("least"), *(F.min(c).alias(c) for c in ("sketch", "keys", "text_key"))))
        near = fingerprint_links(rows.where(F.size("keys") > 0).select("node", "simhash"), radius, shard_size, sample_size)
        rough = components(near.unionByName(similar_links(classes, similarity))).withColumnRenamed("root", "group")
        members = classes.select("node", "text_key").join(rough, "node")
        linked = components(exact_links(members, keyed.select("text_key", "text"), similarity, shingle))
    rooted = classes.select("node", "least").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node")).withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    by_root = rooted.groupBy("root").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.array(*(F.lit(i).cast("long") for i in range(SALTS)))))
    of_class = rooted.join(by_root, ["root", "salt"]).select("node", "component_id")
    return rows.select("doc_id", "node", "simhash").join(of_class, "node").select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of each component of ``found`` the document with the least id; documents without an id stay.

    Repeated rows of one id are one document: they go together, and of those that stay one row does.
    """
    ids = found.select(id_col, "component_id")
    gone = ids.where(F.col("component_id") < F.col(id_col)).select(id_col).distinct()
    kept = docs.join(gone, id_col, "left_anti").select(docs.columns)
    if ids.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").isEmpty():
        return kept
    return kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).union(kept.where(F.col(id_col).isNull()))
