"""Importance resampling towards a target: documents whose word n-grams look like the target's are drawn more often.

Features are all runs of one to ``SIZE`` consecutive words, hashed to ``BUCKETS``
buckets.  How often each bucket occurs is counted over all documents and over all target
texts; the logarithm of the ratio of the two smoothed shares is the bucket's gain, and
the mean of its features' gains is a document's weight.  A weight with Gumbel noise
added, which follows from the id alone, ranks documents; the first of them are the draw,
without replacement and in proportion to the weights.

N-grams are enumerated by a suffix array over word ids: in a slice of a partition
(about ``SLICE_BYTES`` of text, no text is cut) suffixes are sorted by their first
``SIZE`` words, and neighbours that share at least k words make a run, which is one
distinct k-gram.  Its text is hashed once, going on from the hash of its first k - 1 words,
and the bucket is scattered back to the places where it occurs.  Counts leave a task as one row for each bucket; documents are read
twice, for the counts and for the weights, and nothing of them is kept in between.

Edge cases: a null text, or one without words, has no features and weight 0; without
target texts, or without documents, the smoothing alone speaks; ranks are given to
documents with at least ``MIN_WORDS`` words; ties go to the smaller id, then to fewer
features (rows that are equal in all of that may stand for one another); a null id
counts as an empty one in the noise and comes last; extra columns are carried along,
one named like an output column is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .arrow import give_back, map_slices
from .numbers import numbered

BUCKETS, SIZE = 10_000, 2
MIN_WORDS, PERCENT, SEED = 20, 25, 7
SLICE_BYTES = 4_000_000

#: Bytes of words in lower case, all others as blanks: A-Z is lowered, digits, letters and what is not ASCII stay.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

WEIGHED = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight")])


class _Ids(dict):
    """Words to numbers in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def suffix_order(ids: np.ndarray, size: int) -> np.ndarray:
    """Places sorted by the ``size`` ids from there on (beyond the end: -1)."""
    ahead = [np.concatenate([ids[k:], np.full(min(k, len(ids)), -1, ids.dtype)]) for k in range(size)]
    return np.lexsort(ahead[::-1])


def shared_words(ids: np.ndarray, order: np.ndarray, size: int) -> np.ndarray:
    """For each place of the order, how many ids it shares with the one before, ``size`` at most; separators (-1) are never shared."""
    out = np.zeros(len(order), np.int64)
    alike = np.ones(max(0, len(order) - 1), bool)
    for k in range(size):
        at = np.minimum(order + k, len(ids) - 1)
        word = np.where(order + k < len(ids), ids[at], -1)
        alike &= (word[1:] == word[:-1]) & (word[1:] >= 0)
        out[1:] += alike
    return out


def buckets(texts: list[bytes], size: int = SIZE, count: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every place of the joined texts the bucket of the n-gram of each size that starts there (row k-1; -1: none), the text of each place, and the number of words of each text."""
    ids, pieces, lengths = _Ids(), [], []
    for text in texts:
        own = [*map(ids.__getitem__, text.translate(_WORDS).split())]
        lengths.append(len(own))
        pieces += [np.array(own, np.int64), np.array([-1])]
    joined = np.concatenate(pieces) if pieces else np.zeros(0, np.int64)
    words, n_words = list(ids), np.array(lengths, np.int64)
    after_blank, crc = [b" " + w for w in words], np.zeros(len(joined), np.int64)
    of = np.repeat(np.arange(len(texts)), n_words + 1)
    out = np.full((size, len(joined)), -1, np.int64)
    order = suffix_order(joined, size)
    shared = shared_words(joined, order, size)
    left = np.repeat(np.cumsum(n_words + 1), n_words + 1) - 1 - np.arange(len(joined))  # words up to the end of the text
    for k in range(1, size + 1):
        own = left[order] >= k
        places, new = order[own], (shared[own] < k)
        starts = places[new]
        last = joined[starts + k - 1].tolist()
        # once for each run; that of a longer one goes on from its first words'
        hashed = map(zlib.crc32, [after_blank[i] for i in last], crc[starts].tolist()) if k > 1 else map(zlib.crc32, [words[i] for i in last])
        if len(places):
            crc[places] = np.fromiter(hashed, np.int64, len(starts))[np.cumsum(new) - 1]
            out[k - 1, places] = crc[places] % count
    return out, of, n_words


def bucket_counts(texts: DataFrame, text_col: str = "text", size: int = SIZE, count: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket; ``count`` rows reach the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(count, np.int64)
        for batch in batches:
            for part in _slices(batch.column(0)):
                found = buckets(part, size, count)[0]
                total += np.bincount(found[found >= 0], minlength=count)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])
        give_back()

    out = np.zeros(count, np.int64)
    for r in texts.select(text_col).mapInArrow(partial, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def _slices(texts: pa.Array) -> Iterator[list[bytes]]:
    part, size = [], 0
    for value in texts.cast(pa.binary()):
        text = value.as_py() or b""
        if part and size + len(text) > SLICE_BYTES:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier a bucket is in the target, rounded down; every bucket counts once more than it occurs."""
    s, t, n = source.astype(float), target.astype(float), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text_col: str = "text", size: int = SIZE, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``n_words``, ``n_features`` and ``weight``: the mean gain of the features, rounded down."""

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            found, of, n_words = buckets([t.as_py() or b"" for t in texts.cast(pa.binary())], size, len(gain))
            n, total = np.zeros(len(n_words), np.int64), np.zeros(len(n_words), np.int64)
            for row in found:
                had = row >= 0
                n += np.bincount(of[had], minlength=len(n_words))
                total += np.bincount(of[had], weights=gain[row[had]], minlength=len(n_words)).astype(np.int64)  # whole numbers under 2**53
            return [pa.array(n_words), pa.array(n), pa.array(total // np.maximum(n, 1))]

        return work

    return map_slices(docs, text_col, WEIGHED, make, drop=drop, limit=SLICE_BYTES)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down, from the seed and the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` (1 for the first drawn; null: not drawn).

    Of the documents with ``min_words`` words, ``percent`` in a hundred are drawn.
    """
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, text_col))
    made = ("score", "rank", "__rated", "__place", "__of")
    kept = docs.select(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns if c.lower() not in made))
    scored = weigh(kept, gain, text_col, drop=drop).withColumn("score", F.col("weight") + noise(F.col(id_col), seed))
    rated = scored.withColumn("__rated", F.when(F.col("n_words") >= min_words, "rated").otherwise("short"))
    placed = numbered(rated, "__rated", [F.col("score").desc(), F.col(id_col).asc_nulls_last(), F.col("n_features")], "__place", "__of")
    drawn = (F.col("__rated") == "rated") & (F.col("__place") < F.floor(F.lit(percent) * F.col("__of") / 100))
    return placed.withColumn("rank", F.when(drawn, F.col("__place") + 1)).drop("__rated", "__place", "__of")


def oracle() -> str:
    from .merkle import CRC_TABLE_SQL, crc32_sql

    words = lambda t: f"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    grams = "w || list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])"
    return f"""WITH {CRC_TABLE_SQL}, d AS (SELECT doc_id, {words("coalesce(text, '')")} AS w FROM documents), b AS (SELECT {words("coalesce(text, '')")} AS w FROM benchmark),
dg AS (SELECT doc_id, unnest({grams}) AS g FROM d), bg AS (SELECT unnest({grams}) AS g FROM b),
v AS (SELECT g, {crc32_sql('g')} % {BUCKETS} AS k FROM (SELECT DISTINCT g FROM (SELECT g FROM dg UNION ALL SELECT g FROM bg)), crc),
s AS (SELECT k, count(*) AS n FROM dg JOIN v USING (g) GROUP BY k), t AS (SELECT k, count(*) AS n FROM bg JOIN v USING (g) GROUP BY k),
z AS (SELECT CAST((SELECT count(*) FROM dg) + {BUCKETS} AS DOUBLE) AS s, CAST((SELECT count(*) FROM bg) + {BUCKETS} AS DOUBLE) AS t),
y AS (SELECT r.k, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1e0) * z.s / ((coalesce(s.n, 0) + 1e0) * z.t))) AS BIGINT) AS gain FROM (SELECT unnest(range({BUCKETS})) AS k) r LEFT JOIN s USING (k) LEFT JOIN t USING (k), z),
o AS (SELECT doc_id, count(*) AS n, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM dg JOIN v USING (g) JOIN y USING (k) GROUP BY doc_id),
x AS (SELECT d.doc_id, len(d.w) AS n_words, coalesce(o.n, 0) AS n_features, coalesce(o.weight, 0) AS weight, CAST('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN o USING (doc_id)),
r AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5e0) / 4294967296e0))) AS BIGINT) AS score, count(*) FILTER (n_words >= {MIN_WORDS}) OVER () AS of FROM x),
q AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {MIN_WORDS} ORDER BY score DESC, doc_id) AS place FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {MIN_WORDS} AND place <= {PERCENT} * of // 100 THEN place END AS rank FROM q"""
