"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned over every word window.

Words are runs of ASCII letters and digits and of any non-ASCII characters, after
lower-casing A-Z.  A window is ``n`` consecutive words of a benchmark item, or all
words of a shorter item; a document word inside any occurrence of a window is hit.

The windows are broadcast only while the benchmark's text stays under a stated
size; beyond it they are shuffled and joined, with the same result.  What documents send
into that join has passed a Bloom filter of the benchmark's windows, of a stated size at
most, so nearly all of their windows stay where they are.  Hash matches are verified
word by word on both ways.

Edge cases: null and empty texts have no words and no hits; an item without words
has no windows; an item without an id marks words but is not listed; repeated
documents are judged alike; repeated items count once; input columns named like
output columns are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .arrow import replaced, text_slices, with_struct
from .recompress import gram_names, mixed, word_names
from .scratch import cut

#: Largest benchmark text, in bytes, whose windows are broadcast.
BROADCAST_BYTES = 8_000_000
WINDOW = 10
#: Bits of the Bloom filter: for each window, and at most; a fuller one lets more pass, never less.
BITS_PER_WINDOW, BLOOM_BITS = 16, 2**28
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
])
_FOUND_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))])


def words(text: str) -> list[bytes]:
    return text.encode().translate(_TO_WORDS).split()


def windows(item: list[bytes], n: int) -> list[tuple[bytes, ...]]:
    return [tuple(item[i : i + n]) for i in range(max(1, len(item) - n + 1))] if item else []


def _row(n_words: int, hit: np.ndarray | None, text: str, ids: set[str]) -> dict:
    """The result of one document; ``hit`` marks its words, in order."""
    if hit is None or not hit.any():
        return {"n_words": n_words, "n_hit": 0, "item_ids": [], "spans": []}
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    at = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    spans = [{"begin": at[a][0], "end": at[b - 1][1]} for a, b in edges.reshape(-1, 2).tolist()]
    return {"n_words": n_words, "n_hit": int(hit.sum()), "item_ids": sorted(ids), "spans": spans}


class WindowSet:
    """Distinct windows by length, as sorted hashes beside the word numbers that verify a match."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int) -> None:
        owners: dict[tuple[bytes, ...], set[str]] = {}
        for item_id, text in items:
            for window in windows(words(text or ""), n):
                owners.setdefault(window, set()).update([] if item_id is None else [item_id])
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for window in owners for w in window}), 1)}
        self.by_length = []
        for length in sorted({len(w) for w in owners}):
            own = [w for w in owners if len(w) == length]
            rows = np.array([[self.vocabulary[x] for x in w] for w in own], dtype=np.uint64)
            for seed in range(3, 2000, 2):  # until no two windows share a hash
                factors = _factors(length, seed)
                hashes = (rows * factors).sum(axis=1, dtype=np.uint64)
                if len(np.unique(hashes)) == len(hashes):
                    break
            order = np.argsort(hashes)
            self.by_length.append((length, factors, hashes[order], rows[order], [owners[own[i]] for i in order]))

    def scan(self, texts: list[str]) -> list[dict]:
        split = [words(t) for t in texts]
        counts = np.array([len(w) for w in split])
        starts = np.concatenate([[0], np.cumsum(counts + 1)])  # a gap after each text keeps windows inside it
        ids = np.zeros(int(starts[-1]), dtype=np.uint64)
        get = self.vocabulary.get
        for row, at in zip(split, starts.tolist()):
            ids[at : at + len(row)] = np.fromiter(map(get, row, repeat(0)), dtype=np.uint64, count=len(row))
        gaps = np.concatenate([[0], np.cumsum(ids == 0)])
        cover = np.zeros(len(ids) + 1, dtype=np.int32)
        found: dict[int, set[str]] = {}
        for length, factors, hashes, rows, owners in self.by_length:
            if len(ids) < length:
                continue
            at = np.flatnonzero(gaps[length:] == gaps[:-length])  # windows of benchmark words only
            value = np.zeros(len(at), dtype=np.uint64)
            for k in range(length):
                value += ids[at + k] * factors[k]
            place = np.minimum(np.searchsorted(hashes, value), len(hashes) - 1)
            same = hashes[place] == value
            at, place = at[same], place[same]
            same = np.ones(len(at), dtype=bool)
            for k in range(length):
                same &= rows[place, k] == ids[at + k]
            at, place = at[same], place[same]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + length, -1)
            doc = np.searchsorted(starts, at, side="right") - 1
            for d, p in np.unique(np.stack([doc, place], axis=1), axis=0).tolist():
                found.setdefault(d, set()).update(owners[p])
        hit = np.cumsum(cover[:-1]) > 0
        return [_row(n, hit[a : a + n] if d in found else None, texts[d], found.get(d, set())) for d, (a, n) in enumerate(zip(starts.tolist(), counts.tolist()))]


def _factors(length: int, seed: int) -> np.ndarray:
    """Odd 64-bit multipliers from a splitmix sequence."""
    z = (np.arange(1, length + 1, dtype=np.uint64) + np.uint64(seed * 1000)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))) | np.uint64(1)


def find(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", n: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Add ``n_words``, ``n_hit``, ``item_ids`` (strings, sorted) and ``spans`` (code points) to each document."""
    items = benchmark.select(F.col(item_id_col).cast("string").alias("item_id"), F.col(item_text_col).alias("item_text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("item_text") + 16), F.lit(0))).first()[0]
    if size > broadcast_bytes:
        return _find_by_join(docs, items, text_col, n)
    # at most broadcast_bytes of text, by the check above
    sent = docs.sparkSession.sparkContext.broadcast(WindowSet([(r.item_id, r.item_text) for r in items.distinct().collect()], n))

    @F.arrow_udf(FOUND)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([row for part in text_slices(texts) for row in sent.value.scan(part)], _FOUND_ARROW)

    return with_struct(docs, scan(F.col(text_col)), FOUND)


def window_hashes(own: list[bytes], sizes: list[int]) -> list[tuple[int, np.ndarray]]:
    """A hash of each window of the words, by size and start."""
    data = np.frombuffer(b"".join(own), dtype=np.uint8)
    ends = np.cumsum(np.fromiter(map(len, own), dtype=np.int64, count=len(own)))
    names = word_names(data, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends, 0xD1B54A32D192ED03)
    return [(size, mixed(gram_names(names, size) + np.uint64(size))) for size in sizes if size <= len(own)]


def bloom_bits(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places that a hash has in a filter of ``bits``, a power of two."""
    return hashes & np.uint64(bits - 1), (hashes >> np.uint64(32)) & np.uint64(bits - 1)


def bloom_filter(items: DataFrame, sizes: list[int], n: int, windows_in_all: int) -> np.ndarray:
    """A Bloom filter of all windows of ``item_text``: 64-bit words that tasks fill and an aggregation joins, ``BLOOM_BITS`` at most."""
    bits = min(BLOOM_BITS, max(2**16, 1 << (BITS_PER_WINDOW * windows_in_all - 1).bit_length()))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(bits // 64, dtype=np.uint64)
        for batch in batches:
            for part in text_slices(batch.column(0)):
                for text in part:
                    own = words(text)
                    for _, hashes in window_hashes(own, [min(n, len(own))]) if own else []:
                        for at in bloom_bits(hashes, bits):
                            np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at].view(np.int64))], ["at", "bits"])

    filled = items.select("item_text").mapInArrow(fill, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()  # BLOOM_BITS / 64 rows at most
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[filled.column("at").to_numpy()] = filled.column("bits").to_numpy().view(np.uint64)
    return out


def _find_by_join(docs: DataFrame, items: DataFrame, text_col: str, n: int) -> DataFrame:
    """The same for a benchmark of any size: windows of both sides that may be equal meet by hash, then texts are verified."""
    windowed = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("gram", T.BinaryType())]))

    @F.arrow_udf(windowed)
    def item_windows(texts: pa.Array) -> pa.Array:
        rows = [[{"at": len(w), "gram": b" ".join(w)} for w in windows(words(t.as_py() or ""), n)] for t in texts]
        return pa.array(rows, pa.list_(pa.struct([("at", pa.int32()), ("gram", pa.binary())])))

    grams = items.select("item_id", F.explode(item_windows("item_text")).alias("w")).select(F.col("w.at").alias("size"), F.col("w.gram").alias("gram"), F.coalesce("item_id", F.lit("")).alias("item_id"), F.col("item_id").isNotNull().alias("listed")).distinct()
    grams = cut(grams)
    by_size = {r["size"]: r["n"] for r in grams.groupBy("size").agg(F.count("*").alias("n")).collect()}  # n rows at most
    sizes = sorted(by_size)
    sent = docs.sparkSession.sparkContext.broadcast(bloom_filter(items, sizes, n, sum(by_size.values())))  # BLOOM_BITS at most

    @F.arrow_udf(windowed)
    def doc_windows(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bloom = sent.value
        for texts in batches:
            rows = []
            for part in text_slices(texts):
                for text in part:
                    own, found = words(text), []
                    for size, hashes in window_hashes(own, sizes) if own else []:
                        may = np.ones(len(hashes), dtype=bool)
                        for at in bloom_bits(hashes, len(bloom) * 64):
                            may &= bloom[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1) == 1
                        found += [{"at": i, "gram": b" ".join(own[i : i + size])} for i in np.flatnonzero(may).tolist()]
                    rows.append(found)
            yield pa.array(rows, pa.list_(pa.struct([("at", pa.int32()), ("gram", pa.binary())])))

    numbered = cut(docs.withColumn("__row", F.monotonically_increasing_id()))  # the numbers must not change between the two uses
    spread = numbered.select("__row", F.explode(doc_windows(text_col)).alias("w")).select("__row", F.col("w.at").alias("at"), F.col("w.gram").alias("gram"))
    met = spread.withColumn("h", F.xxhash64("gram")).join(grams.withColumn("h", F.xxhash64("gram")).withColumnRenamed("gram", "own"), "h").where("gram = own")
    found = met.groupBy("__row").agg(F.collect_set(F.struct("at", "size")).alias("__at"), F.array_sort(F.collect_set(F.when(F.col("listed"), F.col("item_id")))).alias("__ids"))

    @F.arrow_udf(FOUND)
    def rows(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for texts, places, ids in batches:
            out = []
            for text, at, own in zip(texts.to_pylist(), places.to_pylist(), ids.to_pylist()):
                n_words = len(words(text or ""))
                hit = np.zeros(n_words, dtype=bool)
                for p in at or []:
                    hit[p["at"] : p["at"] + p["size"]] = True
                out.append(_row(n_words, hit, text or "", set(own or [])))
            yield pa.array(out, _FOUND_ARROW)

    joined = numbered.join(found, "__row", "left")
    return with_struct(joined, rows(F.col(text_col), F.col("__at"), F.col("__ids")), FOUND).drop("__row", "__at", "__ids")


def remove_spans(found: DataFrame, text_col: str = "text", out_col: str = "text") -> DataFrame:
    """Replace each span that ``find`` reported by one space; other texts stay as they are."""
    return found.withColumn(out_col, F.when(F.size("spans") > 0, replaced(F.col(text_col), F.col("spans"), " ")).otherwise(F.col(text_col)))


def drop_documents(found: DataFrame, least_hit: int = 1) -> DataFrame:
    """The documents with fewer than ``least_hit`` hit words."""
    return found.where(F.col("n_hit") < least_hit)
