"""Compression classifier: how much better a text packs with a dictionary of good text than with one of bad text.

Two zstandard dictionaries are built from labelled texts.  A text is cut into small
blocks, so that dictionaries count all along it; each block is compressed with both.
The difference of the two total sizes over their sum, the share of the text that is
left after compression, and its length give a calibrated score by logistic regression.

Fitting takes a bounded sample on the driver: at most ``PER_CLASS`` texts of each
class, of each at most ``TEXT_BLOCKS`` blocks, which a hash picks from all along the
text, and ``CALIBRATION`` feature rows of whole texts; scoring runs over all whole texts.

Edge cases: a null or empty text is scored like an empty block; labels without a
document, however many, and null labels do no harm; an id with several labels has the
lowest, one with several texts the one of least hash; without usable texts of both
classes in both halves of the sample every score is 0.5; an input column named
``score`` is replaced.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .arrow import text_slices, with_struct
from .scratch import cut

PER_CLASS, CALIBRATION = 800, 4_000
DICTIONARY_BYTES, BLOCK_BYTES, FIT_BLOCKS, TEXT_BLOCKS = 110_000, 512, 16_000, 40
FEATURES = ("difference", "ratio", "log_bytes")

SCORE = T.StructType([T.StructField("score", T.DoubleType())])
_FEATURES = T.StructType([T.StructField(f, T.DoubleType()) for f in FEATURES])


@dataclass(frozen=True)
class Model:
    """The two dictionaries and the calibration: mean, scale and weight of each feature, and the intercept."""

    good: bytes
    bad: bytes
    mean: tuple[float, ...] = (0.0, 0.0, 0.0)
    scale: tuple[float, ...] = (1.0, 1.0, 1.0)
    weights: tuple[float, ...] = (0.0, 0.0, 0.0)
    intercept: float = 0.0


def blocks(text: str) -> list[bytes]:
    data = text.encode()
    return [data[i : i + BLOCK_BYTES] for i in range(0, max(1, len(data)), BLOCK_BYTES)]


def sampled_blocks(text: str) -> list[bytes]:
    """All blocks of a text, or of a long one ``TEXT_BLOCKS`` that a hash of place and content picks, in their order."""
    own = blocks(text)
    if len(own) <= TEXT_BLOCKS:
        return own
    picked = sorted(range(len(own)), key=lambda i: zlib.crc32(own[i], i * 0x9E3779B1 & 0xFFFFFFFF))[:TEXT_BLOCKS]
    return [own[i] for i in sorted(picked)]


@F.arrow_udf(T.ArrayType(T.BinaryType()))
def samples_of(texts: pa.Array) -> pa.Array:
    return pa.array([sampled_blocks(t) for part in text_slices(texts) for t in part], pa.list_(pa.binary()))


def dictionary(texts: list[list[bytes]]) -> bytes:
    """A dictionary trained on blocks of texts; too few to train on serve as they are."""
    samples = [b for own in texts for b in own]
    samples = samples[:: max(1, -(-len(samples) // FIT_BLOCKS))]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


@functools.lru_cache(maxsize=4)
def compressor(content: bytes) -> zstandard.ZstdCompressor:
    own = zstandard.ZstdCompressionDict(content) if content else None
    if own:
        own.precompute_compress(level=1)
    return zstandard.ZstdCompressor(level=1, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)


def features(text: str, good: bytes, bad: bytes) -> tuple[float, float, float]:
    own = blocks(text)
    with_good, with_bad = (sum(len(c.compress(b)) for b in own) for c in (compressor(good), compressor(bad)))
    size = sum(map(len, own))
    return (with_bad - with_good) / (with_bad + with_good), (with_bad + with_good) / (2 * (size + 8)), float(np.log1p(size))


def calibrate(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps: mean, scale, and weights with the intercept last."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) / len(y) + penalty * w
        curve = (a * (p * (1 - p))[:, None]).T @ a / len(y) + penalty * np.eye(len(w))
        w -= np.linalg.solve(curve, grad)
    return mean, scale, w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Build dictionaries and calibration from labelled documents; ``labels`` holds only rows that may be learnt from."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).cast("int").alias("__label"))
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where("__text IS NOT NULL")
    usable = cut(known.join(texts.select("__id").distinct(), "__id", "left_semi").withColumn("__order", F.xxhash64("__id")))
    even = F.pmod("__order", F.lit(2)) == 0
    first = functools.reduce(DataFrame.union, (usable.where(even & (F.col("__label") == c)).orderBy("__order", "__id").limit(PER_CLASS) for c in (0, 1)))

    def one_text(chosen: DataFrame) -> DataFrame:
        """The bounded ``chosen`` labels, each with one text."""
        met = texts.join(F.broadcast(chosen), "__id")
        return met.groupBy("__id", "__order", "__label").agg(F.min_by("__text", F.xxhash64("__text")).alias("__text"))

    rows = sorted(one_text(first).select("__order", "__label", samples_of("__text").alias("__blocks")).collect())  # 2 * PER_CLASS rows of TEXT_BLOCKS at most
    good, bad = ([r["__blocks"] for r in rows if r["__label"] == c] for c in (1, 0))
    if not good or not bad:
        return Model(b"", b"")
    model = Model(dictionary(good), dictionary(bad))
    rest = usable.where(~even).orderBy("__order", "__id").limit(CALIBRATION)
    measured = sorted(with_features(one_text(rest), model, "__text").select("__order", "__label", *FEATURES).collect())
    y = np.array([r["__label"] for r in measured], dtype=float)
    if len(set(y.tolist())) < 2:
        return Model(b"", b"")
    mean, scale, w = calibrate(np.array([tuple(r)[2:] for r in measured]), y)
    return Model(model.good, model.bad, tuple(mean.tolist()), tuple(scale.tolist()), tuple(w[:-1].tolist()), float(w[-1]))


def with_features(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add the three features of every whole text."""

    @F.arrow_udf(_FEATURES)
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            values = np.array([features(t, model.good, model.bad) for part in text_slices(texts) for t in part], dtype=float).reshape(-1, len(FEATURES))
            yield pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in values.T], list(FEATURES))

    return with_struct(df, measure(F.col(text_col)), _FEATURES)


def calibrated(model: Model) -> Column:
    total = F.lit(model.intercept)
    for name, mean, scale, weight in zip(FEATURES, model.mean, model.scale, model.weights):
        total = total + (F.col(name) - mean) / scale * weight
    return 1 / (1 + F.exp(-total))


def score(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add the score, from 0 (bad) to 1 (good), of every whole text, beside the features."""
    return with_features(df, model, text_col).withColumn(score_col, calibrated(model))
