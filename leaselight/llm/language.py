"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters of the lower-cased text are hashed to ``DIM``
features.  Document frequencies are counted over all documents that may be learnt
from.  Weights are trained on a bounded sample by follow-the-regularised-leader with
an elastic-net penalty, which leaves most of them zero; a temperature, fitted on
sample rows that training has not seen, makes the probabilities honest.

The sample holds at most ``PER_LANGUAGE`` documents of each language, as feature
counts, so its size on the driver does not depend on the texts' length; like the model
it grows with the number of languages (``DIM`` weights each), not with the documents.

Edge cases: a null text, or one without any letter (numerals such as a half are none),
is ``und`` with score 0, and so is every text if there is nothing to learn from; long texts count whole; ties go to
the language that sorts first; rows that repeat an id and a text count once in the
sample, and rows of one id with different texts count each; extra columns do no harm, a
column named like an output column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T, Window

from .arrow import text_slices, with_struct
from .scratch import cut

BITS = 14
DIM = 1 << BITS
SIZES = (1, 2, 3)
PER_LANGUAGE, CALIBRATION_SHARE = 500, 5
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 0.02, 0.01, 4
UNKNOWN = "und"

GUESS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
_COUNTS = T.StructType([T.StructField("at", T.ArrayType(T.ShortType())), T.StructField("n", T.ArrayType(T.IntegerType()))])


def has_letter(text: str) -> bool:
    """Whether any character is a letter (Unicode category L); numerals such as a half or a superscript are none."""
    return any(map(str.isalpha, text))


def counts(text: str) -> np.ndarray:
    """How often each hashed n-gram occurs."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    out = np.zeros(DIM, dtype=np.int64)
    value = np.zeros(len(codes), dtype=np.uint64)
    for size in SIZES:
        if len(codes) < size:
            break
        value = value[: len(codes) - size + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[size - 1 :] + np.uint64(size)
        mixed = (value ^ (value >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        out += np.bincount((mixed >> np.uint64(64 - BITS)).astype(np.int64), minlength=DIM)
    return out


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray  # DIM x languages
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = np.log1p(n) * self.idf[at]
        return x / max(np.linalg.norm(x), 1e-12)

    def probabilities(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        logits = (self.vector(at, n) @ self.weights[at] + self.bias) / self.temperature
        p = np.exp(logits - logits.max())
        return p / p.sum()

    def guess(self, text: str) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        n = counts(text)
        at = np.flatnonzero(n)
        p = self.probabilities(at, n[at])
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], languages: tuple[str, ...], idf: np.ndarray) -> Model:
    """FTRL-proximal over several passes in a fixed shuffled order; the bias is a feature without penalty."""
    k = len(languages)
    z, n = np.zeros((DIM, k)), np.zeros((DIM, k))
    z0, n0 = np.zeros(k), np.zeros(k)
    empty = Model(languages, idf, np.zeros((0, k)), z0)

    def settled(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    rng = np.random.default_rng(11)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            at, count, y = rows[i]
            x = empty.vector(at, count)
            w = settled(z[at], n[at])
            w0 = -z0 / ((BETA + np.sqrt(n0)) / ALPHA)
            logits = x @ w + w0
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
            grown = n0 + p * p
            z0 += p - (np.sqrt(grown) - np.sqrt(n0)) / ALPHA * w0
            n0 = grown
    return Model(languages, idf, settled(z, n), -z0 / ((BETA + np.sqrt(n0)) / ALPHA))


def fit_temperature(model: Model, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """The temperature of least log loss on rows that training has not seen."""
    if not rows:
        return model
    logits = np.array([model.vector(at, n) @ model.weights[at] + model.bias for at, n, _ in rows])
    y = np.array([r[2] for r in rows])

    def loss(t: float) -> float:
        a = logits / t
        top = a.max(axis=1)
        return float(np.mean(np.log(np.exp(a - top[:, None]).sum(axis=1)) + top - a[np.arange(len(y)), y]))

    grid = np.geomspace(0.02, 10, 80)
    return Model(model.languages, model.idf, model.weights, model.bias, float(min(grid, key=loss)))


def document_frequencies(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many documents have each feature, and at the end how many there are: partial sums of fixed size from every task."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIM + 1, dtype=np.int64)
        for batch in batches:
            for part in text_slices(batch.column(0)):
                for text in part:
                    total[:DIM] += counts(text) > 0
                    total[DIM] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    out = np.zeros(DIM + 1, dtype=np.int64)
    for r in docs.select(text_col).mapInArrow(partial, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # DIM + 1 rows at most
        out[r.at] = r.n
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from documents with a language; ``docs`` holds only rows that may be learnt from."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    # the first distinct pairs of id and text of each language by a hash of both: rows that repeat take one place
    order = F.xxhash64("id", "text")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct(order).alias("n")).collect()}  # a row for each language
    languages, spread = tuple(sorted(sizes)), 1_000_000
    places = Window.partitionBy("lang").orderBy(F.pmod("order", F.lit(spread)), "order")
    if not languages:
        return Model((), np.zeros(DIM), np.zeros((DIM, 0)), np.zeros(0))
    frequency = document_frequencies(known)
    idf = np.log((1 + frequency[DIM]) / (1 + frequency[:DIM])) + 1

    for spare in (4, 64, spread):  # a share of the hashes that holds enough pairs; the first does, unless the estimates are far off
        shares = {lang: min(spread, 1 + spare * PER_LANGUAGE * spread // max(1, n)) for lang, n in sizes.items()}
        share = F.create_map(*(F.lit(v) for pair in shares.items() for v in pair))[F.col("lang")]
        likely = cut(known.withColumn("order", order).where(F.pmod("order", F.lit(spread)) < share).groupBy("lang", "order").agg(F.min("text").alias("text")))
        found = {r["lang"]: r["n"] for r in likely.groupBy("lang").agg(F.count("*").alias("n")).collect()}
        if all(shares[lang] == spread or found.get(lang, 0) >= PER_LANGUAGE for lang in languages):
            break
    ranked = likely.withColumn("rank", F.row_number().over(places)).where(F.col("rank") <= PER_LANGUAGE)

    @F.arrow_udf(_COUNTS)
    def sparse(texts: pa.Array) -> pa.Array:
        rows = [counts(t) for part in text_slices(texts) for t in part]
        at = [np.flatnonzero(r) for r in rows]
        return pa.StructArray.from_arrays([pa.array([a.astype(np.int16) for a in at], pa.list_(pa.int16())), pa.array([r[a].astype(np.int32) for r, a in zip(rows, at)], pa.list_(pa.int32()))], ["at", "n"])

    rows = with_struct(ranked, sparse(F.col("text")), _COUNTS).select("lang", "rank", "at", "n").collect()  # PER_LANGUAGE rows of DIM counts for each language at most
    rows = sorted(rows, key=lambda r: (r["lang"], r["rank"]))
    place = {lang: i for i, lang in enumerate(languages)}
    every = [(np.array(r["at"], dtype=np.int64), np.array(r["n"]), place[r["lang"]]) for r in rows]
    held = [r["rank"] % CALIBRATION_SHARE == 0 for r in rows]
    model = train([r for r, h in zip(every, held) if not h], languages, idf)
    return fit_temperature(model, [r for r, h in zip(every, held) if h])


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (its probability) for every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIM weights for each language

    @F.arrow_udf(GUESS)
    def guess(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [sent.value.guess(t) for part in text_slices(texts) for t in part]
            yield pa.StructArray.from_arrays([pa.array([g[0] for g in found], pa.string()), pa.array([g[1] for g in found], pa.float64())], ["lang_pred", "score"])

    return with_struct(docs, guess(F.col(text_col)), GUESS)
