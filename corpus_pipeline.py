"""From raw documents to token ids: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from leaselight.llm import bpe, decontaminate, quality, scratch, secrets, simhash
from leaselight.llm.queries import TOKENIZER_PATH, table


def beside(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on documents whose columns but id and text are out of its way, so that none of its own takes their place."""
    hidden = {c: f"__column_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    own = docs.withColumnsRenamed(hidden)
    return work(own).select(own.columns).withColumnsRenamed({h: c for c, h in hidden.items()})


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the cascade keeps."""
    return quality.keep(docs)


#: Texts link if their sets of five-word shingles are this alike.
SIMILARITY = 0.8


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies."""
    return simhash.keep_one(docs, simhash.near_duplicates(docs, shingle=5, similarity=SIMILARITY))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return beside(docs, lambda own: decontaminate.drop_documents(decontaminate.find(own, table(spark, sf_dir, "benchmark"))))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked; ``n_chars`` follows the text."""
    masked = secrets.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, and a digest of what they decode to."""
    coded = bpe.encode(docs.drop("n_chars"), TOKENIZER_PATH, decoded_col="decoded", drop=("text",))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scans),
    ("BPE encoding", encoding),
]

#: Fingerprints, pattern spans and merges are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; what is between them lies in the shared folder of the session, each copy until the next is written."""
    at = scratch.new_folder(spark, "corpus")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{i}")
        if i:
            scratch.remove(spark, f"{at}/{i - 1}")
        docs = spark.read.parquet(f"{at}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
