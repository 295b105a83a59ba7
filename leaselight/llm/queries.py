"""Each corpus operator over its whole intended table, under the name that the driver knows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, classifier, decontaminate, language, licenses, merkle, quality, recompress, resample, secrets, simhash, urls, warc

#: Where the tokenizer of op1 comes from; another vocabulary of the same kind does as well.
TOKENIZER_PATH = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, TOKENIZER_PATH, decoded_col="decoded", drop=("text",))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def held_out(of: int, remainder: int):
    """Whether crc32 of the id leaves this remainder; rows without an id are never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == remainder, F.lit(True)).alias("held_out")


def op2_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = classifier.fit(docs, table(spark, sf_dir, "labels").where(~held_out(3, 1)))
    return classifier.score(docs, model).select("doc_id", held_out(3, 1), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def page_captures(pages: DataFrame) -> DataFrame:
    """Captures of the page table: every page as a full response, and three days later one revisit of its URL.

    Times, validators and cache headers follow from page_id and html.
    """
    def captured(kind: str, seconds: str, headers: dict[str, str]) -> DataFrame:
        entries = ", ".join(f"'{k}', {v}" for k, v in headers.items())
        return pages.selectExpr(
            f"concat('{kind}-', page_id) AS record_id",
            f"'{kind}' AS warc_type",
            "url AS target_uri",
            f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, {seconds}) AS date",
            f"{200 if kind == 'response' else 304} AS status",
            f"map_filter(map({entries}), (k, v) -> v IS NOT NULL) AS headers",
            "html AS payload" if kind == "response" else "CAST(NULL AS STRING) AS payload",
        )

    full = captured("response", "page_id * 120", {"content-type": "'text/html'", "content-length": "CAST(length(html) AS STRING)", "cache-control": "'max-age=60'", "etag": "concat('\"', md5(html), '\"')", "last-modified": "concat('lm-', substr(md5(html), 1, 8))"})
    again = captured(
        "revisit",
        "page_id * 120 + 259260",
        {
            "content-length": "'0'",
            "cache-control": "IF(page_id % 2 = 0, 'max-age=600', NULL)",
            "etag": "CASE page_id % 10 WHEN 0 THEN '\"other\"' WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE concat('W/\"', md5(html), '\"') END",
            "last-modified": "IF(page_id % 10 = 2 OR page_id % 3 = 0, NULL, concat('lm-', substr(md5(html), 1, 8)))",
        },
    )
    return full.unionByName(again)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve(page_captures(table(spark, sf_dir, "pages")))
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return found.select("record_id", "url", "outcome", "base_id", listed.alias("merged_headers"), F.md5("payload").alias("payload_md5"))


OP3_SQL = r"""
WITH p AS (
  SELECT page_id, url AS raw, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^(?i:https?)://(?i:www\.|m\.)?', '') AS bare FROM pages
), q AS (
  SELECT *, regexp_replace(regexp_replace(bare, '\?.*$', ''), '/+$', '') AS place,
    list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) AS pairs FROM p
), c AS (
  SELECT page_id, html, regexp_replace(lower(regexp_extract(place, '^[^/]*', 0)), ':(80|443)$', '') || regexp_replace(place, '^[^/]*', '')
    || CASE WHEN len(pairs) > 0 THEN '?' || array_to_string(pairs, '&') ELSE '' END AS url,
    '"' || md5(html) || '"' AS tag, 'lm-' || substr(md5(html), 1, 8) AS lm FROM q
), v AS (
  SELECT page_id, url, page_id * 120 + 259260 AS t,
    CASE page_id % 10 WHEN 0 THEN '"other"' WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE 'W/' || tag END AS etag,
    CASE WHEN page_id % 10 = 2 OR page_id % 3 = 0 THEN NULL ELSE lm END AS lm,
    CASE WHEN page_id % 2 = 0 THEN 'max-age=600' END AS cache FROM c
), j AS (
  SELECT v.*, s.page_id AS base, s.html, s.tag AS base_tag, s.lm AS base_lm,
    coalesce(regexp_replace(v.etag, '^W/', '') = s.tag, v.lm = s.lm) AS same
  FROM v ASOF LEFT JOIN (SELECT *, page_id * 120 AS t FROM c) s ON v.url = s.url AND v.t > s.t
), r AS (
  SELECT *, CASE WHEN base IS NULL THEN 'no_response' WHEN same IS NULL THEN 'unverified' WHEN same THEN 'resolved' ELSE 'changed' END AS outcome FROM j
)
SELECT 'revisit-' || page_id AS record_id, url, outcome, CASE WHEN outcome = 'resolved' THEN 'response-' || base END AS base_id,
  CASE WHEN outcome = 'resolved' THEN 'cache-control=' || coalesce(cache, 'max-age=60') || ';content-length=' || length(html) || ';content-type=text/html;etag=' || coalesce(etag, base_tag) || ';last-modified=' || coalesce(lm, base_lm) END AS merged_headers,
  CASE WHEN outcome = 'resolved' THEN md5(html) END AS payload_md5
FROM r
"""


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known_notices(spark))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    found = secrets.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = listed(F.filter("spans", lambda s: s["kind"] != "entropy"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), count("entropy"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~held_out(5, 0)))
    return language.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(5, 0), "lang_pred", "score")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recompress.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), drop=("text",))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fields = table(spark, sf_dir, "documents"), ("doc_id", "source", "lang", "n_chars", "text")
    digest = lambda **changed: merkle.leaf(*(changed.get(c, F.col(c)) for c in fields))
    tampering = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaves = docs.select("doc_id", "lang", digest().alias("leaf"), F.when(tampering, digest(n_chars=F.col("n_chars") + 1)).alias("tampered"))
    found = merkle.manifest(leaves, F.col("leaf"), group="lang", order="doc_id")
    folded = merkle.folded(F.coalesce("tampered", "leaf"), F.col("path"))
    out = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    drawn = resample.resample(docs, table(spark, sf_dir, "benchmark"), drop=("text",))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


#: The rules of op13.
URL_RULES = [urls.Rule("allow", "org"), urls.Rule("block", "example.org", "/es/"), urls.Rule("block", "example.org", "/en/1"), urls.Rule("allow", "com", "/fr/"), urls.Rule("block", "com", "/de/")]


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_classifier": op2_classifier,
    "op3_warc": op3_warc,
    "op4_simhash": op4_simhash,
    "op5_licenses": op5_licenses,
    "op6_secrets": op6_secrets,
    "op7_quality": op7_quality,
    "op8_language": op8_language,
    "op9_decontaminate": op9_decontaminate,
    "op10_substrings": op10_substrings,
    "op11_merkle": op11_merkle,
    "op12_resample": op12_resample,
    "op13_urls": op13_urls,
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc": OP3_SQL,
    "op5_licenses": licenses.oracle(),
    "op7_quality": quality.ORACLE,
    "op11_merkle": merkle.oracle(),
    "op12_resample": resample.oracle(),
}
