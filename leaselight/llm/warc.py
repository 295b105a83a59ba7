"""Not-modified revisit resolution for archived captures, in DataFrame functions.

A revisit record says that a server answered "not modified": it has no body.  An
as-of join by canonical URL finds the latest earlier full response; if the
validators agree, the revisit gets that response's body and its headers, updated by
those headers of the revisit that a 304 answer may change.

The as-of join works in time buckets.  Within a URL and bucket a running maximum
looks back; a second one, over one row for each URL and bucket, brings what earlier
buckets held.  Buckets are cut at quantiles of all dates, so a URL with a third of
all captures is spread over a third of the buckets' tasks.  Bodies take no part in
that join; they are fetched by record id once the base is known.  Revisits carry their
headers through it, so each of its rows stays one row.

Edge cases: captures are ordered by date, then record id (none first); a response is
earlier than a revisit only if it is strictly before it in that order, so repeated rows
never resolve one another; null dates are never a base and never resolved (``no_date``);
a null URL has no canonical form and is not resolved (``no_response``); missing headers
count as none; a revisit without a record id is resolved like any other; a response
without one cannot be named and is never a base; responses that share a record id but not
date and content each stand for themselves, with their own validators and body, and rows
that are equal in all are one, so that each row of a revisit has one row in the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Time buckets that captures are dealt over.
BUCKETS = 64
#: Query parameters that do not name another resource.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"
#: Headers of a 304 answer that do not replace the stored ones: they describe a body or a connection.
FIXED_HEADERS = ("content-encoding", "content-length", "content-range", "content-type", "connection", "keep-alive", "proxy-authenticate", "te", "trailer", "transfer-encoding", "upgrade")


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. or m., path without trailing slashes, parameters sorted and without tracking; no scheme, no fragment."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), r"^(?i:https?)://(?i:www\.|m\.)?", "")
    place = F.regexp_replace(F.regexp_replace(bare, r"\?.*$", ""), "/+$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(place, "^[^/]*", 0)), r":(80|443)$", "")
    path = F.regexp_replace(place, "^[^/]*", "")
    pairs = F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(f"^({TRACKING})(=|$)")))
    return F.concat(host, path, F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise(""))


def header(headers: Column, name: str) -> Column:
    """The value under a lower-case name; an empty one counts as none."""
    return F.nullif(F.element_at(headers, name), F.lit(""))


def strong(etag: Column) -> Column:
    """Weak and strong forms of an entity tag compare alike here."""
    return F.regexp_replace(etag, "^W/", "")


def bases(records: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Every revisit (record_id, target_uri, date, headers) with its ``url`` and the latest earlier full response of that URL: ``base`` (date, id, etag, last_modified) or null."""
    full = (F.col("warc_type") == "response") & (F.col("status") == 200) & F.col("record_id").isNotNull()
    revisit = F.col("warc_type") == "revisit"
    records = records if "content" in records.columns else records.withColumn("content", F.lit(0).cast("long"))
    slim = records.where(revisit | full).select(
        "record_id",
        canonical_url(F.col("target_uri")).alias("url"),
        "date",
        revisit.alias("revisit"),
        F.when(revisit, F.col("headers")).alias("headers"),
        F.when(full, F.struct("date", "record_id", "content", header(F.col("headers"), "etag").alias("etag"), header(F.col("headers"), "last-modified").alias("last_modified"))).alias("full"),
    )
    placed = F.col("url").isNotNull() & F.col("date").isNotNull()
    seconds = F.unix_micros(F.col("date").cast("timestamp"))
    cuts = slim.where(placed).agg(F.percentile_approx(seconds, [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []
    bucket = F.size(F.filter(F.array(*(F.lit(c) for c in sorted(set(cuts)))), lambda c: c <= seconds)) if cuts else F.lit(0)
    dealt = slim.where(placed).withColumn("bucket", bucket)
    # the greatest (date, id) so far is the latest; map-side combined to a row for each URL and bucket
    per_bucket = dealt.groupBy("url", "bucket").agg(F.max("full").alias("latest"))
    so_far = Window.partitionBy("url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bucket.select("url", "bucket", F.max("latest").over(so_far).alias("carried"))
    inside = Window.partitionBy("url", "bucket").orderBy("date", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = dealt.withColumn("own", F.max("full").over(inside)).where("revisit")
    found = seen.join(carried, ["url", "bucket"]).select("record_id", "url", "date", "headers", F.coalesce("own", "carried").alias("base"))
    lost = slim.where(F.col("revisit") & ~placed)
    return found.unionByName(lost.select("record_id", "url", "date", "headers", F.lit(None).cast(found.schema["base"].dataType).alias("base")))


def told_apart(records: DataFrame) -> tuple[DataFrame, bool]:
    """``records`` with a hash of their content where responses repeat a record id, so that id, date and hash name a response; else with zero, and bodies are not read for it.  And whether ids repeat."""
    responses = records.where((F.col("warc_type") == "response") & (F.col("status") == 200))
    repeated = not responses.groupBy("record_id").agg(F.count("*").alias("n")).where("n > 1 AND record_id IS NOT NULL").isEmpty()
    content = F.xxhash64("target_uri", F.map_entries("headers"), "payload") if repeated else F.lit(0).cast("long")
    return records.withColumn("content", content), repeated


def merged_headers(stored: Column, fresh: Column) -> Column:
    """Stored headers, replaced and joined by those of the 304 answer that may change them."""
    allowed = F.map_filter(fresh, lambda k, v: ~k.isin(*FIXED_HEADERS) & v.isNotNull())
    kept = F.map_filter(stored, lambda k, v: ~F.map_contains_key(allowed, k))
    return F.map_concat(kept, allowed)


def resolve(records: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row for each revisit of ``records``.

    ``records`` has record_id, warc_type, target_uri, date, status, headers (map with
    lower-case names) and payload.  The result has the revisit's record_id, url, date
    and outcome (``resolved``, ``changed``: the validators differ, ``unverified``:
    there is none in common, ``no_response``, ``no_date``), and, if resolved,
    base_id, the merged headers and the payload.
    """
    headers = F.coalesce(F.col("headers"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    records, repeated = told_apart(records.select("record_id", "warc_type", "target_uri", "date", "status", headers.alias("headers"), "payload"))
    responses = records.where((F.col("warc_type") == "response") & (F.col("status") == 200) & F.col("record_id").isNotNull())
    joined = bases(records, buckets)
    etag, modified = strong(header(F.col("headers"), "etag")), header(F.col("headers"), "last-modified")
    by_etag, by_date = etag == strong(F.col("base.etag")), modified == F.col("base.last_modified")
    outcome = (
        F.when(F.col("date").isNull(), "no_date")
        .when(F.col("base").isNull(), "no_response")
        .when(F.coalesce(by_etag, by_date).isNull(), "unverified")
        .when(F.coalesce(by_etag, by_date), "resolved")
        .otherwise("changed")
    )
    judged = joined.select("record_id", "url", "date", "headers", outcome.alias("outcome"), F.when(outcome == "resolved", F.col("base.record_id")).alias("base_id"), F.col("base.date").alias("base_date"), F.col("base.content").alias("content"))
    name = ["base_id", "base_date", "content"]
    stored = responses.select(F.col("record_id").alias("base_id"), F.col("date").alias("base_date"), "content", F.col("headers").alias("stored"), "payload")
    if repeated:  # rows that are equal in all
        stored = stored.groupBy(*name).agg(F.first("stored").alias("stored"), F.first("payload").alias("payload"))
    return judged.join(stored, name, "left").select("record_id", "url", "date", "outcome", "base_id", F.when(F.col("base_id").isNotNull(), merged_headers(F.col("stored"), F.col("headers"))).alias("headers"), "payload")
