"""Revisit resolution against a loop over sorted captures."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from leaselight.llm import warc

SCHEMA = "record_id string, warc_type string, target_uri string, date timestamp_ntz, status int, headers map<string,string>, payload string, url string"


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://WWW.Example.com:443/A/b/?b=2&utm_source=x&a=1#top", "example.com/A/b?a=1&b=2"),
        ("http://m.example.com/A/b?a=1&b=2&ref=q", "example.com/A/b?a=1&b=2"),
        ("example.com", "example.com"),
        ("https://example.com/?referrer=1&&ref", "example.com?referrer=1"),
        (None, None),
    ],
)
def test_canonical_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(warc.canonical_url(F.col("u"))).first()[0] == want


def captures(rng, n):
    rows = []
    for i in range(n):
        hot = rng.random() < 0.4
        url = rng.choice(["http", "https"]) + "://a.org/" + ("hot" if hot else str(rng.randrange(12))) + rng.choice(["", "/", "#x"])
        date = None if rng.random() < 0.03 else datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=rng.randrange(400))
        kind = rng.choice(["response", "revisit"])
        headers = {k: v for k, v in {"etag": rng.choice(['"1"', 'W/"1"', '"2"', "", None]), "last-modified": rng.choice(["x", "y", None]), "content-type": kind, "cache-control": f"c{i}"}.items() if v is not None}
        status = rng.choice([200, 200, 404]) if kind == "response" else 304
        rows.append((f"r{i:04}", kind, rng.choice([url, url, url, None]) if i % 50 == 0 else url, date, status, None if i % 37 == 0 else headers, f"body{i}" if kind == "response" else None, "x"))
    return rows


def plain(rows):
    canonical = lambda u: None if u is None else re.sub("/+$", "", re.sub("#.*", "", u).split("://")[1])
    out = {}
    for rid, kind, uri, date, _, headers, _, _ in rows:
        if kind != "revisit":
            continue
        headers = headers or {}
        before = [r for r in rows if r[1] == "response" and r[4] == 200 and r[3] and date and uri and canonical(r[2]) == canonical(uri) and (r[3], r[0]) < (date, rid)]
        base = max(before, key=lambda r: (r[3], r[0]), default=None)
        if not date:
            out[rid] = ("no_date", None, None, None)
        elif base is None:
            out[rid] = ("no_response", None, None, None)
        else:
            own = base[5] or {}
            tag = lambda h: (h.get("etag") or "").removeprefix("W/")
            if tag(headers) and tag(own):
                same = tag(headers) == tag(own)
            elif headers.get("last-modified") and own.get("last-modified"):
                same = headers["last-modified"] == own["last-modified"]
            else:
                same = None
            if same:
                out[rid] = ("resolved", base[0], own | {k: v for k, v in headers.items() if k != "content-type"}, base[6])
            else:
                out[rid] = ("unverified" if same is None else "changed", None, None, None)
    return out


def test_against_a_loop(spark):
    rows = captures(random.Random(5), 600)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for buckets in (1, 8):
        got = {r.record_id: (r.outcome, r.base_id, r.headers, r.payload) for r in warc.resolve(df, buckets).collect()}
        assert got == plain(rows)


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert warc.resolve(df).count() == 0
    rows = captures(random.Random(6), 60)
    revisits = [r for r in rows if r[1] == "revisit"]
    twice = spark.createDataFrame(rows + revisits, SCHEMA)
    assert warc.resolve(twice).count() == 2 * len(revisits)


def test_repeated_responses(spark):
    """However often rows repeat, each row of a revisit has one row in the result."""
    rows = captures(random.Random(7), 200)
    want = plain(rows)
    thrice = spark.createDataFrame(rows * 3, SCHEMA).repartition(4)
    got = warc.resolve(thrice).collect()
    assert len(got) == 3 * len(want)
    assert all((r.outcome, r.base_id, r.headers, r.payload) == want[r.record_id] for r in got)
    other = [(*r[:6], "another body", r[7]) for r in rows if r[1] == "response"]  # the same ids with other contents
    assert len(warc.resolve(spark.createDataFrame(rows + other, SCHEMA)).collect()) == len(want)


def test_rows_without_an_id(spark):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    tag = {"etag": '"1"'}
    rows = [("a", "response", "http://a.org/x", at(1), 200, tag, "body", None), (None, "response", "http://a.org/x", at(2), 200, tag, "nameless", None), (None, "revisit", "http://a.org/x", at(3), 304, tag, None, None), (None, "revisit", "http://a.org/x", at(3), 304, tag, None, None), (None, "revisit", None, at(3), 304, tag, None, None), (None, "revisit", "http://a.org/x", None, 304, tag, None, None)]
    got = sorted((r.outcome, r.base_id or "", r.payload or "") for r in warc.resolve(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("no_date", "", ""), ("no_response", "", ""), ("resolved", "a", "body"), ("resolved", "a", "body")]


def test_responses_of_one_id_keep_their_own_bodies(spark):
    at = lambda day, s: datetime.datetime(2024, 1, day, 0, 0, s)
    said = lambda tag, day, s, body: ("r", "response", "http://a.org/x", at(day, s), 200, {"etag": tag}, body, None)
    rows = [said('"a"', 1, 0, "AAA"), said('"b"', 2, 0, "BBB"), said('"b"', 2, 0, "BBB"), ("v", "revisit", "http://a.org/x", at(3, 0), 304, {"etag": '"b"'}, None, None), ("w", "revisit", "http://a.org/x", at(1, 5), 304, {"etag": '"a"'}, None, None), ("z", "revisit", "http://a.org/x", at(1, 6), 304, {"etag": '"b"'}, None, None)]
    got = sorted((r.record_id, r.outcome, r.headers and r.headers["etag"], r.payload) for r in warc.resolve(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("v", "resolved", '"b"', "BBB"), ("w", "resolved", '"a"', "AAA"), ("z", "changed", None, None)]
