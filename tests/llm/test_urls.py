"""URL filters against plain models over small tables."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from leaselight.llm import queries, urls

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    name, tail = rest[:cut], rest[cut:]
    end = min((tail.find(c) for c in "?#" if c in tail), default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in name), tail[:end]


def ruled(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


class Model:
    """Plain variable-order model with Witten-Bell mixing."""

    def __init__(self, texts, kinds, order=urls.ORDER):
        self.order, self.kinds, self.n = order, kinds, defaultdict(Counter)
        for t in texts:
            whole = urls.START + t + urls.END
            for i in range(1, len(whole)):
                for k in range(min(i, order) + 1):
                    self.n[whole[i - k : i]][whole[i]] += 1

    def p(self, context, c):
        before = 1 / self.kinds if not context else self.p(context[1:], c)
        seen = self.n.get(context)
        return (seen[c] + len(seen) * before) / (sum(seen.values()) + len(seen)) if seen else before

    def log(self, text):
        whole = urls.START + text + urls.END
        return [math.log(self.p(whole[max(0, i - self.order) : i], whole[i])) for i in range(1, len(whole))]


def write(spark, tmp_path, rows):
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    return queries.op13_urls(spark, str(tmp_path))


def names(n):
    return [f"http{'s' * (i % 2)}://{'Www.' * (i % 3 == 0)}{'abcde'[i % 5]}{'xyz'[i % 3]}.example.{('com', 'org', 'net')[i % 3]}/{('en', 'es', 'fr', 'de')[i // 3 % 4]}/{i * 37 % 211}{('', '/', '.html', '?q=1', '#top')[i % 5]}" for i in range(n)]


ODD = [None, "", "no scheme", "http://", "http://org", "http://org/", "http://notorg/", "http://x.ORG/é", "a://b://c/d", "http://example.org/es/x", "http://example.org/en/12", "http://u:p@Example.com:80/fr/", "http://h?x/y", "http://h#x/y", "http://multi\nline.com/fr/x", "http://long.net/" + "ab" * 20_000]


def test_query_equals_plain_models(spark, tmp_path):
    rows = [(i, u) for i, u in enumerate(names(240) + ODD)] + [(3, names(4)[3])] * 3 + [(None, "http://null.net/id")]
    found = write(spark, tmp_path, rows).collect()
    assert len(found) == len(rows)
    own = spark.createDataFrame(sorted({split(u) for _, u in rows}), "host string, path string").withColumn("held", F.pmod(F.xxhash64("host", "path"), F.lit(urls.HELD)) == 0)
    texts = {(r["host"], r["path"]): r["held"] and ruled(r["host"], r["path"])[1] is not None for r in own.collect()}
    train = {v: [h + p for (h, p), held in texts.items() if not held and ruled(h, p)[1] == v] for v in ("allow", "block")}
    kinds = len(set("".join(h + p for h, p in texts)) | {urls.END}) + 1
    good, bad = Model(train["allow"], kinds), Model(train["block"], kinds)
    mean = lambda t: sum(a - b for a, b in zip(good.log(t), bad.log(t))) / (len(t) + 1)
    bins = Counter()
    for (h, p), held in texts.items():
        if held:
            x = max(-urls.WIDEST, min(urls.WIDEST, mean(h + p)))
            bins[math.floor((x + urls.WIDEST) * ((urls.BINS - 1) / (2 * urls.WIDEST)) + 0.5), ruled(h, p)[1]] += 1
    at = sorted({b for b, _ in bins})
    calibration = urls.calibrate([(b * (2 * urls.WIDEST) / (urls.BINS - 1) - urls.WIDEST, bins[b, "allow"], bins[b, "block"]) for b in at])
    by_id = {r["page_id"]: r for r in found}
    for page_id, url in rows:
        r, (h, p) = by_id[page_id], split(url)
        rule, verdict = ruled(h, p)
        assert (r["host"], r["path"], r["rule"]) == (h, p, rule)
        if verdict:
            assert r["verdict"] == verdict and r["score"] is None
        else:
            expected = 1 / (1 + math.exp(-(calibration.slope * mean(h + p) + calibration.shift)))
            assert r["score"] == pytest.approx(expected, abs=1e-9)
            assert r["verdict"] == ("allow" if r["score"] >= 0.5 else "block")


def test_models_tell_kinds_apart(spark, tmp_path):
    good, bad = "river stone garden meadow forest".split(), "casino jackpot betting pills poker".split()
    made = lambda of, i: f"{of[i % 5]}-{of[i // 5 % 5]}{i}"
    rows = [(i, f"http://{made(good, i)}.org/x") for i in range(200)] + [(1000 + i, f"http://{made(bad, i)}.com/de/x") for i in range(200)]
    rows += [(2000 + i, f"http://{made(good, i)}.net/en/") for i in range(30)] + [(3000 + i, f"http://{made(bad, i)}.net/en/") for i in range(30)]
    found = {r["page_id"]: r["verdict"] for r in write(spark, tmp_path, rows).collect()}
    assert {found[2000 + i] for i in range(30)} == {"allow"} and {found[3000 + i] for i in range(30)} == {"block"}


@pytest.mark.parametrize("rows", [[], [(1, "http://a.net/x"), (2, None)], [(1, "http://a.org/x"), (2, "http://b.net/y")]])
def test_without_samples(spark, tmp_path, rows):
    found = write(spark, tmp_path, rows).collect()
    assert len(found) == len(rows) and all(r["verdict"] == "allow" for r in found)


def test_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.org/", "theirs", 3)], "page_id long, url string, Host string, more int")
    found = urls.judge(pages, queries.URL_RULES)
    assert found.columns == ["page_id", "url", "more", "host", "path", "rule", "verdict", "score"]
    assert found.first()["host"] == "a.org"


def test_tables_meet_by_shuffles(spark, monkeypatch):
    """However small their files are, tables of n-grams and of URLs do not pass through the driver."""
    plans, write = [], urls.cut
    told = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def kept(df):
        plans.append(told(df))
        return write(df)

    monkeypatch.setattr(urls, "cut", kept)
    pages = spark.range(200).select(F.col("id").alias("page_id"), F.format_string("http://h%s.example.%s/%s/%s", F.col("id") % 7, F.element_at(F.array(*map(F.lit, ("org", "com", "net"))), (F.col("id") % 3 + 1).cast("int")), F.element_at(F.array(*map(F.lit, ("fr", "de", "es"))), (F.col("id") % 4 % 3 + 1).cast("int")), "id").alias("url"))
    plans.append(told(urls.judge(pages, queries.URL_RULES)))
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
