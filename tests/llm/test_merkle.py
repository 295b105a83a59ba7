"""The manifest against a plain tree over small tables, with any shape of blocks."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from leaselight.llm import merkle, numbers, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    n = row["n_chars"] if row["n_chars"] is None else row["n_chars"] + more
    return h(*map(said, (row["doc_id"], row["source"], row["lang"], n, row["text"])))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def climb(tree, at):
    """Siblings from a place upwards, with their side; None on a level without."""
    out = []
    for nodes in tree[:-1]:
        other = at ^ 1
        out.append((nodes[other], bool(at % 2)) if other < len(nodes) else None)
        at //= 2
    return out


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = {g: levels([leaf(r) for r in groups[g]]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for i, g in enumerate(names):
        for at, r in enumerate(groups[g]):
            path = climb(trees[g], at) + climb(top, i)
            changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            d = leaf(r, 1 if changed else 0)
            for step in path:
                d = h(d) if step is None else h(step[0], d) if step[1] else h(d, step[0])
            out.append((r["doc_id"], leaf(r), trees[g][-1][0], top[-1][0], h(*(s[0] for s in path if s)), d, d == top[-1][0]))
    return out


def table(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return [r.asDict() for r in df.collect()]


def test_query_equals_plain_tree(spark, tmp_path):
    long = "x" * 300_000
    rows = [(i, f"text {i}", "en" if i % 3 else None, None if i % 5 else "hot", None if i % 11 == 0 else i) for i in range(90)]
    rows += [(7, "other", "en", "a", 1)] * 3 + [(None, None, None, None, None), (1000, "", "de", "", 0), (1001, long, "é", "b", 300_000)]
    own = table(spark, tmp_path, rows)
    assert sorted(map(tuple, queries.op11_merkle(spark, str(tmp_path)).collect()), key=repr) == sorted(plain(own), key=repr)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9, 17, 33, 64])
def test_every_size_with_small_blocks(spark, n):
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.sha2(F.col("id").cast("string"), 256).alias("d"), F.lit(1).alias("pos"), F.lit(2).alias("`odd name"))
    found = merkle.manifest(rows, F.col("d"), "lang", "doc_id", bits=2)
    tree = levels([hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)])
    assert found.columns == ["doc_id", "lang", "d", "`odd name", "digest", "path", "subroot", "root"]
    for r in found.collect():
        assert [None if s is None or s["sibling"] is None else (s["sibling"], s["on_left"]) for s in r["path"]] == climb(tree, r["doc_id"])
        assert r["subroot"] == r["root"] == tree[-1][0]
    assert found.where(merkle.folded(F.col("digest"), F.col("path")) == F.col("root")).count() == n
    assert found.where(merkle.folded(F.sha2("digest", 256), F.col("path")) == F.col("root")).count() == 0


def test_many_groups_need_rounds_of_their_own(spark):
    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.format_string("g%03d", "id").alias("lang"))
    found = merkle.manifest(rows, F.sha2("lang", 256), "lang", "doc_id", bits=1).collect()
    top = levels([hashlib.sha256(f"g{i:03d}".encode()).hexdigest() for i in range(40)])
    assert {r["root"] for r in found} == {top[-1][0]}
    assert {r["doc_id"]: len(r["path"]) for r in found} == dict.fromkeys(range(40), len(top) - 1)


def test_empty_table(spark, tmp_path):
    table(spark, tmp_path, [])
    assert queries.op11_merkle(spark, str(tmp_path)).collect() == []


def test_numbers_split_a_hot_group(spark):
    rows = spark.range(500).select(F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("g"), (F.col("id") % 7).alias("x"))
    found = numbers.numbered(rows, "g", [F.col("x").desc()]).collect()
    for g in ("hot", "cold"):
        own = sorted((r["pos"], r["x"], r["size"]) for r in found if r["g"] == g)
        assert [r[0] for r in own] == list(range(len(own))) and {r[2] for r in own} == {len(own)}
        assert [r[1] for r in own] == sorted((r[1] for r in own), reverse=True)
