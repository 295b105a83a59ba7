"""Merkle manifest of a dataset: a digest for every row, one for every group, one for the whole, and a proof for each row.

Rows are leaves.  In a group they stand in an order; every two consecutive nodes
become one of the next level (a last one without a partner is hashed alone), until one
remains, the group's root; the groups' roots give the root of all by the same rule.

The tree is built in blocks of ``2**BLOCK_BITS`` aligned leaves.  A block is walked in
postorder by recursion: a call returns the digest of its subtree and, as it unwinds,
appends the sibling that it met to the leaves below.  Roots of blocks are the leaves of
the next round.  Going up, rounds keep digests only; going down again, every block gets
the path above it and hands it to its leaves, so no path is shuffled but one for each
block.  Rounds are few: each has ``2**BLOCK_BITS`` times fewer nodes.

Edge cases: null fields have a digest form of their own, so null and an empty text
differ; ids may repeat or be null (first): rows of one id stand in the order of their
digests, and equal rows may stand for one another; a group of one row is its own root
with nothing beside it; an empty table has no rows and no root; null is a group of its
own; extra columns are carried along, one named like an output column is replaced.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .numbers import numbered
from .scratch import cut

BLOCK_BITS = 8

_STEP = pa.struct([("sibling", pa.string()), ("on_left", pa.bool_())])
PATH = T.ArrayType(T.StructType([T.StructField("sibling", T.StringType()), T.StructField("on_left", T.BooleanType())]))
_NODE = T.StructType([T.StructField("tree", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("size", T.LongType())])


def field(value: Column) -> Column:
    """A value as it enters a digest: its number of bytes, a colon and itself; a dash if it is null."""
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def joined(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def subtree(digests: list[str], low: int, high: int, height: int, paths: list[list[dict]] | None = None) -> str:
    """The digest of the node of this height over leaves ``low`` to ``high``; what stands beside it on each level goes to the paths of the leaves below."""
    if height == 0:
        return digests[low]
    middle = low + (1 << (height - 1))
    left = subtree(digests, low, min(middle, high), height - 1, paths)
    if middle >= high:
        for p in paths[low:high] if paths else ():
            p.append(None)
        return joined(left)
    right = subtree(digests, middle, high, height - 1, paths)
    if paths:
        beside_left, beside_right = {"sibling": right, "on_left": False}, {"sibling": left, "on_left": True}
        for p in paths[low:middle]:
            p.append(beside_left)
        for p in paths[middle:high]:
            p.append(beside_right)
    return joined(left, right)


def height(size: int, bits: int) -> int:
    """Levels that a block adds in a tree of ``size`` nodes: all of them in its last round."""
    return bits if size > 1 << bits else (size - 1).bit_length()


def _in_order(block: pa.Table) -> pa.Table:
    return block.take(pc.sort_indices(block["pos"]))


def block_roots(nodes: DataFrame, bits: int) -> DataFrame:
    """One round up: the root of every aligned block is a node of the next."""

    def root(block: pa.Table) -> pa.Table:
        block = _in_order(block)
        size = block["size"][0].as_py()
        digest = subtree(block["digest"].to_pylist(), 0, block.num_rows, height(size, bits))
        return pa.table({"tree": [block["tree"][0].as_py()], "pos": pa.array([block["pos"][0].as_py() >> bits]), "digest": [digest], "size": pa.array([-(-size // (1 << bits))])})

    return nodes.select("tree", "pos", "digest", "size").groupBy("tree", F.shiftright("pos", bits).alias("block")).applyInArrow(root, _NODE)


def with_paths(nodes: DataFrame, above: DataFrame, bits: int) -> DataFrame:
    """One round down: nodes with their path to the root, from those of their blocks (``tree``, ``block``, ``path``, ``subroot``, ``root``)."""
    kept = [f for f in nodes.schema.fields if f.name not in ("tree", "pos", "size")]
    ends = [T.StructField("path", PATH), T.StructField("subroot", T.StringType()), T.StructField("root", T.StringType())]
    where = [T.StructField("tree", T.StringType()), T.StructField("pos", T.LongType())]
    schema = T.StructType([*where, *kept, *ends])

    def walk(block: pa.Table, upper: pa.Table) -> pa.Table:
        block = _in_order(block)
        paths: list[list] = [[] for _ in range(block.num_rows)]
        if block.num_rows:
            subtree(block["digest"].to_pylist(), 0, block.num_rows, height(block["size"][0].as_py(), bits), paths)
        rest = upper["path"][0].as_py() if upper.num_rows else []
        ends = [upper[c][0].as_py() if upper.num_rows else None for c in ("subroot", "root")]
        columns = [*(block[f.name] for f in (*where, *kept)), pa.array([p + rest for p in paths], pa.list_(_STEP)), *(pa.array([e] * block.num_rows, pa.string()) for e in ends)]
        return pa.table(columns, names=schema.names)

    dealt = nodes.withColumn("block", F.shiftright("pos", bits)).groupBy("tree", "block")
    return dealt.cogroup(above.groupBy("tree", "block")).applyInArrow(walk, schema)


def _rounds(leaves: DataFrame, bits: int) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of every round, and the roots of all trees."""
    levels, most = [leaves], leaves.agg(F.max("size")).first()[0] or 0
    while most > 1 << bits:
        levels.append(cut(block_roots(levels[-1], bits)))
        most = -(-most // (1 << bits))
    return levels, cut(block_roots(levels[-1], bits))


def _descend(levels: list[DataFrame], above: DataFrame, bits: int) -> DataFrame:
    for i, nodes in enumerate(reversed(levels)):
        found = with_paths(nodes, above, bits)
        if i < len(levels) - 1:
            above = cut(found.select("tree", F.col("pos").alias("block"), "path", "subroot", "root"))
    return found


def manifest(rows: DataFrame, digest: Column, group: str, order: str, bits: int = BLOCK_BITS) -> DataFrame:
    """``rows`` with their ``digest``, ``path`` (from the leaf upwards: sibling, or null for a level without, and its side), ``subroot`` and ``root``."""
    made = ("tree", "pos", "size", "digest", "path", "subroot", "root", "block")
    keep = [c for c in rows.columns if c.lower() not in made]
    hidden = [f"__kept_{i}" for i in range(len(keep))]  # columns of any name come through Arrow
    named = lambda c: F.col(f"`{c.replace('`', '``')}`")
    leaves = rows.select(*(named(c).alias(h) for c, h in zip(keep, hidden)), F.coalesce(F.concat(F.lit("="), named(group).cast("string")), F.lit("")).alias("tree"), named(order).alias("__order"), digest.alias("digest"))
    placed = cut(numbered(leaves, "tree", [F.col("__order").asc_nulls_first(), F.col("digest")]).drop("__order"))
    levels, subroots = _rounds(placed, bits)
    trees = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "tree", [F.col("name")])
    above, root = _rounds(cut(trees), bits)
    top = root.select("tree", F.lit(0).cast("long").alias("block"), F.array().cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    of_trees = cut(_descend(above, top, bits).select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("block"), "path", F.col("digest").alias("subroot"), "root"))
    found = _descend(levels, of_trees, bits)
    return found.select(*(F.col(h).alias(c) for h, c in zip(hidden, keep)), "digest", "path", "subroot", "root")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""
    beside = lambda step, left: F.coalesce(F.when(step["on_left"] == left, step["sibling"]), F.lit(""))
    return F.aggregate(path, start, lambda d, step: F.sha2(F.concat(beside(step, True), d, beside(step, False)), 256))


def proof_digest(path: Column) -> Column:
    """One digest of all siblings of a path, from the leaf upwards."""
    return F.sha2(F.array_join(F.transform(F.filter(path, lambda s: s["sibling"].isNotNull()), lambda s: s["sibling"]), ""), 256)


#: DuckDB: the table of CRC-32, one number for each byte.
CRC_TABLE_SQL = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS t)"


def crc32_sql(text: str, table: str = "crc.t") -> str:
    """DuckDB: unsigned CRC-32 of a text's UTF-8 bytes, from a row of ``CRC_TABLE_SQL``."""
    data = f"list_transform(range(1, 2 * strlen({text}), 2), lambda i: CAST('0x' || substr(hex(encode({text})), i, 2) AS BIGINT))"
    return f"xor(4294967295, list_reduce([4294967295] || {data}, lambda c, b: xor(c >> 8, {table}[xor(c & 255, b) + 1])))"


def oracle() -> str:
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    digest = lambda n: f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', n, 'text')))})"
    return f"""WITH RECURSIVE {CRC_TABLE_SQL}, l AS (
  SELECT doc_id, lang, {digest('n_chars')} AS leaf, CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN {digest('(n_chars + 1)')} END AS tampered FROM documents, crc
), p AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM l
), t AS (
  SELECT lang, 0 AS lvl, pos AS idx, leaf AS d, n FROM p
  UNION ALL SELECT lang, lvl + 1, idx // 2, sha256(string_agg(d, '' ORDER BY idx)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY lang, lvl, idx // 2, n
), s AS (SELECT lang, d, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1
), u AS (
  SELECT 0 AS lvl, pos AS idx, d, n FROM s
  UNION ALL SELECT lvl + 1, idx // 2, sha256(string_agg(d, '' ORDER BY idx)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY lvl, idx // 2, n
), f AS (
  SELECT doc_id, lang, pos AS own, pos AS idx, 0 AS lvl, n, '' AS proof, coalesce(tampered, leaf) AS acc FROM p
  UNION ALL SELECT f.doc_id, f.lang, f.own, f.idx // 2, f.lvl + 1, (f.n + 1) // 2, f.proof || coalesce(t.d, ''), sha256(CASE WHEN f.idx % 2 = 1 THEN t.d ELSE '' END || f.acc || CASE WHEN f.idx % 2 = 0 THEN coalesce(t.d, '') ELSE '' END)
  FROM f LEFT JOIN (SELECT lang AS tl, lvl AS tv, idx AS ti, d FROM t) t ON f.lang IS NOT DISTINCT FROM t.tl AND t.tv = f.lvl AND t.ti = xor(f.idx, 1) WHERE f.n > 1
), g AS (
  SELECT f.doc_id, f.lang, f.own, s.d AS subroot, s.pos AS idx, 0 AS lvl, s.n, f.proof, f.acc FROM f JOIN s ON f.lang IS NOT DISTINCT FROM s.lang WHERE f.n = 1
), h AS (
  SELECT * FROM g
  UNION ALL SELECT h.doc_id, h.lang, h.own, h.subroot, h.idx // 2, h.lvl + 1, (h.n + 1) // 2, h.proof || coalesce(u.d, ''), sha256(CASE WHEN h.idx % 2 = 1 THEN u.d ELSE '' END || h.acc || CASE WHEN h.idx % 2 = 0 THEN coalesce(u.d, '') ELSE '' END)
  FROM h LEFT JOIN (SELECT lvl AS uv, idx AS ui, d FROM u) u ON u.uv = h.lvl AND u.ui = xor(h.idx, 1) WHERE h.n > 1
)
SELECT p.doc_id, p.leaf, h.subroot, u.d AS root, sha256(h.proof) AS proof_sha256, h.acc AS folded_root, h.acc = u.d AS verified
FROM h JOIN p ON p.lang IS NOT DISTINCT FROM h.lang AND p.pos = h.own, u WHERE h.n = 1 AND u.n = 1"""
