"""License scans: canonical texts, looked up by digest.

A text is put into a canonical form: lower case, copyright statements dropped, every
stretch of other characters than letters, marks and digits one space, spellings that
license guidelines hold equal made one, word by word.  The digest of the whole form,
less a title line, and that of each line's form, are joined to the digests of known
license texts (``license_texts/``, one file for each wording) and one-line notices.

Edge cases: null and empty texts match nothing, nor do lines without letters or
digits; letters of every script count, so a text that holds a license beside other
words is not that license; a line that goes on with ``copyright notice`` and the like
is no statement; repeated documents match alike, each row for itself; a long text is
one unit and each of its lines another; known texts with equal canonical forms are
one, under the name that sorts first; extra columns of the documents are not carried.
"""

from __future__ import annotations

import hashlib
import importlib.resources
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Known texts up to this number are broadcast; more are shuffled.
BROADCAST_TEXTS = 10_000
#: Spellings held equal, as (found, made), in whole words.
SPELLINGS = (("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("sub licence", "sublicense"), ("non commercial", "noncommercial"), ("per cent", "percent"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("merchantible", "merchantable"), ("organisation", "organization"), ("whilst", "while"), ("copyright owner", "copyright holder"))
#: A lower-case line that states who holds the rights, and one that only goes on with the word.
COPYRIGHT = r"^[^\p{L}\p{N}]*((portions )?copyright[^\p{L}\p{N}]*[\p{L}\p{N}]|\(c\)[ \t]*(copyright|[0-9]{4})|©|all rights reserved[^\p{L}\p{N}]*$)"
NO_STATEMENT = r"^[^\p{L}\p{N}]*copyright[ \t]+(notices?|holders?|owners?|licen[sc]es?|laws?|and|or|interests?|statements?|in|to|of|for|rights?|is|are|protection|treat(y|ies)|permission|infringement|act|term|doctrine|disclaimer)([^\p{L}\p{N}]|$)"
#: A canonical first line that only names the license.
TITLE = "^(the )?([a-z0-9]+ ){0,4}license( (version|v|mit|isc|bsd|[0-9]+))*$"
OTHER = r"[^\p{L}\p{M}\p{N}]+"

#: Customary one-line notices.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Released under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def known_texts() -> dict[str, tuple[str, str]]:
    """License and text by name: the notices, and the files of ``license_texts`` (``<license>__<wording>.txt``)."""
    files = [f for f in importlib.resources.files(__package__).joinpath("license_texts").iterdir() if f.name.endswith(".txt")]
    found = {name: (name, text) for name, text in NOTICES.items()}
    return found | {f.name: (f.name.removesuffix(".txt").split("__")[0], f.read_text("utf-8")) for f in sorted(files, key=lambda f: f.name)}


def spelled(line: Column) -> Column:
    """A line in canonical spelling; its words stand in two spaces, so that each has one on either side."""
    for found, made in SPELLINGS:
        line = F.replace(line, F.lit(f" {found.replace(' ', '  ')} "), F.lit(f" {made.replace(' ', '  ')} "))
    return line


def canonical_lines(text: Column) -> Column:
    """The canonical forms of a text's lines, without copyright statements and empty ones."""
    lines = F.filter(F.split(F.lower(text), "\n"), lambda line: ~line.rlike(COPYRIGHT) | line.rlike(NO_STATEMENT))
    form = lambda line: F.trim(F.replace(spelled(F.concat(F.lit(" "), F.regexp_replace(line, OTHER, "  "), F.lit(" "))), F.lit("  "), F.lit(" ")))
    return F.filter(F.transform(lines, form), lambda line: line != "")


def whole(lines: Column) -> Column:
    """The canonical form of a text from its lines; a title line does not count."""
    titled = (F.size(lines) > 1) & lines[0].rlike(TITLE)
    return F.array_join(F.when(titled, F.slice(lines, 2, F.size(lines))).otherwise(lines), " ")


def known_notices(spark: SparkSession, texts: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(sorted((known_texts() if texts is None else texts).values()), "license_id string, text string")


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_texts: int = BROADCAST_TEXTS) -> DataFrame:
    """One row for each unit of a document that equals a known text: its id, the unit (``text`` or ``line``), license and digest.

    ``known`` has ``license_id`` and ``text``.  A line that is its whole text counts as text.
    """
    forms = known.select("license_id", canonical_lines(F.col("text")).alias("lines")).where(F.size("lines") > 0)
    forms = forms.select("license_id", whole(F.col("lines")).alias("form")).select("license_id", F.sha2("form", 256).alias("digest"), F.length("form").alias("size"))
    one = forms.groupBy("digest").agg(F.min("license_id").alias("license_id"))
    n, longest = forms.agg(F.count("*"), F.coalesce(F.max("size"), F.lit(0))).first()
    own = docs.select(F.col(id_col).alias("doc_id"), canonical_lines(F.col(text_col)).alias("lines")).select("doc_id", "lines", whole(F.col("lines")).alias("whole"))
    # only forms no longer than the longest known text can match, so no others are hashed
    fits = (F.size("lines") > 0) & (F.length("whole") <= longest)
    text = F.when(fits, F.array(F.struct(F.lit("text").alias("unit"), F.col("whole").alias("form"))))
    lines = F.when(F.size("lines") > 1, F.transform(F.filter("lines", lambda line: F.length(line) <= longest), lambda line: F.struct(F.lit("line").alias("unit"), line.alias("form"))))
    none = F.array().cast("array<struct<unit: string, form: string>>")
    spread = own.select("doc_id", F.explode(F.concat(F.coalesce(text, none), F.coalesce(lines, none))).alias("u")).select("doc_id", "u.unit", F.sha2(F.col("u.form"), 256).alias("digest"))
    return spread.join(F.broadcast(one) if n <= broadcast_texts else one, "digest").select("doc_id", "unit", "license_id", "digest")


def plain_form(text: str) -> str:
    """The canonical form of a known text once more, in plain Python."""
    lines = []
    for line in text.lower().split("\n"):
        line_words = re.sub(r"[\W_]+", " ", line)
        states = re.match(r"[\W_]*((portions )?copyright[\W_]*[^\W_]|\(c\)[ \t]*(copyright|\d{4})|all rights reserved[\W_]*$)|[^\w]*©", line)
        if states and not re.match(NO_STATEMENT.replace(r"[^\p{L}\p{N}]", r"[\W_]"), line):
            continue
        for found, made in SPELLINGS:
            line_words = re.sub(rf"(?<![^ ]){found}(?![^ ])", made, line_words)
        lines += [line_words.strip()] if line_words.strip() else []
    return " ".join(lines[1:] if len(lines) > 1 and re.match(TITLE, lines[0]) else lines)


def oracle() -> str:
    """The same in DuckDB, for the table ``documents``; digests of the known texts are made by ``plain_form``."""
    digests: dict[str, str] = {}
    for license_id, text in sorted(known_texts().values()):
        digests.setdefault(hashlib.sha256(plain_form(text).encode()).hexdigest(), license_id)
    values = ", ".join(f"('{k}', '{v}')" for k, v in digests.items())
    form = f"' ' || regexp_replace(line, '{OTHER}', '  ', 'g') || ' '"
    for found, made in SPELLINGS:
        form = f"replace({form}, ' {found.replace(' ', '  ')} ', ' {made.replace(' ', '  ')} ')"
    kept = f"list_filter(string_split(lower(text), chr(10)), lambda line: NOT regexp_matches(line, '{COPYRIGHT}') OR regexp_matches(line, '{NO_STATEMENT}'))"
    lines = f"list_filter(list_transform({kept}, lambda line: trim(replace({form}, '  ', ' '))), lambda line: line <> '')"
    return f"""
WITH known AS (
  SELECT * FROM (VALUES {values}) AS v(digest, license_id)
), d AS (
  SELECT doc_id, {lines} AS lines FROM documents WHERE text IS NOT NULL
), u AS (
  SELECT doc_id, 'text' AS unit, array_to_string(CASE WHEN len(lines) > 1 AND regexp_matches(lines[1], '{TITLE}') THEN lines[2:] ELSE lines END, ' ') AS form FROM d WHERE len(lines) > 0
  UNION ALL SELECT doc_id, 'line' AS unit, unnest(lines) AS form FROM d WHERE len(lines) > 1
)
SELECT doc_id, unit, license_id, known.digest AS digest FROM u JOIN known ON sha256(u.form) = known.digest
"""
