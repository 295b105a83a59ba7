"""Quality rules as a short-circuit cascade, all in DataFrame functions.

Rules are ordered by rejections per cost, both estimated on a bounded sample: how many
of its texts a rule rejects, and how many characters and words they have, at what the
rule costs for each (``per_char``, ``per_word``).  Nothing is timed while it runs, so
the order is the same whenever the sample is.  The order changes the work, never the
verdict.

``keep`` is the cascade: each rule is an expression of its own over the text, and what it
counts is counted only where all rules before it have passed, the dear hashes of word
windows too.  ``judge`` reports the five counts of every text, and so has to make them;
its verdicts are those of ``keep``.

Edge cases: a null or empty text has no words and fails the base rules; repeated
rows are judged alike; a text without line feeds is one line; extra columns stay,
those named like an output column of ``judge`` are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: White space that parts words: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Rows and characters a text may have to be part of the sample that orders the rules.
SAMPLE_ROWS, SAMPLE_CHARS = 256, 20_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: the variable of a one-element transform."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"[ \t-\r]+")).otherwise(F.array().cast("array<string>"))


def count_of(text: Column, characters: str) -> Column:
    """How many of these characters a text has."""
    rest = text
    for c in characters:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return F.length(text) - F.length(rest)


def dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.btrim(line, F.lit(SPACE))) > 0)
    return let(lines, lambda kept: F.size(kept) - F.size(F.array_distinct(kept)))


def window_hashes(own: Column, n: int = WINDOW) -> Column:
    """A hash of each window of ``n`` words, by its start."""
    hashed = F.transform(own, lambda w: F.xxhash64(w))
    return F.when(
        F.size(own) >= n,
        let(hashed, lambda h: F.transform(F.sequence(F.lit(0), F.size(own) - n), lambda i: F.xxhash64(*(h[i + k] for k in range(n))))),
    ).otherwise(F.array().cast("array<bigint>"))


def repeat_words(hashes: Column, n: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more; texts without such a window cost one distinct count."""

    def covered(ordered: Column) -> Column:
        last = F.size(ordered) - 1
        same = lambda i: ((i > 0) & (ordered[F.greatest(i - 1, F.lit(0))]["h"] == ordered[i]["h"])) | ((i < last) & (ordered[F.least(i + 1, last)]["h"] == ordered[i]["h"]))
        starts = F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), last), same), lambda i: ordered[i]["at"]))
        joined = lambda at: F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-n).alias("before")), lambda acc, p: F.struct((acc["n"] + F.least(p - acc["before"], F.lit(n))).alias("n"), p.alias("before")), lambda acc: acc["n"])
        return let(starts, joined)

    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, covered))


def count_columns(text: Column, own: Column) -> dict[str, Column]:
    """Each count as an expression of the text and its words."""
    return {
        "n_words": F.size(own),
        "word_chars": F.length(text) - count_of(text, SPACE),
        "n_symbols": count_of(text, SYMBOLS),
        "n_dup_lines": dup_lines(text),
        "n_repeat_words": let(window_hashes(own), lambda h: repeat_words(h)),
    }


def counted(text: Column) -> Column:
    """The five counts of ``COUNTS`` as one struct.

    Texts, words and hashes are bound by ``let``: a filter that the optimiser moves
    down, past the projection that holds this column, computes them once as well.
    """
    struct = lambda t, own: F.struct(*(c.cast("bigint").alias(name) for name, c in count_columns(t, own).items()))
    return let(F.coalesce(text, F.lit("")), lambda t: let(words(t), lambda own: struct(t, own)))


def with_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the five counts of ``COUNTS`` as ``bigint`` columns."""
    keep = [f"`{c}`" for c in df.columns if c.lower() not in COUNTS]
    return df.select(*keep, counted(F.col(text_col)).alias("__counts")).select(*keep, "__counts.*")


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for a bad document, given its text and the counts by name; the costs are nanoseconds, of which only the proportions matter."""

    name: str
    rejects: Callable[[Column, Mapping[str, Column]], Column]
    per_char: float
    per_word: float = 0.0


#: The base rules: too few words, or too many in windows that repeat.
BASE = (
    Rule("few_words", lambda text, c: c["n_words"] < 20, per_char=0.1),
    Rule("repetition", lambda text, c: c["n_repeat_words"] * 100 > c["n_words"] * 30, per_char=1.0, per_word=180.0),
)
#: Rules beyond the base.  Each is lenient: ordinary prose of any length passes.
RULES = (
    Rule("symbols", lambda text, c: c["n_symbols"] * 4 > c["n_words"], per_char=4.0),
    Rule("word_length", lambda text, c: (c["word_chars"] > c["n_words"] * 20) | (c["word_chars"] < c["n_words"] * 2), per_char=3.0),
    Rule("dup_lines", lambda text, c: c["n_dup_lines"] * 2 > F.size(F.split(text, "\n")), per_char=6.0),
    Rule("upper_case", lambda text, c: F.regexp_count(text, F.lit(r"\p{Lu}{3}")) * 3 > c["n_words"], per_char=5.0),
    Rule("ellipses", lambda text, c: F.regexp_count(text, F.lit(r"(?:\.\.\.|…)[ \t\r]*(?:\n|$)")) * 10 > F.size(F.split(text, "\n")) * 3 + 10, per_char=9.0),
    Rule("bullets", lambda text, c: F.regexp_count(text, F.lit("(?m)^[ \t]*[-•●*+][ \t]")) * 10 > F.size(F.split(text, "\n")) * 9 + 10, per_char=5.0),
)


def base_failed(c: Mapping[str, Column]) -> Column:
    return BASE[0].rejects(None, c) | BASE[1].rejects(None, c)


def order_rules(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per cost on at most ``rows`` rows that the first tasks yield; ties keep their order.

    The sample only orders the cascade.  It stays small: bounded rows of bounded length.
    """
    sample = df.where(F.length(text_col) <= SAMPLE_CHARS).select(F.col(text_col).alias("text")).take(rows)
    if not sample:
        return list(rules)
    local = df.sparkSession.createDataFrame(sample, "text string").coalesce(1).select("text", counted(F.col("text")).alias("c"))
    text, c = F.col("text"), F.col("c")
    rejected = [F.count_if(rule.rejects(text, c)).alias(f"n_{i}") for i, rule in enumerate(rules)]
    seen = local.agg(F.sum(F.length("text")).alias("chars"), F.sum("c.n_words").alias("words"), *rejected).first()
    gain = [(seen[f"n_{i}"] + 0.5) / (1 + rule.per_char * seen["chars"] + rule.per_word * seen["words"]) for i, rule in enumerate(rules)]
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: (-gain[i], i))]


def chain(rules: list[Rule], text: Column, c: Mapping[str, Column]) -> Column:
    """False at the first rule that rejects; later ones are not evaluated then."""
    verdict = F
    for rule in rules:
        verdict = verdict.when(F.coalesce(rule.rejects(text, c), F.lit(False)), False)
    return verdict.otherwise(True)


def keep(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that no rule rejects; each count is made only for texts that have passed all rules before."""
    ordered = order_rules(df, text_col, (*BASE, *rules))
    verdict = lambda t: let(words(t), lambda own: chain(ordered, t, count_columns(t, own)))
    return df.where(let(F.coalesce(F.col(text_col), F.lit("")), verdict))


def judge(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add the counts, ``base_failed`` and ``kept``; each test on them runs only where all tests before it have passed."""
    ordered = order_rules(df, text_col, rules)
    verdict = lambda c: F.when(base_failed(c), False).otherwise(chain(ordered, F.coalesce(F.col(text_col), F.lit("")), c))
    kept = [f"`{c}`" for c in df.columns if c.lower() not in (*COUNTS, "base_failed", "kept")]
    step = df.select(*kept, counted(F.col(text_col)).alias("__counts"))
    return step.select(*kept, "__counts.*", base_failed(F.col("__counts")).alias("base_failed"), let(F.col("__counts"), verdict).alias("kept"))


#: The same in DuckDB, for the table ``documents``.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d
), win AS (
  SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS g
  FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w WHERE len(ws) >= 8)
), dup AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM dup) GROUP BY rid
), c AS (
  SELECT w.rid, doc_id, text, string_split(text, chr(10)) AS lines,
    len(ws)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS n_lines,
    len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_distinct,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep ON w.rid = rep.rid
), f AS (
  SELECT *, (n_lines - n_distinct)::BIGINT AS n_dup_lines, n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed FROM c
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed
    OR n_symbols * 4 > n_words
    OR word_chars > n_words * 20 OR word_chars < n_words * 2
    OR n_dup_lines * 2 > len(lines)
    OR len(regexp_extract_all(text, '\p{Lu}{3}')) * 3 > n_words
    OR len(regexp_extract_all(text, '(?:\.\.\.|…)[ \t\r]*(?:\n|$)')) * 10 > len(lines) * 3 + 10
    OR len(regexp_extract_all(text, '(?m)^[ \t]*[-•●*+][ \t]')) * 10 > len(lines) * 9 + 10) AS kept
FROM f
"""
