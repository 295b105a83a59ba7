"""Quality counts against plain Python, and the cascade against its rules in any order."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from leaselight.llm import quality


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = {g for g, n in Counter(grams).items() if n > 1}
    inside = {i + k for i, g in enumerate(grams) if g in often for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def texts():
    rng = random.Random(8)
    out = [None, "", " ", "\n\n", "one", "a b c d e f g h", "a b c d e f g h " * 2, "x " * 40, "é\x1c b\x0bc\x85d", "|" * 50, "\n".join(["same line"] * 5), "\U0001f600 # $"]
    for _ in range(80):
        out.append("".join(rng.choice(["a", "b", "cc", "Dé", "#", "|"]) + rng.choice([" ", "  ", "\n", "\t"]) for _ in range(rng.randrange(90))))
    return out


def test_counts(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    df = spark.createDataFrame([*rows, rows[5]], "doc_id long, text string, N_words string")
    got = quality.with_counts(df).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        assert tuple(getattr(r, c) for c in quality.COUNTS) == plain(rows[r.doc_id][1]), rows[r.doc_id][1]


def test_order_does_not_change_the_verdict(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string")
    one = {r.doc_id: r.kept for r in quality.judge(df, rules=quality.RULES).collect()}
    two = {r.doc_id: r.kept for r in quality.judge(df, rules=quality.RULES[::-1]).collect()}
    assert one == two
    prose = " ".join(f"word{i % 57}x{i}" for i in range(100))
    bad = {"symbols": prose.replace(" ", " | "), "upper_case": prose.upper().replace("0", "ABCD"), "dup_lines": "\n".join(["a line"] * 30)}
    frame = spark.createDataFrame([(prose,), *((b,) for b in bad.values())], "text string")
    assert [r.kept for r in quality.judge(frame).collect()] == [True, False, False, False]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, kept int")
    out = quality.judge(df)
    assert out.count() == 0 and out.columns == ["doc_id", "text", *quality.COUNTS, "base_failed", "kept"]


def test_native_plan(spark):
    plan = quality.judge(spark.range(3).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text")))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_the_cascade_keeps_what_judge_keeps(spark):
    prose = " ".join(f"word{i % 57}x{i}" for i in range(100))
    rows = [*texts(), prose, prose, prose.replace(" ", " | "), "\n".join(["a line"] * 30), prose.upper().replace("0", "ABCD"), None]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, Kept string")
    kept = quality.keep(df)
    assert kept.columns == df.columns
    want = {r.doc_id for r in quality.judge(df).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == want and {len(texts()), len(texts()) + 1} <= want
    assert quality.keep(df.where(F.lit(False))).count() == 0
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_later_rules_see_only_what_earlier_ones_pass(spark):
    df = spark.createDataFrame([(i, "short text") for i in range(300)], "doc_id long, text string")
    never = quality.Rule("never", lambda text, c: F.raise_error(F.concat(F.lit("evaluated "), text)).isNotNull(), per_char=1e9)
    ordered = [quality.BASE[0], never]
    verdict = F.expr("text")
    assert df.where(quality.let(verdict, lambda t: quality.let(quality.words(t), lambda own: quality.chain(ordered, t, quality.count_columns(t, own))))).count() == 0


def test_order_is_stable(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts() * 3)], "doc_id long, text string")
    orders = [[r.name for r in quality.order_rules(df, rules=(*quality.BASE, *quality.RULES))] for _ in range(3)]
    assert orders[0] == orders[1] == orders[2] and orders[0][0] == "few_words"
