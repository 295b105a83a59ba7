"""URL filters: rules for hosts and paths, and a character language model for what no rule decides.

A rule names a host and the start of a path, and fits that host and all below it; of
those that fit, the longest decides.  URLs that rules accept and reject are two samples
of their kind, and a variable-order Markov model is counted for each: how often a
character follows the up to ``ORDER`` characters before it.  A probability mixes that of
each length of context, shortest first, with a weight that grows with how often the
context was seen against how many different characters follow it (Witten and Bell); a
context that was not seen leaves the shorter one's word as it is.  The mean over a URL's
characters of the logarithm of the two models' ratio is calibrated by logistic
regression and gives a score; half and more is accepted.

Counts cover all distinct URLs (host and path) that rules decide, but for one in
``HELD`` by hash, which calibrate.  The models are tables: every n-gram that any URL
holds is looked up by join, after counts of n-grams are combined before each shuffle, so
tables grow with the variety of URLs; they meet by shuffles, and nothing but a histogram of ``BINS``
scores reaches the driver.  A context has at most as many rows as there are characters.

Edge cases: a null URL, or one without ``://``, has an empty host and path, as has one
whose host and path are empty; the models judge it by its end alone; copies of a URL
count once and get the same verdict; while rules leave either sample empty every score
is 0.5, so what no rule decides is accepted; a host may be any text, ports and names of
users belong to it; rows may repeat and ids may be null; extra columns are carried
along, one named like an output column is replaced.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import cut, shuffled

ORDER, HELD, BINS = 5, 5, 4096
#: Scores beyond this in either direction share the last bin of the histogram.
WIDEST = 8.0
START, END = "\u0002", "\u0003"
OUTPUT = ("host", "path", "rule", "verdict", "score")


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str = "/"

    def __str__(self) -> str:
        return self.host + self.path


def host(url: Column) -> Column:
    """What stands between the first ``://`` and a slash, question mark, hash or the end, A-Z in lower case; empty without."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to a question mark, hash or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(rules: list[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits, as a struct of its text and verdict; null if none does (of equally long ones the first of the list)."""
    fits = lambda r: ((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path))
    found = [F.when(fits(r), F.struct(F.lit(str(r)).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in sorted(rules, key=lambda r: -len(str(r)))]
    return F.coalesce(*found, F.lit(None).cast("struct<rule: string, verdict: string>"))


def grams(text: Column, order: int = ORDER) -> Column:
    """For each character of a text, and its end, that character with the up to ``order`` before it; the first of all is ``START``."""
    whole = F.concat(F.lit(START), text, F.lit(END))
    return F.transform(F.sequence(F.lit(2), F.length(whole)), lambda i: F.substr(whole, F.greatest(i - order, F.lit(1)), F.least(i, F.lit(order + 1))))


def log_ratios(counted: DataFrame, order: int = ORDER) -> DataFrame:
    """From n-grams with counts in both samples (``gram``, ``allow``, ``block``) the logarithm of the ratio of their last character's probabilities."""
    ends = F.explode(F.transform(F.sequence(F.lit(1), F.length("gram")), lambda n: F.right(F.col("gram"), n)))
    shorter = counted.select(ends.alias("gram"), "allow", "block").groupBy("gram").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
    after = F.expr("left(gram, length(gram) - 1)").alias("context")
    seen = lambda c: [F.sum(c).alias(f"{c}_n"), F.count_if(F.col(c) > 0).alias(f"{c}_kinds")]
    contexts = shorter.groupBy(after).agg(*seen("allow"), *seen("block"))
    known = cut(shorter.withColumn("context", after).join(shuffled(contexts), "context"))
    # characters that either sample may use, and one for all others
    kinds = known.where(F.length("gram") == 1).count() + 1

    def mixed(sample: str, before: Column) -> Column:
        """A context's own word, and that of the shorter one by the number of different characters that follow."""
        total = F.col(f"{sample}_n") + F.col(f"{sample}_kinds")
        return F.when(total > 0, (F.col(sample) + F.col(f"{sample}_kinds") * before) / total).otherwise(before)

    samples = ("allow", "block")
    level = None
    out = []
    for n in range(1, order + 2):
        rows = known.where(F.length("gram") == n)
        if level is None:
            likely = rows.select("gram", *(mixed(s, F.lit(1 / kinds)).alias(f"p_{s}") for s in samples))
        else:
            last = level.select(F.col("gram").alias("short"), *(F.col(f"p_{s}").alias(f"q_{s}") for s in samples))
            likely = rows.withColumn("short", F.expr("right(gram, length(gram) - 1)")).join(shuffled(last), "short").select("gram", *(mixed(s, F.col(f"q_{s}")).alias(f"p_{s}") for s in samples))
        level = likely = cut(likely)  # else each length's plan would hold those of all shorter ones
        whole = F.lit(n == order + 1) | F.startswith("gram", F.lit(START))
        out.append(likely.where(whole).select("gram", F.log(F.col("p_allow") / F.col("p_block")).alias("gain")))
    return functools.reduce(DataFrame.unionByName, out)


@dataclass(frozen=True)
class Calibration:
    """The score of a mean log ratio x is 1 / (1 + exp(-(slope * x + shift)))."""

    slope: float = 0.0
    shift: float = 0.0

    def score(self, x: Column) -> Column:
        return 1 / (1 + F.exp(-(F.lit(self.slope) * x + F.lit(self.shift))))


def calibrate(bins: list[tuple[float, float, float]], penalty: float = 1e-3) -> Calibration:
    """Logistic regression by Newton steps over (value, accepted, rejected) of a histogram; both kinds weigh the same in all."""
    x, good, bad = (np.array(c, float) for c in zip(*bins)) if bins else (np.zeros(0),) * 3
    if not good.sum() or not bad.sum():
        return Calibration(1.0, 0.0)
    good, bad = good / good.sum() / 2, bad / bad.sum() / 2
    a, w = np.c_[x, np.ones(len(x))], np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p * (good + bad) - good) + penalty * w
        curve = (a * (p * (1 - p) * (good + bad))[:, None]).T @ a + penalty * np.eye(2)
        w -= np.linalg.solve(curve, grad)
    return Calibration(float(w[0]), float(w[1]))


def means(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """Distinct (``host``, ``path``) with the verdict of their rule: adds ``mean``, their mean log ratio (null without both samples), and ``held``, whether they calibrate.

    Only texts that no rule decides, and those that calibrate, are scored.
    """
    dealt = F.pmod(F.xxhash64("host", "path"), F.lit(HELD)) == 0
    own = cut(texts.withColumn("held", dealt & F.col("known").isNotNull()))
    each = own.select("host", "path", "known", "held", F.explode(grams(F.concat("host", "path"), order)).alias("gram"))
    in_sample = lambda v: F.count_if((F.col("known") == v) & ~F.col("held")).alias(v)
    gains = cut(log_ratios(each.groupBy("gram").agg(in_sample("allow"), in_sample("block")), order))
    asked = each.where("held OR known IS NULL").groupBy("host", "path", "gram").agg(F.count("*").alias("n"))
    sizes = F.length("host") + F.length("path") + 1
    scored = asked.join(shuffled(gains), "gram").groupBy("host", "path").agg((F.sum(F.col("gain") * F.col("n")) / F.first(sizes)).alias("mean"))
    return own.join(shuffled(scored), ["host", "path"], "left")


def judge(pages: DataFrame, rules: list[Rule], url_col: str = "url", order: int = ORDER) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``score`` (null where a rule decides)."""
    keep = [F.col(f"`{c.replace('`', '``')}`") for c in pages.columns if c.lower() not in OUTPUT]
    placed = pages.select(*keep, host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    texts = placed.select("host", "path").distinct().withColumn("known", ruled(rules, F.col("host"), F.col("path"))["verdict"])
    found = cut(means(texts, order))
    bins = F.round((F.greatest(F.lit(-WIDEST), F.least(F.lit(WIDEST), "mean")) + WIDEST) * ((BINS - 1) / (2 * WIDEST)))
    kinds = {r["known"]: r["n"] for r in found.where("known IS NOT NULL AND NOT held").groupBy("known").agg(F.count("*").alias("n")).collect()}
    if len(kinds) == 2:
        counted = found.where("held").groupBy(bins.alias("bin")).agg(F.count_if(F.col("known") == "allow").alias("a"), F.count_if(F.col("known") == "block").alias("b")).collect()  # BINS rows at most
        calibration = calibrate([(r["bin"] * (2 * WIDEST) / (BINS - 1) - WIDEST, r["a"], r["b"]) for r in sorted(counted) if not math.isnan(r["bin"])])
        score = calibration.score(F.col("mean"))
    else:
        score = F.lit(0.5)
    scored = found.where("known IS NULL").select(F.col("host").alias("__host"), F.col("path").alias("__path"), score.alias("score"))
    met = placed.withColumn("__rule", ruled(rules, F.col("host"), F.col("path"))).join(shuffled(scored), (F.col("host") == F.col("__host")) & (F.col("path") == F.col("__path")), "left")
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(F.col("score") >= 0.5, "allow").otherwise("block"))
    return met.select(*keep, "host", "path", F.col("__rule.rule").alias("rule"), verdict.alias("verdict"), "score")
