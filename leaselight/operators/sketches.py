"""Quartiles and means of market figures at several levels from one pass, by sketches that merge.

Rows are read once, at the finest level.  Each group keeps a KLL sketch of its rents, which holds a
bounded number of values however many rows there are, and the sums that means need; coarser
levels merge those.  A sketch of size ``K`` answers a quantile with a rank that is off
by less than ``RANK_ERROR`` of the rows (99 times in 100), whatever the order and partition
of the rows; groups of fewer rows than the sketch has room for are exact.  Where exact medians are
wanted, ``benchmark`` gives them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

K = 400
#: Twice the normalised rank error that a sketch of this size has by its authors' analysis, to cover merges.
RANK_ERROR = 0.02
#: Levels, finest first, and how many rows a group of each needs to be told.
LEVELS = {"station": (["prefecture", "municipality", "station_name", "layout_type"], 30), "municipality": (["prefecture", "municipality", "layout_type"], 30), "prefecture": (["prefecture", "layout_type"], 200)}


def sketched(rows: DataFrame, keys: list[str], value: str = "rent_yen", score: str | None = None) -> DataFrame:
    """One row for each key: a sketch of the values, how many there are, and the sum and number of scores."""
    scores = F.col(score).cast("double") if score else F.lit(None).cast("double")
    known = rows.where(F.col(value).isNotNull())
    return known.groupBy(*keys).agg(F.kll_sketch_agg_bigint(F.col(value).cast("bigint"), F.lit(K)).alias("sketch"), F.count("*").alias("n_rows"), F.sum(scores).alias("score_sum"), F.count(scores).alias("score_n"))


def rolled_up(fine: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser keys from those of finer ones."""
    return fine.groupBy(*keys).agg(F.kll_merge_agg_bigint("sketch", F.lit(K)).alias("sketch"), F.sum("n_rows").alias("n_rows"), F.sum("score_sum").alias("score_sum"), F.sum("score_n").alias("score_n"))


def quantile(sketch: Column, share: float) -> Column:
    return F.kll_sketch_get_quantile_bigint(sketch, F.lit(share))


def summary(rows: DataFrame, value: str = "rent_yen", score: str | None = None, levels: dict[str, tuple[list[str], int]] = LEVELS) -> DataFrame:
    """Quartiles, mean score and number of rows of every level's groups that have enough rows; keys that a level lacks are null."""
    finest = next(iter(levels.values()))[0]
    fine = sketched(rows.where(" AND ".join(f"{k} IS NOT NULL" for k in levels[list(levels)[-1]][0])), finest, value, score)
    out = None
    for level, (keys, least) in levels.items():
        # what lacks a finer key counts for the coarser levels only
        group = (fine if keys == finest else rolled_up(fine, keys)).where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).where(F.col("n_rows") >= least)
        told = group.select(
            F.lit(level).alias("level"), *(F.col(k) if k in keys else F.lit(None).cast("string").alias(k) for k in finest), "n_rows",
            *(quantile(F.col("sketch"), q).alias(name) for name, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))), (F.col("score_sum") / F.col("score_n")).alias("mean_score"),
        )
        out = told if out is None else out.unionByName(told)
    return out
