"""Row numbers over a whole order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import cut

#: ``monotonically_increasing_id`` holds the partition above so many bits.
_PART_BITS = 33


def numbered(rows: DataFrame, group: str, order: list[Column], pos: str = "pos", size: str = "size") -> DataFrame:
    """``rows`` with their place (from 0) in ``order`` within ``group``, and the group's size.

    Rows are dealt by ranges of group and order, so a group with a third of all rows
    lies in a third of the partitions; a row's place is its place in its partition and
    what the group has in earlier ones.  Only one row for each group and partition
    meets in a window.  Rows that are equal in the order are told apart by where they
    stand in what was written out, so even they are split.  ``group`` must not be null.
    """
    kept = cut(rows)  # ranges are found in a pass of their own: both must see the same rows in the same order
    keys = [F.col(group), *order, F.col("__tie")]
    placed = kept.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = cut(placed.drop("__tie").withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__at", _PART_BITS))
    parts = placed.groupBy(group, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    whole, before = Window.partitionBy(group), Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(group, "__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"), F.sum("__n").over(whole).alias(size))
    met = placed.join(starts, [group, "__part"])
    return met.withColumn(pos, F.col("__at") - F.col("__first") + F.col("__start")).select(*rows.columns, pos, size)
