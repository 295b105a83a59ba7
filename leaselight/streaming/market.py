"""Market rows as they arrive: repeated rows kept once, and an index that follows, one version for each batch.

A store is a folder: ``rows/batch=n`` holds what batch n brought that no earlier one had,
``counts/batch=n`` how often each rent occurs there by key, and ``index/version=n`` the
index rows of all keys that batch n touched.  Every batch writes folders of its own and
overwrites them if it is given again, and reads only those of earlier batches: a replayed
batch leaves the store as it was, and one that comes late adds what it has.  After all
batches the index is that of all rows at once, however they were dealt.

Medians are exact: they come from counts of rents, which add up.  ``compact`` makes one
batch of all counts, so that reading them does not grow with the number of batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import benchmark, market

#: Columns that tell arriving rows apart; of rows that agree in all of them one is kept.
SAME = (*market.KEY, "avg_rent_yen", "source_name", "source_updated_at")
#: Keys of the index by level, finest first.
LEVELS = {"structure": market.KEY, "municipality": market.PLACE, "prefecture": ["prefecture", "layout_type"]}
_COUNTS = ", ".join(f"{c} string" for c in market.KEY) + ", avg_rent_yen bigint, n bigint"
_INDEX = "level string, " + ", ".join(f"{c} string" for c in market.KEY) + ", benchmark_rent_yen_median bigint, n_rows bigint"


def _stored(spark: SparkSession, path: str, schema: str, part: str, before: int | None = None) -> DataFrame:
    """What lies below ``path``, of parts before a number; an empty frame while there is nothing."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    schema = f"{schema}, {part} bigint"
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema).parquet(path)
    return found if before is None else found.where(F.col(part) < before)


def _alike(a: DataFrame, b: DataFrame, columns: tuple[str, ...]) -> Column:
    condition = F.lit(True)
    for c in columns:
        condition = condition & a[c].eqNullSafe(b[c])
    return condition


def levels(counts: DataFrame) -> DataFrame:
    """The index from counts of rents (``KEY``, ``avg_rent_yen``, ``n``): truncated medians and numbers of rows at three levels."""
    level = F.when(F.grouping("building_structure") == 0, "structure").when(F.grouping("municipality") == 0, "municipality").otherwise("prefecture").alias("level")
    sets = [[F.col(c) for c in keys] for keys in LEVELS.values()]
    middle = F.percentile("avg_rent_yen", F.lit(0.5), F.col("n")).cast("bigint").alias("benchmark_rent_yen_median")
    grouped = counts.where("avg_rent_yen IS NOT NULL").groupingSets(sets, *(F.col(c) for c in market.KEY)).agg(level, middle, F.sum("n").alias("n_rows"))
    return grouped.where("level <> 'structure' OR building_structure <> 'all'").select("level", *market.KEY, "benchmark_rent_yen_median", "n_rows")


def absorb(store: str, batch: DataFrame, number: int, same: tuple[str, ...] = SAME) -> None:
    """Write what a batch brings, and the index rows that it changes; doing it again changes nothing."""
    spark = batch.sparkSession
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in batch.schema.fields)
    known = _stored(spark, f"{store}/rows", kinds, "batch", before=number).select(*same)
    own = benchmark.usable(batch).dropDuplicates(list(same))
    own.join(known, _alike(own, known, same), "left_anti").write.mode("overwrite").parquet(f"{store}/rows/batch={number}")
    new = spark.read.schema(kinds).parquet(f"{store}/rows/batch={number}")
    new.groupBy(*market.KEY, "avg_rent_yen").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{store}/counts/batch={number}")
    counts = _stored(spark, f"{store}/counts", _COUNTS, "batch", before=number + 1).drop("batch")
    # all levels of a touched place change: its counts are read, no others
    touched = new.select("prefecture", "layout_type").distinct()
    index = levels(counts.join(touched, ["prefecture", "layout_type"], "left_semi"))
    changed = new.select(*market.PLACE).distinct()
    near = index.join(changed, _alike(index, changed, tuple(market.PLACE)), "left_semi")
    index.where("level = 'prefecture'").unionByName(near.where("level <> 'prefecture'")).write.mode("overwrite").parquet(f"{store}/index/version={number}")


def follow(rows: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Absorb a stream of market rows, all that has arrived, batch by batch."""
    return rows.writeStream.foreachBatch(lambda batch, number: absorb(store, batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_index(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """The index as of a version (the latest without): of each key the row that was written last."""
    rows = _stored(spark, f"{store}/index", _INDEX, "version", None if version is None else version + 1)
    last = Window.partitionBy("level", *market.KEY).orderBy(F.desc("version"))
    return rows.withColumn("__rank", F.row_number().over(last)).where("__rank = 1").drop("__rank", "version")


def versions(spark: SparkSession, store: str) -> DataFrame:
    """How many keys each version touched."""
    return _stored(spark, f"{store}/index", _INDEX, "version").groupBy("version").agg(F.count("*").alias("n_keys"))


def compact(spark: SparkSession, store: str, number: int) -> None:
    """Counts of all batches up to ``number`` as those of batch ``number`` alone; a batch up to there must not come again."""
    rows = _stored(spark, f"{store}/counts", _COUNTS, "batch", before=number + 1)
    summed = rows.groupBy(*market.KEY, "avg_rent_yen").agg(F.sum("n").alias("n"))
    summed.write.mode("overwrite").parquet(f"{store}/compacted")
    kept = spark.read.schema(_COUNTS).parquet(f"{store}/compacted")
    done = [r["batch"] for r in rows.select("batch").distinct().collect()]  # one number for each batch
    kept.write.mode("overwrite").parquet(f"{store}/counts/batch={number}")
    empty = kept.where(F.lit(False))
    for batch in done:
        if batch != number:
            empty.write.mode("overwrite").parquet(f"{store}/counts/batch={batch}")
