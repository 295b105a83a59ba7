"""Cutting lineage safely: checkpoints go to the folder that the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Leave the session's own ``spark.checkpoint.dir`` alone; set one only where none is set.

    The fallback is a local folder and therefore only for sessions of a single machine,
    such as tests; on a cluster a shared folder must be named in the configuration.
    """
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() is not None:
        return
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("name a folder that all machines share in spark.checkpoint.dir")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="leaselight-checkpoint-"))


def cut(df: DataFrame, release: bool = False) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return it with a short lineage.

    What was written is read by every later use, so an expensive step runs once, and a
    lost executor costs no recomputation.
    The folder holds Parquet: columns of a few values take little there, rows of a plain
    checkpoint many times as much.  With ``release`` the shuffles that led there leave the
    disks: Spark removes them once the driver has collected what refers to them, and a
    driver with a free heap would not collect it before the session ends.
    """
    path = new_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    if release:
        df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df``, with which joins shuffle both sides.

    Spark takes a table for as small as its files, less the columns that are not read.  Rows
    that lie packed in Parquet grow tens of times as large once they are broadcast through the
    driver, so what grows with the input says that it is none to broadcast.
    """
    return df.hint("merge")


#: Rows that are sent to every task; more are shuffled.
BROADCAST_ROWS = 100_000


def few(df: DataFrame) -> DataFrame:
    """``df``, written out, to be sent to every task while it has up to ``BROADCAST_ROWS`` rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else shuffled(df)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    ensure_checkpoint_dir(spark)
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
