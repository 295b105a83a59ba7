"""Work that is written out on the way: checkpoints and tables in the folder that the session names."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from ..scratch import cut, ensure_checkpoint_dir, shuffled

__all__ = ["cut", "ensure_checkpoint_dir", "new_folder", "remove", "shuffled"]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    ensure_checkpoint_dir(spark)
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ``new_folder`` and what is in it, in whatever store it lies."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
