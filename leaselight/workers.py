"""Python workers must be able to import this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def reach(spark: SparkSession) -> None:
    """Put the folder that holds the package on the import path of workers on machines that have it.

    A cluster whose machines lack it gets the package by ``--py-files``, as any other.
    """
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
