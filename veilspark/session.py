"""Making the package known to Python workers."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def attach(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver did.

    Enough where workers see the driver's files (local mode, a shared file
    system). Elsewhere the package is installed on the workers or sent with
    spark.submit.pyFiles, and this changes nothing.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *have])
    return spark
