"""Readers of the engine's input tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of `folder`; only the columns used later are read."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
