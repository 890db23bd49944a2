"""Readers for the Parquet tables the engine works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; filters and column choices reach the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
