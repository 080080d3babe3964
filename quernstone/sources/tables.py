"""Parquet tables of a data folder."""

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``; columns are pruned and filters pushed by Catalyst."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
