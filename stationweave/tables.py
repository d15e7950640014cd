"""Access to the tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Table `name` of a folder of parquet tables; only `columns` when given."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df
