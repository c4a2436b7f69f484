"""Parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``; columns and filters are pushed into the scan by Catalyst."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_values(df: DataFrame, column: str, bound: int) -> list:
    """The distinct values of a fixed reference table, for a literal set or a broadcast.

    Raises ValueError if there are more than ``bound``, so that nothing that grows with the data reaches the driver.
    """
    found = [row[0] for row in df.select(column).where(f"`{column}` is not null").distinct().limit(bound + 1).collect()]
    if len(found) > bound:
        raise ValueError(f"{column} has more than {bound} values; it isn't a small reference table")
    return sorted(found)
