"""Named tables from files or the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def parquet_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def catalog_tables(spark: SparkSession, names: list[str]) -> dict[str, DataFrame]:
    return {n.rpartition(".")[2]: spark.table(n) for n in names}
