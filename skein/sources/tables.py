"""Readers of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the folder; only Spark touches the path, so it may be in any store."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """The rows dealt to as many tasks as a shuffle has, by a key: a file's row group is one task, however much Python then does with its rows."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
