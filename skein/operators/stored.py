"""Tables that are changed in place: partitioned by a hash of the key, so that a change rewrites the partitions of its keys and no others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PART, PARTS = "part", 64


def part_of(keys: list[str], parts: int) -> Column:
    """The partition of a key; equal keys, nulls too, share one."""
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def create(rows: DataFrame, path: str, keys: list[str], parts: int = PARTS) -> None:
    """Write a new table, a file a partition."""
    placed = rows.withColumn(PART, part_of(keys, parts))
    placed.repartition(parts, PART).write.partitionBy(PART).parquet(path)


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of a table. ``schema`` is that of its rows, without the partition."""
    columns = spark.createDataFrame([], schema).columns
    return spark.read.schema(_with_part(spark, schema)).parquet(path).select(columns)


def _with_part(spark: SparkSession, schema):
    return spark.createDataFrame([], schema).withColumn(PART, F.lit(0)).schema


def change(spark: SparkSession, path: str, schema, keys: list[str], touched: DataFrame, step: Callable[[DataFrame], DataFrame], scratch: str, parts: int = PARTS) -> list[int]:
    """Put ``step`` of the touched partitions' rows in their place, and give the numbers of these partitions.

    ``touched`` has the keys that a change may alter; ``step`` takes all rows of their partitions and gives the rows that are to be
    there, such as one of ``merges``. It must leave rows with other keys as they are. The result is
    written below ``scratch`` first, so a change that fails before the last step leaves the table as it was; partitions without rows go.
    Two changes of one partition at a time are not told apart: one writer a table.
    """
    numbers = sorted(r[0] for r in touched.select(part_of(keys, parts).alias("p")).distinct().collect())
    if not numbers:
        return []
    columns = spark.createDataFrame([], schema).columns
    whole = spark.read.schema(_with_part(spark, schema)).parquet(path)
    after = step(whole.where(F.col(PART).isin(numbers)).select(columns)).select(columns).withColumn(PART, part_of(keys, parts))
    after.repartition(len(numbers), PART).write.mode("overwrite").partitionBy(PART).parquet(scratch)
    ready = spark.read.schema(whole.schema).parquet(scratch)
    left = {r[0] for r in ready.select(PART).distinct().collect()}
    if left - set(numbers):
        raise ValueError("a change gave rows of partitions that none of its keys is in")
    ready.repartition(len(numbers), PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    for p in set(numbers) - left:
        at = fs_path(f"{path}/{PART}={p}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return numbers
