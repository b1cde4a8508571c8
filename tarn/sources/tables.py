"""Reading tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def dealt(rows: DataFrame) -> DataFrame:
    """rows over as many partitions as there are cores, if they come in fewer: a small file can hold all its rows in one
    row group, which is one task's work. Larger inputs come in more splits than that and are left as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
