"""Numbering rows without putting them in one order first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.plans.storage import stored

PARTS = 4096


def numbered(keys: DataFrame, column: str, name: str = "number") -> DataFrame:
    """keys with a dense number from 0 for each row; `column` must be distinct. Rows are numbered within PARTS hash parts,
    and running sums of the parts' sizes, PARTS rows at most, give each part's first number."""
    rows = keys.withColumn("__part", F.pmod(F.xxhash64(column), F.lit(PARTS)))
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(column)) - 1
    return rows.withColumn("__at", inside).join(starts, "__part").withColumn(name, (F.col("__start") + F.col("__at")).cast("long")).drop("__part", "__at", "__start")


def running_sums(rows: DataFrame, *order: str, amount: str, total: str) -> DataFrame:
    """rows with `total`, the sum of `amount` up to and with each row by `order`, which must be distinct. Rows are
    range-partitioned; running sums of the partitions' own, as many as there are shuffle partitions, are added to theirs."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = stored(rows.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "in-order")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = kept.groupBy("__part").agg(F.sum(amount).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.sum(amount).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return kept.withColumn("__at", inside).join(F.broadcast(starts), "__part").withColumn(total, (F.col("__start") + F.col("__at")).cast("long")).drop("__part", "__at", "__start")


def numbered_in_order(rows: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """rows with a dense number from 0 by `order`, which must be distinct."""
    return running_sums(rows.withColumn("__one", F.lit(1)), *order, amount="__one", total=name).withColumn(name, F.col(name) - 1).drop("__one")
