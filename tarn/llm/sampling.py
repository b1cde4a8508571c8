"""Bounded samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bounded_sample(rows: DataFrame, stratum: str, key: str, limit: int, seed: int = 17) -> tuple[DataFrame, dict]:
    """At most `limit` rows of each value of `stratum`, those with the smallest hash of `key`; and the values' counts.

    A first pass counts; a hash threshold then leaves about 4 * limit rows a stratum before rows are ranked, so that no
    stratum is ever ranked whole. Strata (languages, classes) must be few. Nulls in stratum or key are left out.
    """
    rows = rows.where(F.col(stratum).isNotNull() & F.col(key).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(stratum).count().collect()}
    chance = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30))
    keep = F.lit(False)
    for value, n in counts.items():
        keep = keep | ((F.col(stratum) == F.lit(value)) & (chance < int(min(1.0, (4 * limit + 64) / n) * (1 << 30))))
    ranked = rows.where(keep).withColumn("__rank", F.row_number().over(Window.partitionBy(stratum).orderBy(chance, key)))
    return ranked.where(F.col("__rank") <= limit).drop("__rank"), counts
