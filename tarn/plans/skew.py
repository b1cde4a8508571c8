"""Joins on keys of which a few have very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys whose facts are sent to all tasks, at most.
HEAVY_KEYS = 50_000


def split_join(rows: DataFrame, facts: DataFrame, key: str, size: str, most: int = HEAVY_KEYS) -> DataFrame:
    """rows JOIN facts on `key`; facts: one row a key, whose column `size` is the number of rows of that key, and which is
    read several times.

    Keys of more than total / most rows are `most` at most, however large the tables, so their facts go to all tasks and
    their rows stay where they are. Every other key has total / most rows at most, which are shuffled to its facts. Each
    key takes one of the two ways.
    """
    total = facts.agg(F.sum(size)).first()[0] or 0
    heavy = F.col(size) >= total // most + 1
    tagged = rows.join(F.broadcast(facts.where(heavy)), key, "left")
    kept = tagged.where(F.col(size).isNotNull())
    light = tagged.where(F.col(size).isNull()).select(*rows.columns).join(facts.where(~heavy), key)
    return kept.unionByName(light)
