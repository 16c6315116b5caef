"""Repeated and versioned rows."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str | list[str], *order: str) -> DataFrame:
    """One row a key: the greatest by *order* (nulls least), exact copies in any order. Null keys are one key."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of *new* replace those of *old* with the same key; the rest of *old* stays."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def without_known(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Rows of *new* whose key *old* lacks: duplicate rejection and cascading deletes."""
    return new.join(old.select(key).distinct(), key, "left_anti")
