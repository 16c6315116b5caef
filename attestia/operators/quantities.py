"""Amounts in text, converted to the common unit of their dimension."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestia.functions.units import conversions, make_finder


def _find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    amounts = make_finder()
    for part in parts:
        kinds, keys, units, values = [], [], [], []
        for kind, key, text in zip(*(c.to_pylist() for c in part.columns)):
            for unit, v in amounts(text):
                kinds.append(kind)
                keys.append(key)
                units.append(unit)
                values.append(float(v))
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(keys, pa.string()), pa.array(units, pa.string()), pa.array(values, pa.float64())], names=["record_kind", "record_key", "unit", "amount"])


def stated_amounts(records: DataFrame) -> DataFrame:
    """(record_kind, record_key, unit, amount) of a table (record_kind, record_key, text).

    Null and empty texts state nothing; whole texts are read; a range gives both ends and a compound
    amount ("9 ft 5 in") one value.
    """
    return records.select("record_kind", "record_key", "text").filter(F.col("text") != "").mapInArrow(_find, "record_kind string, record_key string, unit string, amount double")


def conversion_table(spark: SparkSession, targets: DataFrame) -> DataFrame:
    """(unit, dimension, factor, offset): one row a unit that reaches a common unit of *targets*; raises where cycles disagree."""
    wanted = {r["dimension"]: r["common_unit"] for r in targets.select("dimension", "common_unit").distinct().collect() if r["dimension"] and r["common_unit"]}
    rows = [(u, d, float(f), float(o)) for u, (d, f, o) in conversions(wanted).items()]
    return spark.createDataFrame(rows, "unit string, dimension string, factor double, offset double")


def in_common_units(records: DataFrame, targets: DataFrame) -> DataFrame:
    """(record_kind, record_key, dimension, base_value): each distinct amount, rounded to the nearest integer (halves up).

    The conversion table has one row a known unit (under 100), so it is broadcast.
    """
    table = conversion_table(records.sparkSession, targets)
    met = stated_amounts(records).join(F.broadcast(table), "unit")
    exact = F.round(F.col("amount") * F.col("factor") + F.col("offset"), 6)
    return met.select("record_kind", "record_key", "dimension", F.floor(exact + 0.5).cast("bigint").alias("base_value")).distinct()
