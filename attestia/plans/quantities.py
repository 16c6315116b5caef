"""Query of problem 7: quantities in common units."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestia.operators.quantities import in_common_units
from attestia.session import table


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    claims = table(spark, d, "claims").select(F.lit("claim").alias("record_kind"), F.col("claim_id").alias("record_key"), F.col("normalized_claim").alias("text"))
    evidence = table(spark, d, "evidence_items").select(F.lit("evidence").alias("record_kind"), F.col("evidence_id").alias("record_key"), F.col("excerpt").alias("text"))
    return in_common_units(claims.unionByName(evidence), table(spark, d, "unit_targets"))


def quantities_covered(spark: SparkSession, d: str) -> DataFrame:
    """Evidence that states every amount of its claim, in whatever unit, by dimension."""
    found = p7_found(spark, d)
    wanted = found.filter("record_kind = 'claim'").groupBy(F.col("record_key").alias("claim_id"), "dimension").agg(F.collect_set("base_value").alias("wanted"))
    seen = found.filter("record_kind = 'evidence'").groupBy(F.col("record_key").alias("evidence_id"), "dimension").agg(F.collect_set("base_value").alias("seen"))
    pairs = table(spark, d, "evidence_items").select("evidence_id", "claim_id").distinct().join(wanted, "claim_id").join(seen, ["evidence_id", "dimension"])
    return pairs.select("claim_id", "evidence_id", "dimension", (F.size(F.array_except("wanted", "seen")) == 0).alias("covered"), F.arrays_overlap("wanted", "seen").alias("overlaps"))


QUERIES = {"p7_found": p7_found, "quantities_covered": quantities_covered}
SQL: dict[str, str] = {}
