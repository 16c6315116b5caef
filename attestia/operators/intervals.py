"""Overlaps, containment and segments of half-open intervals within a group."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlapping(df: DataFrame, group: str, key: str, start: str, end: str, bucket: int = 512) -> DataFrame:
    """(group, key_a, key_b), key_a < key_b, of intervals that share a point.

    Intervals meet in buckets of *bucket* units, so a group's rows are compared only within a bucket;
    a pair is reported in the bucket where the later one starts. Empty and null intervals overlap nothing.
    """
    rows = df.filter(F.col(end) > F.col(start)).select(group, F.col(key).alias("k"), F.col(start).alias("s"), F.col(end).alias("e"))
    placed = rows.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("s") / bucket), F.floor((F.col("e") - 1) / bucket))))
    a = placed.select(group, "bucket", F.col("k").alias(f"{key}_a"), F.col("s").alias("sa"), F.col("e").alias("ea"))
    b = placed.select(group, "bucket", F.col("k").alias(f"{key}_b"), F.col("s").alias("sb"), F.col("e").alias("eb"))
    met = a.join(b, [group, "bucket"]).filter((F.col(f"{key}_a") < F.col(f"{key}_b")) & (F.col("sa") < F.col("eb")) & (F.col("sb") < F.col("ea")))
    return met.filter(F.col("bucket") == F.floor(F.greatest("sa", "sb") / bucket)).select(group, f"{key}_a", f"{key}_b")


def containing(points: DataFrame, spans: DataFrame, group: str, at: str, start: str, end: str) -> DataFrame:
    """Each point with the last span starting at or before it, if that span still holds it (as-of join, one sort, no range join)."""
    p = points.withColumn("_at", F.col(at)).withColumn("_kind", F.lit(1)).withColumn("_span", F.lit(None).cast(f"struct<{start}:bigint,{end}:bigint>"))
    empty = [F.lit(None).cast(t).alias(c) for c, t in points.dtypes if c != group]
    s = spans.select(F.col(group), *empty, F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.struct(F.col(start).cast("bigint").alias(start), F.col(end).cast("bigint").alias(end)).alias("_span"))
    w = Window.partitionBy(group).orderBy("_at", "_kind", F.col(f"_span.{end}")).rowsBetween(Window.unboundedPreceding, 0)
    both = p.unionByName(s.select(p.columns)).withColumn("_last", F.last("_span", ignorenulls=True).over(w)).filter("_kind = 1")
    held = F.col("_at") < F.col(f"_last.{end}")
    return both.select(*points.columns, F.when(held, F.col(f"_last.{start}")).alias("span_start"), F.when(held, F.col(f"_last.{end}")).alias("span_end"))


def segments(df: DataFrame, group: str, start: str, end: str, length: str) -> DataFrame:
    """(group, seg_start, seg_end, covers): 0 .. length cut at every interval end, with the number of intervals over each piece."""
    ok = df.filter((F.col(start) >= 0) & (F.col(end) > F.col(start)) & (F.col(end) <= F.col(length)))
    steps = ok.select(group, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("x")).select(group, "x.at", "x.d")
    ends = df.select(group, F.explode(F.array(F.lit(0).cast("int"), F.col(length))).alias("at"), F.lit(0).alias("d"))
    marks = steps.unionByName(ends).groupBy(group, "at").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(group).orderBy("at")
    return marks.select(group, F.col("at").alias("seg_start"), F.lead("at").over(w).alias("seg_end"), F.sum("d").over(w).alias("covers")).filter("seg_end IS NOT NULL AND seg_end > seg_start")
