"""Reports and stores written from DataFrames."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestia.functions.text import markdown_escaped
from attestia.functions.urls import normal_url
from attestia.operators.versions import upsert, without_known

DISCLAIMER = "Labels are computed from the evidence shown and may be wrong."


def json_reports(tasks: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(task_id, report): one JSON document a task; URLs that are not valid become null. A task without claims has an empty list."""
    items = evidence.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("cluster_id", "evidence_id", normal_url(F.col("url")).alias("url"), "title", "relation", "excerpt"))).alias("evidence"))
    full = claims.join(items, "claim_id", "left").groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("char_start", "claim_id", "normalized_claim", "label", "support_score", "evidence"))).alias("claims"))
    both = tasks.join(full, "task_id", "left")
    return both.select("task_id", F.to_json(F.struct("task_id", "status", F.coalesce("claims", F.array().cast(full.schema["claims"].dataType)).alias("claims"), F.lit(DISCLAIMER).alias("note")), {"ignoreNullFields": "false"}).alias("report"))


def markdown_reports(tasks: DataFrame, claims: DataFrame) -> DataFrame:
    """(task_id, report): one Markdown document a task, a section for each claim in reading order, all text escaped."""
    section = F.concat(F.lit("## "), markdown_escaped(F.col("normalized_claim")), F.lit("\n\nLabel: "), F.coalesce("label", F.lit("not checked")), F.coalesce(F.concat(F.lit(" ("), F.col("support_score"), F.lit(")")), F.lit("")))
    parts = claims.select("task_id", F.struct("char_start", "claim_id", section.alias("s")).alias("x")).groupBy("task_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), "\n\n").alias("body"))
    return tasks.join(parts, "task_id", "left").select("task_id", F.concat(F.lit("# Report "), F.col("task_id"), F.lit("\n\n"), F.coalesce("body", F.lit("No claims.")), F.lit(f"\n\n_{DISCLAIMER}_\n")).alias("report"))


def import_documents(known: DataFrame, new: DataFrame) -> DataFrame:
    """Documents of *new* (document_id, pages, ...) whose body no stored document has; equal new bodies are kept once."""
    hashed = new.withColumn("content_hash", F.sha2(F.to_json("pages"), 256))
    first = hashed.groupBy("content_hash").agg(F.min("document_id").alias("document_id"))
    return without_known(hashed.join(first, ["content_hash", "document_id"], "left_semi"), known, "content_hash")


def delete_documents(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the documents in *ids* (document_id)."""
    return {name: without_known(df, ids, "document_id") for name, df in tables.items()}


__all__ = ["json_reports", "markdown_reports", "import_documents", "delete_documents", "upsert"]
