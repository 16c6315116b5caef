"""The document library beyond search: filters, chunks to index, the encoder's contract and the audit log.

An encoder is any function from a DataFrame (chunk_id, text) to (chunk_id, embedding), named by a model; it runs where
it likes, usually in mapInArrow. Without one, search is by keywords only.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Chunks embedded in one call, and the longest vector that is stored.
MOST_REINDEXED, LONGEST_VECTOR = 200, 4096
# Keys that the audit log keeps.
AUDIT_KEYS = ("event", "provider", "code", "status", "attempt", "elapsed_ms", "task_id", "claim_id")
# The most that a library holds by default.
MOST_DOCUMENTS, MOST_CHUNKS = 200, 5_000


def filtered(documents: DataFrame, tag: str | None = None, needle: str = "") -> DataFrame:
    """Documents with the tag whose title, publisher or tags contain *needle*, case aside. No tag and a blank needle keep all."""
    text = F.lower(F.concat_ws(" ", "title", "publisher", F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")))
    out = documents.filter(F.contains(text, F.lit(needle.strip().lower()))) if needle.strip() else documents
    return out.filter(F.coalesce(F.array_contains("tags", tag), F.lit(False))) if tag is not None else out


def unit_vector(vector: Column) -> Column:
    """The vector of length 1; null where it is empty, too long, not finite or all zero."""
    v = F.transform(vector, lambda e: e.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, e: a + e * e))
    ok = F.size(v).between(1, LONGEST_VECTOR) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & (norm > 0) & (norm < float("inf"))
    return F.when(ok, F.transform(v, lambda e: e / norm))


def reindexed(chunks: DataFrame, encode: Callable[[DataFrame], DataFrame], model: str, most: int = MOST_REINDEXED) -> tuple[DataFrame, DataFrame]:
    """(chunks after embedding at most *most* of those without a vector of *model*, one row with how many remain).

    *chunks*: chunk_id, text, embedding, embedding_model, ... A vector that cannot be normalised is left out and counts as remaining.
    """
    stale = F.col("embedding").isNull() | ~F.coalesce(F.col("embedding_model") == model, F.lit(False))
    todo = chunks.filter(stale).select("chunk_id", "text").orderBy("chunk_id").limit(most)
    made = encode(todo).select("chunk_id", unit_vector(F.col("embedding")).cast("array<float>").alias("_v")).filter("_v IS NOT NULL")
    out = chunks.join(made, "chunk_id", "left").withColumn("embedding", F.coalesce("_v", F.when(~stale, F.col("embedding")))).withColumn("embedding_model", F.when(F.col("_v").isNotNull(), F.lit(model)).otherwise(F.col("embedding_model"))).drop("_v")
    return out.select(chunks.columns), out.agg(F.count_if(stale).alias("remaining"))


def capacity_errors(documents: DataFrame, chunks: DataFrame, new: DataFrame, most_documents: int = MOST_DOCUMENTS, most_chunks: int = MOST_CHUNKS) -> DataFrame:
    """(error): codes that stand against importing *new* (document_id, chunk_count); no row where it fits."""
    have = documents.agg(F.count("*").alias("d")).join(F.broadcast(chunks.agg(F.count("*").alias("c")))).join(F.broadcast(new.agg(F.count("*").alias("nd"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("nc"))))
    codes = F.array(F.when(F.col("d") + F.col("nd") > most_documents, "DOCUMENT_LIMIT"), F.when(F.col("c") + F.col("nc") > most_chunks, "CHUNK_LIMIT"))
    return have.select(F.explode(F.filter(codes, lambda x: x.isNotNull())).alias("error"))


def audit_rows(records: DataFrame, column: str = "record") -> DataFrame:
    """Log rows with the kept keys only, of a map or JSON column; anything else, texts and keys above all, is dropped."""
    src = F.col(column) if dict(records.dtypes)[column].startswith("map") else F.from_json(column, "map<string,string>")
    return records.select(*[F.try_element_at(src, F.lit(k)).cast("string").alias(k) for k in AUDIT_KEYS])


def exports(spark, path: str) -> DataFrame:
    """Rows of the JSON exports under *path*: reports with claims, one row a claim, or arrays of predictions; a folder must hold one kind."""
    raw = spark.read.option("multiLine", True).json(path)
    if "claims" in raw.columns and "case_id" in raw.columns:
        raise ValueError("reports and predictions are mixed")
    return raw.select(F.explode("claims").alias("c")).select("c.*") if "claims" in raw.columns else raw
