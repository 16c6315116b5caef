"""Queries that read answers and evidence; they need Python, so they have no SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from attestia.functions.text import terms
from attestia.operators import extraction as X
from attestia.session import table

from .judging import _claims, _evidence, _tasks


def claim_extraction(spark, d):
    """Atomic claims of every task within its own limit."""
    return X.extracted(_tasks(spark, d), "task_id", "input_text", "claim_limit")


def extraction_summary(spark, d):
    """Claims found and kept of each task, its opinions and unresolved references, and whether some were left out."""
    return claim_extraction(spark, d).groupBy("task_id").agg(
        F.max("found").alias("found"), F.count("*").alias("kept"), F.count_if(F.col("claim_type") == "opinion").alias("opinions"),
        F.count_if(F.col("state") == "unchecked").alias("unresolved"), (F.max("found") > F.count("*")).alias("truncated"))


def atomic_parts(spark, d):
    """The facts of each claim that must be shown, atomic claims told apart."""
    return X.parts_of_claims(_claims(spark, d))


def grounded_checks(spark, d):
    """Quotes of the checks recovered as exact slices of their excerpt."""
    e = _evidence(spark, d).select("evidence_id", "excerpt", F.posexplode("checks").alias("n", "c"))
    return e.select("evidence_id", "n", X.ground_quote(F.col("c.excerpt"), F.col("excerpt")).alias("quote"))


def evidence_passages(spark, d):
    """The passage of each search result that holds most terms of its claim."""
    c = _claims(spark, d).select("claim_id", terms(F.col("normalized_claim")).alias("t"))
    r = table(spark, d, "search_results").select("result_id", "claim_id", "content").distinct().join(c, "claim_id", "left")
    return r.select("result_id", X.best_passage(F.col("content"), F.col("t")).alias("passage"))


QUERIES = {f.__name__: f for f in (claim_extraction, extraction_summary, atomic_parts, grounded_checks, evidence_passages)}
SQL: dict[str, str] = {}
