"""Predictions against gold labels: joins with their checks, metrics, and a report.

Cases: case_id, input_text, target_claim, source ('synthetic', 'human' or 'curated_public_fact_seed'), elapsed_ms,
functional_checks map<string,boolean>. Key faults are rows, not exceptions: *faults* lists them all.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .judging import FACTUAL

LABELS = (*FACTUAL, "not_applicable")


def faults(cases: DataFrame, given: DataFrame, column: str, labels: tuple[str, ...] | None = None) -> DataFrame:
    """(case_id, fault) of a table of *given* (case_id, *column*) against the cases: blank, repeated, unknown and missing ids, labels that don't exist."""
    n = given.groupBy("case_id").agg(F.count("*").alias("n"), F.collect_set(column).alias("values"))
    blank = F.coalesce(F.trim("case_id"), F.lit("")) == ""
    both = cases.select("case_id").distinct().withColumn("known", F.lit(True)).join(n, "case_id", "full_outer")
    bad = F.lit(False) if labels is None else F.exists("values", lambda v: ~v.isin(*labels)) | (F.size("values") == 0)
    checks = {"blank": blank, "repeated": ~blank & (F.col("n") > 1), "unknown": ~blank & F.col("known").isNull(), "missing": F.col("n").isNull(), "label": F.col("n").isNotNull() & F.coalesce(bad, F.lit(True))}
    return both.select("case_id", F.explode(F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in checks.items()]), lambda x: x.isNotNull())).alias("fault"))


def with_gold(cases: DataFrame, gold: DataFrame) -> DataFrame:
    """Cases with the gold label of exactly their id as *expected*; check *faults* first, repeated golds repeat the case."""
    return cases.join(gold.select("case_id", F.col("label").alias("expected")), "case_id")


def mapped(cases: DataFrame, claims: DataFrame) -> DataFrame:
    """(claim_id, case_id, label, matches) of exported claims: by their case_id, else by the one case whose target or
    input is the claim's normalized or source text. More than one match is ambiguous (case_id null), none drops the claim."""
    by_id = claims.filter("case_id IS NOT NULL").select("claim_id", "case_id", "label", F.lit(1).cast("bigint").alias("matches"))
    texts = cases.select("case_id", F.explode(F.array_distinct(F.array(F.coalesce("target_claim", "input_text"), "input_text"))).alias("text")).filter("text IS NOT NULL")
    said = claims.filter("case_id IS NULL").select("claim_id", "label", F.explode(F.array_distinct(F.array("normalized_claim", "source_text"))).alias("text")).filter("text IS NOT NULL")
    hits = said.join(texts, "text").groupBy("claim_id", "label").agg(F.countDistinct("case_id").alias("matches"), F.min("case_id").alias("one"))
    return by_id.unionByName(hits.select("claim_id", F.when(F.col("matches") == 1, F.col("one")).alias("case_id"), "label", "matches"))


def canonical(label: Column) -> Column:
    return F.when(label.isin(*LABELS), label).otherwise("unknown")


def _tallied(rows: DataFrame) -> DataFrame:
    """Rows with a factual gold label, with the prediction in its column of the matrix."""
    return rows.filter(F.col("expected").isin(*FACTUAL)).withColumn("column", F.when(F.col("predicted").isin(*FACTUAL), F.col("predicted")).otherwise("unknown"))


def confusion(rows: DataFrame) -> DataFrame:
    """(expected, the four labels, unknown), every row and column present."""
    every = rows.sparkSession.createDataFrame([(x,) for x in FACTUAL], "expected string")
    counts = _tallied(rows).groupBy("expected").agg(*[F.count_if(F.col("column") == c).alias(c) for c in (*FACTUAL, "unknown")])
    return every.join(F.broadcast(counts), "expected", "left").na.fill(0)


def classification(rows: DataFrame) -> DataFrame:
    """One row: denominator, correct, accuracy, abstentions, rate, invalid outputs, insufficient judged incorrect."""
    wrong = F.col("predicted").isNotNull() & ~F.col("predicted").isin(*LABELS)
    n, right, none = F.count("*"), F.count_if(F.col("column") == F.col("expected")), F.count_if(F.col("column").isin("evidence_insufficient", "unknown"))
    return _tallied(rows).agg(
        n.alias("denominator"), right.alias("correct"), F.try_divide(right, n).alias("accuracy"), none.alias("abstentions"), F.try_divide(none, n).alias("abstention_rate"),
        F.count_if(wrong).alias("invalid_outputs"), F.count_if((F.col("expected") == "evidence_insufficient") & (F.col("predicted") == "incorrect")).alias("insufficient_as_incorrect"))


def functional(rows: DataFrame) -> DataFrame:
    """(check, passed, failed) over the rows that have checks."""
    each = rows.select(F.explode("functional_checks").alias("check", "ok"))
    return each.groupBy("check").agg(F.count_if("ok").alias("passed"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("failed"))


def quality(rows: DataFrame) -> DataFrame:
    """One row: samples by source and the accuracy on those that people labelled."""
    source, factual = F.coalesce("source", F.lit("synthetic")), F.col("expected").isin(*FACTUAL)
    human = F.coalesce((source == "human") & factual, F.lit(False))
    n, right = F.count_if(human), F.count_if(human & (canonical(F.col("predicted")) == F.col("expected")))
    return rows.agg(F.count_if(source == "human").alias("human"), F.count_if(source == "curated_public_fact_seed").alias("public_seed"), F.count_if(source == "synthetic").alias("synthetic"), n.alias("human_denominator"), right.alias("human_correct"), F.try_divide(right, n).alias("human_accuracy"))


def timing(rows: DataFrame) -> DataFrame:
    """One row: samples with a time, total and mean in ms to three places; null without any."""
    return rows.agg(F.count("elapsed_ms").alias("samples"), F.round(F.sum("elapsed_ms"), 3).alias("total_ms"), F.round(F.avg("elapsed_ms"), 3).alias("mean_ms"))


def percent(share: Column) -> Column:
    """One decimal; a sign where there is nothing to divide by."""
    return F.coalesce(F.format_string("%.1f%%", share * 100), F.lit("-"))


def annotation_errors(rows: DataFrame) -> DataFrame:
    """*rows* (source, label, annotation struct<checked_at,label_basis,annotator,reviewer>) with errors: what a gold label lacks to count."""
    source = F.coalesce("source", F.lit("synthetic"))
    blank = lambda c: F.coalesce(F.trim(F.col(f"annotation.{c}")), F.lit("")) == ""
    real = source != "synthetic"
    checks = {"source": ~source.isin("synthetic", "human", "curated_public_fact_seed"), "label": real & ~F.coalesce(F.col("label").isin(*LABELS), F.lit(False))}
    checks |= {c: real & blank(c) for c in ("checked_at", "label_basis")} | {c: (source == "human") & blank(c) for c in ("annotator", "reviewer")}
    return rows.withColumn("errors", F.filter(F.array(*[F.when(c, name) for name, c in checks.items()]), lambda x: x.isNotNull()))


def report(rows: DataFrame) -> DataFrame:
    """(json, markdown): the metrics as one document each."""
    matrix = confusion(rows).agg(F.array_sort(F.collect_list(F.struct("expected", *FACTUAL, "unknown"))).alias("matrix"))
    checks = functional(rows).agg(F.array_sort(F.collect_list(F.struct("check", "passed", "failed"))).alias("checks"))
    parts = [classification(rows).select(F.struct("*").alias("classification")), quality(rows).select(F.struct("*").alias("quality")), timing(rows).select(F.struct("*").alias("timing")), matrix, checks]
    one = parts[0]
    for p in parts[1:]:  # one row each
        one = one.join(F.broadcast(p))
    c = lambda f: F.col(f"classification.{f}")
    lines = F.transform("matrix", lambda r: F.concat(F.lit("| "), r["expected"], *[F.concat(F.lit(" | "), r[x].cast("string")) for x in (*FACTUAL, "unknown")], F.lit(" |")))
    text = F.concat_ws(
        "\n", F.lit("# Evaluation"), F.format_string("- agreement: %d/%d (%s)", c("correct"), c("denominator"), percent(c("accuracy"))), F.format_string("- abstentions: %d (%s)", c("abstentions"), percent(c("abstention_rate"))),
        F.format_string("- insufficient judged incorrect: %d", c("insufficient_as_incorrect")), F.lit(""), F.lit("| gold | " + " | ".join((*FACTUAL, "unknown")) + " |"), F.lit("|-" * 6 + "|"), F.array_join(lines, "\n"), F.lit(""),
        F.array_join(F.transform("checks", lambda x: F.format_string("- %s: %d passed, %d failed", x["check"], x["passed"], x["failed"])), "\n"),
        F.concat(F.lit("- mean ms: "), F.coalesce(F.col("timing.mean_ms").cast("string"), F.lit("-"))))
    return one.select(F.to_json(F.struct(*one.columns)).alias("json"), text.alias("markdown"))
