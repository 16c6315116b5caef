"""Evidence to strengths to labels, per claim, as aggregations over independent clusters.

Null scores count as 0 in quality; items without excerpt are never eligible. A claim without
evidence gets strengths of 0. Uploaded material is shown but never counted; social, community,
entertainment and dictionary pages never decide.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestia.functions.urls import host, source_kind

FACTUAL = ("credible", "incorrect", "disputed", "evidence_insufficient")
LOW_KINDS = ("social", "community", "entertainment", "dictionary")
INSTITUTIONS = ("official", "academic", "science")


def presentation() -> Column:
    """How an item stands for its source: 'knowledge' items are body text, low kinds stand for themselves, a note on a snippet makes a snippet."""
    note = F.lower(F.coalesce(F.col("quality_reason"), F.lit("")))
    return (
        F.when(F.col("source_type") == "knowledge", "body").when(F.col("kind").isin(*LOW_KINDS), F.col("kind"))
        .when(note.contains("摘要") | note.contains("snippet"), "snippet").otherwise("body")
    )


def quoted(check: Column) -> Column:
    """Whether the passage of a check stands in its item's excerpt."""
    return F.coalesce((check["excerpt"] != "") & F.contains(F.col("excerpt"), check["excerpt"]), F.lit(False))


def with_quality(evidence: DataFrame) -> DataFrame:
    """Adds kind, form and quality in [0, 1]. A snippet's quality is capped by its source, less so where an institution's
    snippet has a quoted direct check."""
    raw = F.coalesce(F.col("authority"), F.lit(0.0)) * 0.5 + F.coalesce(F.col("relevance"), F.lit(0.0)) * 0.3 + F.coalesce(F.col("time_fit"), F.lit(0.0)) * 0.2
    direct = F.coalesce(F.exists("checks", lambda c: c["relation"].isin("supports", "refutes") & quoted(c)), F.lit(False))
    institution = F.col("kind").isin(*INSTITUTIONS)
    cap = F.when(institution & direct, 0.78).when(institution, 0.69).when(F.col("kind") == "news", 0.66).otherwise(0.56)
    out = evidence.withColumn("kind", source_kind(host(F.col("url")))).withColumn("form", presentation()).withColumn("quality", raw)
    return out.withColumn("quality", F.when(F.col("form") == "snippet", F.least("quality", cap)).when(F.col("form") == "social", F.least("quality", F.lit(0.45))).otherwise(F.col("quality")))


def eligible() -> Column:
    """May count towards a label, for its own relation."""
    least = F.when(F.col("form") == "body", 0.58).when(F.col("form") == "snippet", 0.55)
    ok = (F.col("source_type") == "web") & (F.coalesce(F.col("excerpt"), F.lit("")) != "") & (F.col("relevance") >= 0.75) & (F.col("time_fit") >= 0.5) & (F.col("quality") >= least)
    return F.coalesce(ok, F.lit(False))


def cluster_best(scored: DataFrame) -> DataFrame:
    """(claim_id, cluster_id, relation, best): copies of one source count once."""
    return scored.filter(eligible()).groupBy("claim_id", "cluster_id", "relation").agg(F.max("quality").alias("best"))


def combined(best: DataFrame, *by: str) -> DataFrame:
    """(by..., strength): v0 + .2 v1 + .1 v2 of the three best values, at most 1."""
    w = Window.partitionBy(*by).orderBy(F.col("best").desc(), F.col("cluster_id"))
    three = best.withColumn("_r", F.row_number().over(w)).filter("_r <= 3")
    v = lambda r: F.coalesce(F.max(F.when(F.col("_r") == r, F.col("best"))), F.lit(0.0))
    return three.groupBy(*by).agg(F.least(F.lit(1.0), v(1) + v(2) * 0.2 + v(3) * 0.1).alias("strength"))


def strengths(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_id, support, refute) of every claim."""
    by = combined(cluster_best(with_quality(evidence)), "claim_id", "relation")
    wide = by.groupBy("claim_id").agg(
        F.max(F.when(F.col("relation") == "supports", F.col("strength"))).alias("support"),
        F.max(F.when(F.col("relation") == "refutes", F.col("strength"))).alias("refute"),
    )
    return claims.select("claim_id").join(wide, "claim_id", "left").na.fill(0.0, ["support", "refute"])


def part_strengths(evidence: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """(claim_id, part_id, part_text, strength) of *parts* (claim_id, part_id, part_text): support by quoted checks of
    the same number and wording, or by whole-claim support; 0 for a part that nothing supports. Without *parts*, those
    that the checks name."""
    if parts is None:
        parts = evidence.select("claim_id", F.explode("checks").alias("c")).select("claim_id", "c.part_id", "c.part_text").distinct()
    scored = with_quality(evidence).filter(eligible())
    keys = ["claim_id", "part_id", "part_text"]
    whole = scored.filter(F.col("relation") == "supports").groupBy("claim_id", "cluster_id").agg(F.max("quality").alias("best"))
    checks = scored.select("claim_id", "cluster_id", "quality", F.explode(F.filter("checks", lambda c: (c["relation"] == "supports") & quoted(c))).alias("c"))
    checked = checks.groupBy("claim_id", "c.part_id", "c.part_text", "cluster_id").agg(F.max("quality").alias("best"))
    by_whole = parts.join(whole, "claim_id").select(*keys, "cluster_id", "best")
    by_check = parts.join(checked, keys).select(*keys, "cluster_id", "best")
    best = by_whole.unionByName(by_check).groupBy(*keys, "cluster_id").agg(F.max("best").alias("best"))
    return parts.join(combined(best, *keys), keys, "left").na.fill(0.0, ["strength"])


def label(support: Column, refute: Column) -> Column:
    return (
        F.when((support >= 0.75) & (refute < 0.5), "credible").when((refute >= 0.75) & (support < 0.5), "incorrect")
        .when((support >= 0.75) & (refute >= 0.75), "disputed").otherwise("evidence_insufficient")
    )


def evidence_signs(evidence: DataFrame) -> DataFrame:
    """Per claim, what its items offer: the signs a verdict's reason is chosen by."""
    e = with_quality(evidence)
    any_check = lambda r: F.coalesce(F.exists("checks", lambda c: c["relation"] == r), F.lit(False))
    is_ = lambda r: F.coalesce(F.col("relation") == r, F.lit(False))
    body = F.col("form") == "body"
    signs = {
        "text": F.coalesce(F.col("excerpt"), F.lit("")) != "", "body_support": body & (is_("supports") | any_check("supports")), "whole_support": is_("supports"),
        "body_refute": body & is_("refutes") & eligible(), "partial": is_("partially_supports"),
        "direct": is_("supports") | is_("refutes") | any_check("supports") | any_check("refutes"), "upload": F.coalesce(F.col("source_type") == "knowledge", F.lit(False)),
    }
    return e.groupBy("claim_id").agg(*[F.bool_or(x).alias(name) for name, x in signs.items()])


def reason() -> Column:
    """Why a label was given, as a code; the first that fits."""
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    s, f, is_ = F.col("support"), F.col("refute"), lambda x: F.col("label") == x
    return (
        F.when(is_("not_applicable"), "not_a_fact")
        .when(is_("credible"), F.when(~has("body_support"), "snippets_support").when(~has("whole_support"), "parts_supported").otherwise("supported"))
        .when(is_("incorrect"), F.when(~has("body_refute"), "snippets_refute").otherwise("refuted"))
        .when(is_("disputed"), "conflict").when(~has("text"), "no_text").when((s >= 0.5) & (f >= 0.5), "near_conflict")
        .when((s == 0) & (f == 0) & has("partial"), "partly_covered").when(~has("direct"), "no_match")
        .when((s == 0) & (f == 0) & has("upload"), "unverified_upload").when(F.greatest(s, f) < 0.75, "below_threshold").otherwise("insufficient")
    )


def verdicts(claims: DataFrame, evidence: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """(claim_id, support, refute, label, reason, support_score). Support is that of the whole claim or of its least
    supported part, whichever is more (the whole claim's without *parts*); opinions are not judged; the score is null
    unless the claim was adjudicated."""
    s = strengths(claims, evidence)
    if parts is not None:
        least = part_strengths(evidence, parts).groupBy("claim_id").agg(F.min("strength").alias("least"))
        s = s.join(least, "claim_id", "left").withColumn("support", F.greatest("support", F.coalesce("least", F.lit(0.0))))
    signs = [F.col(c) == x for c, x in (("claim_type", "opinion"), ("label", "not_applicable")) if c in claims.columns]
    opinion = F.coalesce(*signs, F.lit(False)) if len(signs) < 2 else F.coalesce(signs[0], F.lit(False)) | F.coalesce(signs[1], F.lit(False))
    s = s.join(claims.select("claim_id", opinion.alias("opinion")), "claim_id").withColumn("label", F.when(F.col("opinion"), "not_applicable").otherwise(label(F.col("support"), F.col("refute"))))
    s = s.join(evidence_signs(evidence), "claim_id", "left")
    score = F.when(F.col("label").isin("credible", "incorrect", "disputed"), F.bround(F.lit(50) + (F.col("support") - F.col("refute")) * 50).cast("int"))
    return s.select("claim_id", F.round("support", 6).alias("support"), F.round("refute", 6).alias("refute"), "label", reason().alias("reason"), score.alias("support_score"))


def coverage(claims: DataFrame, tasks: DataFrame) -> DataFrame:
    """Counts, ratios, label histogram and gated mean score of every task; one aggregation and one join.

    No score where less than four fifths were adjudicated, the answer was cut, a provider failed, the task did not
    end well or a claim was left unchecked.
    """
    factual = F.col("label").isin(*FACTUAL)
    verifiable = F.coalesce(factual, F.lit(False)) | (F.coalesce(F.col("claim_type"), F.lit("")) != "opinion")
    done, left = F.col("state") == "done", F.col("state").isin("unchecked", "failed")
    adjudicated = F.col("label").isin("credible", "incorrect", "disputed")
    agg = claims.groupBy("task_id").agg(
        F.count("*").alias("claims"), F.count_if(done).alias("claims_processed"), F.count_if(verifiable).alias("verifiable_claims"),
        F.count_if(verifiable & done).alias("processed_verifiable_claims"), F.count_if(verifiable & adjudicated).alias("adjudicated_verifiable_claims"),
        F.count_if(left).alias("left_claims"), *[F.count_if(F.col("label") == x).alias(f"n_{x}") for x in (*FACTUAL, "not_applicable")],
        F.avg(F.when(adjudicated, F.col("support_score"))).alias("mean_score"),
    )
    # Tables without a status or providers count as ended well.
    status = F.col("status") if "status" in tasks.columns else F.lit("succeeded")
    failed = F.col("failed_providers") if "failed_providers" in tasks.columns else F.array().cast("array<string>")
    out = tasks.select("task_id", status.alias("status"), "truncated", F.col("claims_unchecked").alias("beyond_limit"), failed.alias("failed_providers")).join(agg, "task_id", "left")
    out = out.na.fill(0, [c for c in agg.columns if c not in ("task_id", "mean_score")])
    ratio = lambda a: F.bround(F.try_divide(F.col(a), F.col("verifiable_claims")), 4)
    out = out.withColumn("processing_coverage", ratio("processed_verifiable_claims")).withColumn("verification_coverage", ratio("adjudicated_verifiable_claims"))
    failure = (F.coalesce(F.size("failed_providers"), F.lit(0)) > 0) | ~F.coalesce(F.col("status").isin("succeeded", "partial"), F.lit(False)) | (F.col("left_claims") > 0)
    gate = (F.col("verification_coverage") >= 0.8) & ~F.coalesce(F.col("truncated"), F.lit(False)) & ~failure
    beyond = F.coalesce("beyond_limit", F.lit(0))
    out = out.withColumn("technical_failure", failure).withColumn("score", F.when(gate, F.round("mean_score", 2)))
    out = out.withColumn("claims_extracted", F.col("claims") + beyond).withColumn("claims_unchecked", F.col("left_claims") + beyond)
    note = F.when(F.col("verification_coverage").isNull(), "nothing_verifiable").when(F.col("score").isNull(), "coverage_or_failure").otherwise("mean_of_adjudicated")
    return out.withColumn("score_note", note).drop("mean_score", "claims", "beyond_limit", "failed_providers", "status")
