"""Queries from claim to admitted, merged and decided evidence; they read text in Python, so most have no SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from attestia.operators import admission, decisions, extraction, merging
from attestia.session import table

from .judging import EV, _claims, _evidence


def retrieval_queries(spark, d):
    """The queries of every claim."""
    return admission.planned(_claims(spark, d))


def admitted_evidence(spark, d):
    """Usable passages of the search results of every claim."""
    return admission.admitted(table(spark, d, "search_results"), _claims(spark, d)).drop("excerpt")


def ranked_evidence(spark, d):
    """The five items of each claim with their clusters."""
    found = admission.ranked(admission.admitted(table(spark, d, "search_results"), _claims(spark, d)))
    return found.select("claim_id", "place", "cluster_id", "url", "content_hash", "score")


def merged_evidence(spark, d):
    """Stored web and uploaded items of each claim in one list of five."""
    e = _evidence(spark, d).withColumn("ord", F.coalesce(F.unix_micros(F.col("retrieved_at").cast("timestamp")), F.lit(0)))
    return merging.merged(e.select("claim_id", "evidence_id", "cluster_id", "ord", "source_type", "url", "excerpt", "content_hash", "authority"), extraction.parts_of_claims(_claims(spark, d)))


def evidence_groups(spark, d):
    """The group of every stored item, uploads attached to the web group with their text."""
    e = _evidence(spark, d).withColumn("ord", F.coalesce(F.unix_micros(F.col("retrieved_at").cast("timestamp")), F.lit(0)))
    return merging.grouped(e.select("claim_id", "evidence_id", "cluster_id", "ord", "source_type", "url", "excerpt", "content_hash")).select("claim_id", "evidence_id", "group_no", "position")


def applied_decisions(spark, d):
    """The stored checks of each item taken as a judge's decisions and put to the vetoes."""
    e = _evidence(spark, d)
    match = F.struct(F.lit("match").alias("entity"), F.lit("match").alias("predicate"), F.lit("match").alias("scope"), F.when(F.col("relation") == "refutes", "conflict").otherwise("match").alias("value"))
    given = e.select("claim_id", "evidence_id", "relation", F.get("checks", F.lit(0))["excerpt"].alias("excerpt"), F.lit(None).cast(decisions.DECISIONS.split("checks ")[1].rsplit(", alignment", 1)[0]).alias("checks"), match.alias("alignment"))
    out = decisions.apply_decisions(e, given, _claims(spark, d), extraction.parts_of_claims(_claims(spark, d)))
    return out.groupBy("relation", "decision_note").agg(F.count("*").alias("items"))


def relation_groups(spark, d):
    """Items of each claim by relation, in the order they are shown; groups without items are left out."""
    order = F.when(F.col("relation") == "supports", 1).when(F.col("relation") == "refutes", 2).when(F.col("relation") == "partially_supports", 3).otherwise(4)
    return _evidence(spark, d).groupBy("claim_id", order.alias("tier")).agg(F.count("*").alias("items"), F.array_sort(F.collect_list("evidence_id")).alias("evidence_ids"))


def evidence_counts(spark, d):
    """Items of each claim over all its clusters."""
    return _evidence(spark, d).groupBy("claim_id").agg(F.countDistinct("cluster_id").alias("clusters"), F.count("*").alias("items"))


QUERIES = {f.__name__: f for f in (retrieval_queries, admitted_evidence, ranked_evidence, merged_evidence, evidence_groups, applied_decisions, relation_groups, evidence_counts)}
SQL = {
    "relation_groups": f"WITH {EV} SELECT claim_id, CASE relation WHEN 'supports' THEN 1 WHEN 'refutes' THEN 2 WHEN 'partially_supports' THEN 3 ELSE 4 END AS tier, count(*) AS items, list(evidence_id ORDER BY evidence_id) AS evidence_ids FROM ev GROUP BY 1, 2",
    "evidence_counts": f"WITH {EV} SELECT claim_id, count(DISTINCT cluster_id) AS clusters, count(*) AS items FROM ev GROUP BY 1",
}
