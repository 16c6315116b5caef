"""Queries on sources, sinks and time, with their SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from attestia.functions import text as T
from attestia.sources import search as S
from attestia.sources import sinks
from attestia.sources.html import readable_text
from attestia.streaming import limits
from attestia.session import table

from .judging import CL, EV, TK, _claims, _evidence, _tasks


def admission_limit(spark, d):
    """Exact rolling admission: ten accepted events a user and hour of the day's clock scaled to minutes."""
    e = table(spark, d, "events").withColumn("at", F.timestamp_micros((F.unix_micros(F.col("ts").cast("timestamp")) / 20_000).cast("bigint")))
    return limits.admissions_batch(e, "user_id", "at", "event_id")


def hourly_events(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return limits.windowed_counts(e, "ts", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))


def fixture_search(spark, d):
    """Logged hits served again as a search source for the same query text."""
    h = table(spark, d, "kb_hits").select("query", F.col("hit_rank").alias("ord"), "chunk_id").distinct()
    first = h.groupBy("query", "ord").agg(F.min("chunk_id").alias("chunk_id"))
    asked = table(spark, d, "kb_hits").select("query_id", F.concat(F.lit("  "), F.upper("query"), F.lit(" ")).alias("query")).distinct()
    return S.search(asked, first, 3).select("query_id", "ord", "chunk_id")


def task_reports(spark, d):
    """Each task's JSON report read back: claims, status, the labels in reading order, and the evidence it holds."""
    r = sinks.json_reports(_tasks(spark, d), _claims(spark, d), _evidence(spark, d))
    kept = F.from_json(F.get_json_object("report", "$.claims"), "array<struct<claim_id:string,label:string,normalized_claim:string,evidence:array<struct<evidence_id:string,url:string>>>>")
    r = r.withColumn("c", kept)
    items = F.flatten(F.transform("c", lambda c: F.transform(F.coalesce(c["evidence"], F.array().cast("array<struct<evidence_id:string,url:string>>")), lambda e: e["evidence_id"])))
    return r.select(
        "task_id", F.size("c").alias("claims"), F.get_json_object("report", "$.status").alias("status"), F.array_join(F.transform("c", lambda c: F.concat(c["claim_id"], F.lit("="), F.coalesce(c["label"], F.lit("-")))), ",").alias("labels"),
        F.md5(F.array_join(F.transform("c", lambda c: F.coalesce(c["normalized_claim"], F.lit(""))), "\x01")).alias("texts"), F.array_join(F.array_sort(items), ",").alias("evidence"))


def markdown_reports(spark, d):
    """Each task's Markdown report, as its sections and the digest of the whole document."""
    r = sinks.markdown_reports(_tasks(spark, d), _claims(spark, d))
    return r.select("task_id", F.size(F.regexp_extract_all("report", F.lit(r"(?m)^## "), F.lit(0))).alias("sections"), F.md5("report").alias("digest"))


def imported_documents(spark, d):
    """New uploads after rejecting bodies already stored: every second document of the library is stored, the whole library is delivered."""
    docs = table(spark, d, "kb_documents").select("document_id", "pages").distinct()
    known = docs.filter("substring(document_id, -1) IN ('0', '2', '4', '6', '8')").withColumn("content_hash", F.sha2(F.to_json("pages"), 256))
    return sinks.import_documents(known, docs).select("document_id")


def readable_results(spark, d):
    """Title and whole content of search results wrapped in markup, read back as text."""
    shown = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    html = F.concat(F.lit("<script>x()</script><h1>"), shown(F.col("title")), F.lit("</h1><p>"), F.replace(shown(F.col("content")), F.lit("\n"), F.lit("</p><p>")), F.lit("</p>"))
    r = table(spark, d, "search_results").filter("content IS NOT NULL").select("result_id", html.alias("html")).distinct()
    return r.select("result_id", F.length(readable_text("html")).alias("n"))


def changed_claims(spark, d):
    """Claims whose state or clusters differ between two deliveries of the table."""
    c = _claims(spark, d).select("claim_id", "state", "evidence_cluster_ids")
    old = c.withColumn("state", F.when(F.col("state") == "judging", "retrieving").otherwise(F.col("state")))
    return limits.changed(old, c, "claim_id", ["state", "evidence_cluster_ids"]).select("claim_id", "state")


def plain_claims(spark, d):
    return table(spark, d, "claims").select("claim_id", T.plain("normalized_claim").alias("plain"), T.utf16_length(F.col("normalized_claim")).alias("units")).distinct()


def _escaped(x: str) -> str:
    """Text as Markdown and HTML show it."""
    html = f"replace(replace(replace(coalesce({x}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    return f"regexp_replace({html}, '([\\\\`*_{{}}\\[\\]()#+\\-.!|])', '\\\\\\1', 'g')"


QUERIES = {f.__name__: f for f in (admission_limit, hourly_events, fixture_search, task_reports, markdown_reports, imported_documents, readable_results, changed_claims, plain_claims)}
SQL = {
    "hourly_events": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
    "fixture_search": "WITH f AS (SELECT lower(trim(query)) AS k, hit_rank AS ord, min(chunk_id) AS chunk_id FROM kb_hits GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ord) AS r FROM f), q AS (SELECT DISTINCT query_id, lower(trim(query)) AS k FROM kb_hits) SELECT query_id, ord, chunk_id FROM q JOIN n USING (k) WHERE r <= 3",
    "task_reports": f"""WITH {CL}, {TK}, {EV}, i AS (SELECT claim_id, evidence_id FROM ev WHERE claim_id IS NOT NULL),
e AS (SELECT task_id, string_agg(evidence_id, ',' ORDER BY evidence_id) AS evidence FROM cl JOIN i USING (claim_id) GROUP BY 1),
c AS (SELECT task_id, count(*)::INT AS n, string_agg(claim_id || '=' || coalesce(label, '-'), ',' ORDER BY char_start NULLS FIRST, claim_id) AS labels, string_agg(coalesce(normalized_claim, ''), chr(1) ORDER BY char_start NULLS FIRST, claim_id) AS texts FROM cl GROUP BY 1)
SELECT task_id, coalesce(n, 0) AS claims, status, coalesce(labels, '') AS labels, md5(coalesce(texts, '')) AS texts, coalesce(evidence, '') AS evidence FROM tk LEFT JOIN c USING (task_id) LEFT JOIN e USING (task_id)""",
    "markdown_reports": f"""WITH {CL}, {TK}, s AS (SELECT task_id, char_start, claim_id, '## ' || {_escaped('normalized_claim')} || chr(10) || chr(10) || 'Label: ' || coalesce(label, 'not checked') || coalesce(' (' || support_score || ')', '') AS s FROM cl),
b AS (SELECT task_id, count(*)::INT AS n, string_agg(s, chr(10) || chr(10) ORDER BY char_start NULLS FIRST, claim_id) AS body FROM s GROUP BY 1)
SELECT task_id, coalesce(n, 0) AS sections, md5('# Report ' || task_id || chr(10) || chr(10) || coalesce(body, 'No claims.') || chr(10) || chr(10) || '_{sinks.DISCLAIMER}_' || chr(10)) AS digest FROM tk LEFT JOIN b USING (task_id)""",
    "changed_claims": f"WITH {CL} SELECT claim_id, state FROM cl WHERE state = 'judging'",
    "imported_documents": "WITH d AS (SELECT DISTINCT document_id, pages FROM kb_documents), f AS (SELECT pages, min(document_id) AS document_id FROM d GROUP BY 1) SELECT document_id FROM f WHERE pages NOT IN (SELECT pages FROM d WHERE right(document_id, 1) IN ('0', '2', '4', '6', '8'))",
}
