"""Queries on evidence, labels and coverage, with their SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestia.functions import urls
from attestia.functions.text import CLAUSE, OUTER, clause_parts
from attestia.operators import extraction as X
from attestia.operators import judging as J
from attestia.operators.versions import latest
from attestia.session import table


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "evidence_items"), "evidence_id", "retrieved_at")


def _claims(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "claims"), "claim_id", "retry_count")


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "tasks"), "task_id", "updated_at")


def _sql_kind() -> str:
    rules = " ".join("WHEN " + " OR ".join(f"h = '{x}' OR ends_with(h, '.{x}')" for x in ds) + f" THEN '{k}'" for k, _, ds in urls.SOURCE_KINDS)
    return f"CASE {rules} ELSE 'unknown' END"


HOST = "lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1))"
EV = f"""ev0 AS (SELECT * EXCLUDE (_n) FROM (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY retrieved_at DESC NULLS LAST) AS _n FROM evidence_items) WHERE _n = 1),
ev1 AS (SELECT *, {HOST} AS h FROM ev0),
ev1b AS (SELECT *, {_sql_kind()} AS kind FROM ev1),
ev2 AS (SELECT *, CASE WHEN source_type = 'knowledge' THEN 'body' WHEN kind IN {J.LOW_KINDS} THEN kind WHEN contains(lower(coalesce(quality_reason, '')), '摘要') OR contains(lower(coalesce(quality_reason, '')), 'snippet') THEN 'snippet' ELSE 'body' END AS form,
  coalesce(len(list_filter(checks, lambda c: c.relation IN ('supports', 'refutes') AND c.excerpt <> '' AND contains(excerpt, c.excerpt))) > 0, false) AS direct,
  coalesce(authority, 0) * 0.5::DOUBLE + coalesce(relevance, 0) * 0.3::DOUBLE + coalesce(time_fit, 0) * 0.2::DOUBLE AS q0 FROM ev1b),
ev AS (SELECT *, CASE WHEN form = 'snippet' THEN least(q0, CASE WHEN kind IN {J.INSTITUTIONS} THEN CASE WHEN direct THEN 0.78::DOUBLE ELSE 0.69::DOUBLE END WHEN kind = 'news' THEN 0.66::DOUBLE ELSE 0.56::DOUBLE END) WHEN form = 'social' THEN least(q0, 0.45::DOUBLE) ELSE q0 END AS quality FROM ev2),
ok AS (SELECT * FROM ev WHERE source_type = 'web' AND coalesce(excerpt, '') <> '' AND relevance >= 0.75 AND time_fit >= 0.5 AND quality >= CASE form WHEN 'body' THEN 0.58::DOUBLE WHEN 'snippet' THEN 0.55::DOUBLE END),
best AS (SELECT claim_id, cluster_id, relation, max(quality) AS best FROM ok GROUP BY ALL),
three AS (SELECT *, row_number() OVER (PARTITION BY claim_id, relation ORDER BY best DESC, cluster_id) AS r FROM best),
strength AS (SELECT claim_id, relation, least(1.0::DOUBLE, max(CASE WHEN r = 1 THEN best END) + coalesce(max(CASE WHEN r = 2 THEN best END), 0) * 0.2::DOUBLE + coalesce(max(CASE WHEN r = 3 THEN best END), 0) * 0.1::DOUBLE) AS strength FROM three WHERE r <= 3 GROUP BY ALL)"""
CL = "cl AS (SELECT * EXCLUDE (_n) FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY retry_count DESC NULLS LAST) AS _n FROM claims) WHERE _n = 1)"
TK = "tk AS (SELECT * EXCLUDE (_n) FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY updated_at DESC NULLS LAST) AS _n FROM tasks) WHERE _n = 1)"
_TRIMMED = f"list_filter(list_transform(regexp_extract_all(coalesce(normalized_claim, ''), '{CLAUSE}'), lambda p: regexp_replace(p, '{OUTER}', '', 'g')), lambda p: p <> '')"
PARTS = f"""pl AS (SELECT claim_id, {_TRIMMED} AS l FROM cl), pm AS (SELECT claim_id, CASE WHEN len(l) > 8 THEN list_append(l[1:7], array_to_string(l[8:], '')) ELSE l END AS l FROM pl),
parts AS (SELECT claim_id, unnest(range(1, len(l) + 1))::INT AS part_id, unnest(l) AS part_text FROM pm),
hits AS (SELECT p.claim_id, p.part_id, p.part_text, cluster_id, quality FROM parts p JOIN ok ON p.claim_id = ok.claim_id AND relation = 'supports'
  UNION ALL SELECT p.claim_id, p.part_id, p.part_text, cluster_id, quality FROM parts p JOIN (SELECT claim_id, cluster_id, quality, excerpt, unnest(checks) AS c FROM ok) k ON p.claim_id = k.claim_id AND p.part_id = c.part_id AND p.part_text = c.part_text WHERE c.relation = 'supports' AND c.excerpt <> '' AND contains(excerpt, c.excerpt)),
pb AS (SELECT claim_id, part_id, part_text, cluster_id, max(quality) AS best FROM hits GROUP BY ALL),
pt AS (SELECT *, row_number() OVER (PARTITION BY claim_id, part_id, part_text ORDER BY best DESC, cluster_id) AS r FROM pb),
pg AS (SELECT claim_id, part_id, part_text, least(1.0::DOUBLE, max(CASE WHEN r = 1 THEN best END) + coalesce(max(CASE WHEN r = 2 THEN best END), 0) * 0.2::DOUBLE + coalesce(max(CASE WHEN r = 3 THEN best END), 0) * 0.1::DOUBLE) AS s FROM pt WHERE r <= 3 GROUP BY ALL),
ps AS (SELECT p.claim_id, p.part_id, p.part_text, coalesce(s, 0) AS strength FROM parts p LEFT JOIN pg USING (claim_id, part_id, part_text))"""
VERDICT = f"""{EV}, {CL}, {PARTS},
pmin AS (SELECT claim_id, min(strength) AS least FROM ps GROUP BY 1),
s0 AS (SELECT c.claim_id, any_value(c.claim_type) AS claim_type, any_value(c.label) AS stored, coalesce(max(CASE WHEN relation = 'supports' THEN strength END), 0) AS whole, coalesce(max(CASE WHEN relation = 'refutes' THEN strength END), 0) AS refute FROM cl c LEFT JOIN strength USING (claim_id) GROUP BY 1),
s AS (SELECT *, greatest(whole, coalesce(least, 0)) AS support FROM s0 LEFT JOIN pmin USING (claim_id)),
v0 AS (SELECT *, CASE WHEN coalesce(claim_type = 'opinion' OR stored = 'not_applicable', false) THEN 'not_applicable' WHEN support >= 0.75 AND refute < 0.5 THEN 'credible' WHEN refute >= 0.75 AND support < 0.5 THEN 'incorrect' WHEN support >= 0.75 AND refute >= 0.75 THEN 'disputed' ELSE 'evidence_insufficient' END AS label FROM s),
sg AS (SELECT claim_id, bool_or(coalesce(excerpt, '') <> '') AS txt, bool_or(form = 'body' AND (relation = 'supports' OR len(list_filter(checks, lambda c: c.relation = 'supports')) > 0)) AS bs, bool_or(relation = 'supports') AS ws,
 bool_or(form = 'body' AND relation = 'refutes' AND evidence_id IN (SELECT evidence_id FROM ok)) AS br, bool_or(relation = 'partially_supports') AS pa, bool_or(relation IN ('supports', 'refutes') OR len(list_filter(checks, lambda c: c.relation IN ('supports', 'refutes'))) > 0) AS di, bool_or(source_type = 'knowledge') AS up FROM ev GROUP BY 1),
v AS (SELECT *, CASE WHEN label = 'not_applicable' THEN 'not_a_fact' WHEN label = 'credible' THEN CASE WHEN NOT coalesce(bs, false) THEN 'snippets_support' WHEN NOT coalesce(ws, false) THEN 'parts_supported' ELSE 'supported' END
 WHEN label = 'incorrect' THEN CASE WHEN NOT coalesce(br, false) THEN 'snippets_refute' ELSE 'refuted' END WHEN label = 'disputed' THEN 'conflict' WHEN NOT coalesce(txt, false) THEN 'no_text' WHEN support >= 0.5 AND refute >= 0.5 THEN 'near_conflict'
 WHEN support = 0 AND refute = 0 AND coalesce(pa, false) THEN 'partly_covered' WHEN NOT coalesce(di, false) THEN 'no_match' WHEN support = 0 AND refute = 0 AND coalesce(up, false) THEN 'unverified_upload' WHEN greatest(support, refute) < 0.75 THEN 'below_threshold' ELSE 'insufficient' END AS reason FROM v0 LEFT JOIN sg USING (claim_id))"""


def _parts(spark, d):
    """(claim_id, part_id, part_text) by clauses."""
    return _claims(spark, d).select("claim_id", F.posexplode(clause_parts(F.col("normalized_claim"))).alias("n", "part_text")).select("claim_id", (F.col("n") + 1).alias("part_id"), "part_text")


def evidence_quality(spark, d):
    e = J.with_quality(_evidence(spark, d))
    return e.select("evidence_id", "kind", "form", F.round("quality", 6).alias("quality"), F.coalesce(J.eligible(), F.lit(False)).alias("eligible"))


def cluster_strengths(spark, d):
    return J.cluster_best(J.with_quality(_evidence(spark, d))).withColumn("best", F.round("best", 6))


def part_strengths(spark, d):
    """Strength of every clause of every claim."""
    return J.part_strengths(_evidence(spark, d), _parts(spark, d)).withColumn("strength", F.round("strength", 6))


def claim_verdicts(spark, d):
    """Labels with their reasons; the facts of a claim are its atomic claims, its clauses where it is one (the SQL knows clauses only)."""
    return J.verdicts(_claims(spark, d), _evidence(spark, d), X.parts_of_claims(_claims(spark, d)))


def task_coverage(spark, d):
    return J.coverage(_claims(spark, d), _tasks(spark, d))


def source_profiles(spark, d):
    h = table(spark, d, "evidence_items").select(urls.host(F.col("url")).alias("host")).distinct()
    kind = urls.source_kind(F.col("host"))
    return h.select("host", urls.site(F.col("host")).alias("site"), kind.alias("kind"), urls.source_authority(kind).alias("authority"))


def url_forms(spark, d):
    u = table(spark, d, "search_results").select("result_id", "url").distinct()
    return u.select("result_id", urls.valid_url(F.col("url")).alias("valid"), urls.normal_url(F.col("url")).alias("normal"))


def label_confusion(spark, d):
    """Stored labels against those recomputed from the evidence; null is 'unknown'."""
    got = claim_verdicts(spark, d).select("claim_id", F.col("label").alias("predicted"))
    gold = _claims(spark, d).filter(F.col("label").isin(*J.FACTUAL)).select("claim_id", F.col("label").alias("gold"))
    known = F.when(F.col("predicted").isin(*J.FACTUAL), F.col("predicted")).otherwise("unknown")
    return gold.join(got, "claim_id", "left").withColumn("p", known).groupBy("gold").pivot("p", [*J.FACTUAL, "unknown"]).count().na.fill(0)


def class_metrics(spark, d):
    got = claim_verdicts(spark, d).select("claim_id", F.col("label").alias("predicted"))
    both = _claims(spark, d).filter(F.col("label").isin(*J.FACTUAL)).select("claim_id", F.col("label").alias("gold")).join(got, "claim_id")
    each = both.select(F.explode(F.array(*map(F.lit, J.FACTUAL))).alias("label"), "gold", "predicted")
    hit, p, g = F.count_if((F.col("gold") == F.col("label")) & (F.col("predicted") == F.col("label"))), F.count_if(F.col("predicted") == F.col("label")), F.count_if(F.col("gold") == F.col("label"))
    return each.groupBy("label").agg(hit.alias("hits"), F.round(F.try_divide(hit, p), 6).alias("precision"), F.round(F.try_divide(hit, g), 6).alias("recall"))


def cluster_heads(spark, d):
    """The best item of each cluster, whether its hash repeats the cluster's first, and its place among the clusters."""
    e = J.with_quality(_evidence(spark, d))
    first = Window.partitionBy("claim_id", "cluster_id").orderBy("retrieved_at", "evidence_id")
    by = Window.partitionBy("claim_id", "cluster_id").orderBy(F.col("quality").desc(), "evidence_id")
    heads = e.withColumn("reprint", F.coalesce((F.row_number().over(first) > 1) & (F.col("content_hash") == F.first("content_hash").over(first)), F.lit(False)))
    heads = heads.withColumn("r", F.row_number().over(by)).filter("r = 1")
    place = Window.partitionBy("claim_id").orderBy(F.col("quality").desc(), "cluster_id")
    return heads.select("claim_id", "cluster_id", "evidence_id", F.round("quality", 6).alias("quality"), "reprint", F.row_number().over(place).alias("place"))


def round_robin(spark, d):
    """Evidence filled across clusters: first items of all clusters, then second ones, five a claim."""
    e = J.with_quality(_evidence(spark, d))
    inner = Window.partitionBy("claim_id", "cluster_id").orderBy(F.col("quality").desc(), "evidence_id")
    turn = Window.partitionBy("claim_id").orderBy("position", "cluster_id")
    ranked = e.withColumn("position", F.row_number().over(inner))
    return ranked.withColumn("slot", F.row_number().over(turn)).filter("slot <= 5").select("claim_id", "slot", "cluster_id", "evidence_id")


def prediction_tallies(spark, d):
    """Accuracy, abstention and false errors over all claims with a factual label."""
    got = claim_verdicts(spark, d).select("claim_id", F.col("label").alias("predicted"))
    both = _claims(spark, d).filter(F.col("label").isin(*J.FACTUAL)).join(got, "claim_id")
    return both.groupBy("claim_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == F.col("predicted")).alias("right"), F.count_if(F.col("predicted").isin("evidence_insufficient", "not_applicable")).alias("abstained"),
        F.count_if(~F.col("predicted").isin(*J.FACTUAL)).alias("invalid"), F.count_if((F.col("label") == "evidence_insufficient") & (F.col("predicted") == "incorrect")).alias("false_errors"))


def whole_relation(spark, d):
    """One relation per item from its checks: any refutation, else support by all parts, else partial, else unknown."""
    e = _evidence(spark, d).filter(F.size("checks") > 0)
    r = lambda x: F.exists("checks", lambda c: c["relation"] == x)
    rolled = F.when(r("refutes"), "refutes").when(F.forall("checks", lambda c: c["relation"] == "supports"), "supports").when(r("supports") | r("partially_supports"), "partially_supports").otherwise("unknown")
    return e.select("evidence_id", rolled.alias("rolled"))


def quotes_grounded(spark, d):
    """Checks whose quoted passage stands verbatim in the stored excerpt, per claim."""
    e = _evidence(spark, d).select("claim_id", "excerpt", F.explode("checks").alias("c"))
    return e.groupBy("claim_id").agg(F.count("*").alias("checks"), F.count_if(F.coalesce(F.contains(F.col("excerpt"), F.col("c.excerpt")), F.lit(False))).alias("grounded"))


QUERIES = {f.__name__: f for f in (evidence_quality, cluster_strengths, part_strengths, claim_verdicts, task_coverage, source_profiles, url_forms, label_confusion, class_metrics, cluster_heads, round_robin, prediction_tallies, whole_relation, quotes_grounded)}
_F4 = "('credible', 'incorrect', 'disputed', 'evidence_insufficient')"
SQL = {
    "evidence_quality": f"WITH {EV} SELECT ev.evidence_id, kind, form, round(quality, 6) AS quality, ev.evidence_id IN (SELECT evidence_id FROM ok) AS eligible FROM ev",
    "cluster_strengths": f"WITH {EV} SELECT claim_id, cluster_id, relation, round(best, 6) AS best FROM best",
    "part_strengths": f"WITH {EV}, {CL}, {PARTS} SELECT claim_id, part_id, part_text, round(strength, 6) AS strength FROM ps",
    "claim_verdicts": f"WITH {VERDICT} SELECT claim_id, round(support, 6) AS support, round(refute, 6) AS refute, label, reason, CASE WHEN label IN ('credible', 'incorrect', 'disputed') THEN round_even(50 + (support - refute) * 50, 0)::INT END AS support_score FROM v",
    "task_coverage": f"""WITH {CL}, {TK}, a AS (SELECT task_id, count(*) AS n, count(*) FILTER (state = 'done') AS claims_processed,
 count(*) FILTER (label IN {_F4} OR coalesce(claim_type, '') <> 'opinion') AS verifiable_claims,
 count(*) FILTER ((label IN {_F4} OR coalesce(claim_type, '') <> 'opinion') AND state = 'done') AS processed_verifiable_claims,
 count(*) FILTER ((label IN {_F4} OR coalesce(claim_type, '') <> 'opinion') AND label IN ('credible', 'incorrect', 'disputed')) AS adjudicated_verifiable_claims,
 count(*) FILTER (state IN ('unchecked', 'failed')) AS left_claims, count(*) FILTER (label = 'credible') AS n_credible, count(*) FILTER (label = 'incorrect') AS n_incorrect, count(*) FILTER (label = 'disputed') AS n_disputed,
 count(*) FILTER (label = 'evidence_insufficient') AS n_evidence_insufficient, count(*) FILTER (label = 'not_applicable') AS n_not_applicable, avg(support_score) FILTER (label IN ('credible', 'incorrect', 'disputed')) AS m FROM cl GROUP BY 1),
j AS (SELECT task_id, truncated, claims_unchecked AS beyond, failed_providers, status, coalesce(n, 0) AS n, m, coalesce(claims_processed, 0) AS claims_processed, coalesce(verifiable_claims, 0) AS verifiable_claims, coalesce(processed_verifiable_claims, 0) AS processed_verifiable_claims, coalesce(adjudicated_verifiable_claims, 0) AS adjudicated_verifiable_claims,
 coalesce(left_claims, 0) AS left_claims, coalesce(n_credible, 0) AS n_credible, coalesce(n_incorrect, 0) AS n_incorrect, coalesce(n_disputed, 0) AS n_disputed, coalesce(n_evidence_insufficient, 0) AS n_evidence_insufficient, coalesce(n_not_applicable, 0) AS n_not_applicable FROM tk LEFT JOIN a USING (task_id)),
r AS (SELECT *, round_even(processed_verifiable_claims / nullif(verifiable_claims, 0), 4) AS processing_coverage, round_even(adjudicated_verifiable_claims / nullif(verifiable_claims, 0), 4) AS verification_coverage,
 coalesce(len(failed_providers), 0) > 0 OR NOT coalesce(status IN ('succeeded', 'partial'), false) OR left_claims > 0 AS technical_failure FROM j),
x AS (SELECT *, CASE WHEN verification_coverage >= 0.8 AND NOT coalesce(truncated, false) AND NOT technical_failure THEN round(m, 2) END AS score FROM r)
SELECT * EXCLUDE (n, m, beyond, failed_providers, status), n + coalesce(beyond, 0) AS claims_extracted, left_claims + coalesce(beyond, 0) AS claims_unchecked,
 CASE WHEN verification_coverage IS NULL THEN 'nothing_verifiable' WHEN score IS NULL THEN 'coverage_or_failure' ELSE 'mean_of_adjudicated' END AS score_note FROM x""",
    "source_profiles": f"""WITH h AS (SELECT DISTINCT {HOST} AS h FROM evidence_items), k AS (SELECT h, {_sql_kind()} AS kind FROM h)
SELECT h AS host, array_to_string(list_slice(string_split(h, '.'), CASE WHEN array_to_string(list_slice(string_split(h, '.'), -2, -1), '.') IN {urls.LONG_SUFFIXES} THEN -3 ELSE -2 END, -1), '.') AS site, kind,
CASE kind {' '.join(f"WHEN '{k}' THEN {a}" for k, a, _ in urls.SOURCE_KINDS)} ELSE {urls.UNKNOWN_AUTHORITY} END::DOUBLE AS authority FROM k""",
    "url_forms": f"""WITH u AS (SELECT DISTINCT result_id, url, lower(regexp_extract(url, '^(?i)(https?)://([^/?#]*)', 2)) AS a FROM search_results),
p AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(a, ':[0-9]*$', ''), '^\\[(.*)\\]$', '\\1'), '[.]+$', '') AS h, regexp_extract(a, ':([0-9]*)$', 1) AS port FROM u),
v AS (SELECT *, coalesce(h <> '' AND NOT contains(a, '@') AND port IN ('', '80', '443') AND h NOT IN {('localhost', *urls.METADATA_HOSTS)} AND NOT regexp_matches(h, '[.](localhost|local|internal)$') AND NOT starts_with(h, 'metadata.')
 AND CASE WHEN starts_with(a, '[') THEN regexp_matches(a, '^\\[[0-9a-f:.]+\\](:[0-9]*)?$') AND contains(h, ':') AND NOT regexp_matches(h, '{urls.PRIVATE_V6}') ELSE NOT regexp_matches(h, '{urls.PRIVATE}') AND NOT contains(h, '[') END AND NOT regexp_matches(url, '[\\x00-\\x20\\x7F]'), false) AS valid FROM p),
w AS (SELECT *, regexp_replace(url, '#.*$', '') AS bare FROM v), x AS (SELECT *, regexp_replace(bare, '^(?i)https?://[^/?#]*', '') AS rest FROM w)
SELECT result_id, valid, CASE WHEN valid THEN regexp_replace(lower(regexp_extract(bare, '^(?i)(https?://[^/?#]*)', 1)), '[.]+((:[0-9]*)?)$', '\\1') || CASE WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END END AS normal FROM x""",
    "label_confusion": f"WITH {VERDICT} SELECT c.label AS gold, " + ", ".join(f"count(*) FILTER (v.label = '{x}') AS {x}" for x in J.FACTUAL) + f", count(*) FILTER (v.label NOT IN {_F4}) AS unknown FROM cl c JOIN v USING (claim_id) WHERE c.label IN {_F4} GROUP BY 1",
    "class_metrics": f"WITH {VERDICT}, b AS (SELECT c.label AS gold, v.label AS predicted FROM cl c JOIN v USING (claim_id) WHERE c.label IN {_F4}), l AS (SELECT unnest(['credible', 'incorrect', 'disputed', 'evidence_insufficient']) AS label) SELECT label, count(*) FILTER (gold = label AND predicted = label) AS hits, round(count(*) FILTER (gold = label AND predicted = label) / nullif(count(*) FILTER (predicted = label), 0), 6) AS precision, round(count(*) FILTER (gold = label AND predicted = label) / nullif(count(*) FILTER (gold = label), 0), 6) AS recall FROM b, l GROUP BY 1",
    "cluster_heads": f"""WITH {EV}, f AS (SELECT *, row_number() OVER w AS n, first_value(content_hash) OVER w AS h0 FROM ev WINDOW w AS (PARTITION BY claim_id, cluster_id ORDER BY retrieved_at NULLS FIRST, evidence_id)),
g AS (SELECT *, coalesce(n > 1 AND content_hash = h0, false) AS reprint, row_number() OVER (PARTITION BY claim_id, cluster_id ORDER BY quality DESC, evidence_id) AS r FROM f)
SELECT claim_id, cluster_id, evidence_id, round(quality, 6) AS quality, reprint, row_number() OVER (PARTITION BY claim_id ORDER BY quality DESC, cluster_id)::INT AS place FROM g WHERE r = 1""",
    "round_robin": f"WITH {EV}, p AS (SELECT *, row_number() OVER (PARTITION BY claim_id, cluster_id ORDER BY quality DESC, evidence_id) AS position FROM ev), s AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY position, cluster_id) AS slot FROM p) SELECT claim_id, slot::INT AS slot, cluster_id, evidence_id FROM s WHERE slot <= 5",
    "prediction_tallies": f"WITH {VERDICT} SELECT c.claim_type, count(*) AS n, count(*) FILTER (c.label = v.label) AS right, count(*) FILTER (v.label IN ('evidence_insufficient', 'not_applicable')) AS abstained, count(*) FILTER (v.label = 'not_applicable') AS invalid, count(*) FILTER (c.label = 'evidence_insufficient' AND v.label = 'incorrect') AS false_errors FROM cl c JOIN v USING (claim_id) WHERE c.label IN {_F4} GROUP BY 1",
    "whole_relation": f"WITH {EV} SELECT evidence_id, CASE WHEN len(list_filter(checks, lambda c: c.relation = 'refutes')) > 0 THEN 'refutes' WHEN len(list_filter(checks, lambda c: c.relation = 'supports')) = len(checks) THEN 'supports' WHEN len(list_filter(checks, lambda c: c.relation IN ('supports', 'partially_supports'))) > 0 THEN 'partially_supports' ELSE 'unknown' END AS rolled FROM ev WHERE len(checks) > 0",
    "quotes_grounded": f"WITH {EV}, c AS (SELECT claim_id, excerpt, unnest(checks) AS c FROM ev) SELECT claim_id, count(*) AS checks, count(*) FILTER (coalesce(contains(excerpt, c.excerpt), false)) AS grounded FROM c GROUP BY 1",
}
