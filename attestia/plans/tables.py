"""Queries on versions, windows, intervals, graphs, sets and time, with their SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestia.functions import text as T
from attestia.functions import urls
from attestia.operators import fusion, graph, intervals
from attestia.operators.versions import latest, upsert, without_known
from attestia.session import table

from .judging import CL, HOST, TK, _claims, _evidence, _tasks


def task_versions(spark, d):
    return _tasks(spark, d).select("task_id", "status", "updated_at", F.array_sort(F.array_distinct("failed_providers")).alias("failed_providers"))


def claims_page(spark, d):
    """Claims in reading order with their number and the total: rows 101 to 150."""
    c = _claims(spark, d).select("claim_id", "task_id", "char_start")
    return c.withColumn("total", F.count("*").over(Window.partitionBy("task_id"))).orderBy("task_id", "char_start", "claim_id").offset(100).limit(50)


def limited_claims(spark, d):
    """Claims within the limit of their task, and how many were left out."""
    c = _claims(spark, d).join(_tasks(spark, d).select("task_id", "claim_limit"), "task_id")
    w = Window.partitionBy("task_id").orderBy("char_start", "claim_id")
    r = c.select("task_id", "claim_id", "claim_limit", F.row_number().over(w).alias("n"), F.count("*").over(Window.partitionBy("task_id")).alias("found"))
    return r.filter("n <= claim_limit").select("task_id", "claim_id", "n", F.greatest(F.col("found") - F.col("claim_limit"), F.lit(0)).alias("left_out"))


def next_claims(spark, d):
    """Each claim with the one after it and whether the two touch."""
    w = Window.partitionBy("task_id").orderBy("char_start", "char_end", "claim_id")
    c = _claims(spark, d)
    return c.select("claim_id", F.lead("claim_id").over(w).alias("next_id"), (F.lead("char_start").over(w) - F.col("char_end")).alias("gap"))


def span_overlaps(spark, d):
    """Recorded spans of one task that overlap."""
    s = table(spark, d, "text_spans").select("task_id", "span_no", "span_start", "span_end").distinct()
    return intervals.overlapping(s, "task_id", "span_no", "span_start", "span_end")


def claim_parents(spark, d):
    """The recorded span each claim starts in (last one starting at or before it)."""
    spans = table(spark, d, "text_spans").select("task_id", "span_start", "span_end").distinct()
    return intervals.containing(_claims(spark, d).select("task_id", "claim_id", F.col("char_start").cast("bigint").alias("char_start")), spans, "task_id", "char_start", "span_start", "span_end").select("claim_id", "span_start", "span_end")


def highlight_segments(spark, d):
    """Task texts cut at claim boundaries, in UTF-16 units, with the number of claims over each piece."""
    t = _tasks(spark, d).select("task_id", T.utf16_length(F.trim("input_text")).alias("length")).filter("length > 0")
    return intervals.segments(_claims(spark, d).select("task_id", "char_start", "char_end").join(t, "task_id"), "task_id", "char_start", "char_end", "length")


def claim_slices(spark, d):
    """Whether the UTF-16 slice of the stripped input at a claim's offsets is its source text."""
    from attestia.functions.text import utf16_slice

    t = _tasks(spark, d).select("task_id", F.regexp_replace("input_text", r"^[\s\x{A0}\x{3000}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}]+|[\s\x{A0}\x{3000}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}]+$", "").alias("x"))
    c = _claims(spark, d).join(t, "task_id")
    same = F.coalesce(utf16_slice(F.col("x"), F.col("char_start"), F.col("char_end")) == F.col("source_text"), F.lit(False))
    return c.groupBy("task_id").agg(F.count("*").alias("claims"), F.count_if(same).alias("exact"))


def evidence_components(spark, d):
    """Evidence of one claim joined by equal site or equal hash, transitively."""
    e = _evidence(spark, d).select("evidence_id", F.concat_ws("|", "claim_id", urls.site(urls.host(F.col("url")))).alias("by_site"), F.concat_ws("|", "claim_id", "content_hash").alias("by_hash"), "content_hash")
    e = e.withColumn("by_hash", F.when(F.coalesce("content_hash", F.lit("")) != "", F.col("by_hash")))
    return graph.linked_by_keys(e, "evidence_id", ["by_site", "by_hash"])


def set_cover(spark, d):
    e = _evidence(spark, d).filter(F.coalesce(F.col("excerpt"), F.lit("")) != "")
    parts = F.transform(F.filter("checks", lambda c: c["relation"] == "supports"), lambda c: c["part_id"])
    return fusion.cover(e.select("claim_id", "evidence_id", F.coalesce(parts, F.array().cast("array<int>")).alias("parts"), (F.col("source_type") == "web").alias("web"), "authority"))


def url_first_wins(spark, d):
    """One search result a claim and URL: body before snippet, then the longest, then the first."""
    body = F.coalesce(F.element_at("metadata", "content_kind") == "raw_text", F.lit(False))
    w = Window.partitionBy("claim_id", "url").orderBy(body.desc(), F.char_length(F.coalesce("content", F.lit(""))).desc(), "query_no", "result_id")
    r = table(spark, d, "search_results").withColumn("n", F.row_number().over(w)).filter("n = 1")
    return r.select("claim_id", "url", "result_id", F.element_at("metadata", "provider_score").cast("double").alias("provider_score"))


def query_union(spark, d):
    """First occurrence of each site over a claim's queries in order."""
    w = Window.partitionBy("claim_id", "site").orderBy("query_no", "result_id")
    r = table(spark, d, "search_results").select("claim_id", "query_no", "result_id", urls.site(urls.host(F.col("url"))).alias("site")).distinct()
    return r.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def published_days(spark, d):
    """Dates of search results where they are ISO or slashed; anything else is null."""
    r = table(spark, d, "search_results").select("result_id", F.trim("published_at").alias("p")).distinct()
    day = F.coalesce(F.try_to_date(F.regexp_extract("p", r"^(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd"), F.try_to_date(F.regexp_extract("p", r"^(\d{4}/\d{2}/\d{2})", 1), "yyyy/MM/dd"))
    return r.select("result_id", day.alias("day"))


def stale_hashes(spark, d):
    """Items whose stored hash is not that of their excerpt."""
    e = _evidence(spark, d).filter("excerpt IS NOT NULL")
    return e.groupBy("source_type").agg(F.count("*").alias("items"), F.count_if(F.coalesce(F.sha2("excerpt", 256) != F.col("content_hash"), F.lit(True))).alias("stale"))


def state_histogram(spark, d):
    return _claims(spark, d).groupBy("claim_type", "state").agg(F.count("*").alias("n"))


def risk_order(spark, d):
    """Claims of each task, riskiest label first, ten a task."""
    risk = F.when(F.col("label") == "incorrect", 5).when(F.col("label") == "disputed", 4).when(F.col("label") == "evidence_insufficient", 3).when(F.col("label").isNull(), 2).when(F.col("label") == "credible", 1).otherwise(0)
    w = Window.partitionBy("task_id").orderBy(risk.desc(), "char_start", "claim_id")
    return _claims(spark, d).select("task_id", "claim_id", F.row_number().over(w).alias("place")).filter("place <= 10")


def cluster_id_sets(spark, d):
    """Stored cluster ids of a claim against those of its evidence: shared, only stored, only found."""
    found = _evidence(spark, d).groupBy("claim_id").agg(F.collect_set("cluster_id").alias("f"))
    c = _claims(spark, d).select("claim_id", F.coalesce("evidence_cluster_ids", F.array().cast("array<string>")).alias("s")).join(found, "claim_id", "left")
    f = F.coalesce("f", F.array().cast("array<string>"))
    return c.select("claim_id", F.size(F.array_intersect("s", f)).alias("shared"), F.size(F.array_except("s", f)).alias("stored_only"), F.size(F.array_except(f, "s")).alias("found_only"))


def orphan_evidence(spark, d):
    return without_known(_evidence(spark, d).select("evidence_id", "claim_id"), table(spark, d, "claims"), "claim_id")


def claims_upserted(spark, d):
    """Failed claims replaced by a reset version, the rest kept."""
    c = _claims(spark, d).select("claim_id", "state", "label", "retry_count")
    new = c.filter("state = 'failed' AND retry_count < 2").select("claim_id", F.lit("pending").alias("state"), F.lit(None).cast("string").alias("label"), (F.col("retry_count") + 1).cast("int").alias("retry_count"))
    return upsert(c, new, "claim_id")


def rolling_minute(spark, d):
    """Events of a user in the 60 seconds up to each event."""
    e = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-60_000_000, 0)
    return e.select("event_id", F.count("*").over(w).alias("in_minute"))


def sessions(spark, d):
    """Sessions of a user: a gap of more than 30 minutes begins a new one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    e = table(spark, d, "events").withColumn("new", F.coalesce(gap > 1_800_000_000, F.lit(True)).cast("int")).withColumn("session", F.sum("new").over(w))
    return e.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value"))


def newest_undoable(spark, d):
    """The newest event of each user that no later 'error' event of the user cancelled."""
    e = table(spark, d, "events")
    last = e.filter("event_type = 'error'").groupBy("user_id").agg(F.max("ts").alias("cut"))
    left = e.filter("event_type <> 'error'").join(last, "user_id", "left").filter("cut IS NULL OR ts > cut")
    return left.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


def label_cube(spark, d):
    g = _claims(spark, d).cube("claim_type", "label").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
    return g


def publisher_share(spark, d):
    """Items of each publisher, their share and rank: the hot publisher is counted by partial aggregation."""
    p = _evidence(spark, d).groupBy("publisher").agg(F.count("*").alias("n"), F.count_if(F.col("is_reprint")).alias("reprints"))
    total = p.agg(F.sum("n").alias("total"))
    return p.join(F.broadcast(total)).select("publisher", "n", "reprints", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def report_fields(spark, d):
    """Claim reports as JSON, one a claim, with escaped text for Markdown."""
    c = _claims(spark, d)
    return c.select("claim_id", F.get_json_object(F.to_json(F.struct("claim_id", "label", "support_score")), "$.label").alias("label"), T.markdown_escaped(F.col("normalized_claim")).alias("markdown"))


def order_revenue(spark, d):
    """Revenue by order priority: a star join whose filters reach both scans."""
    o = table(spark, d, "orders").filter("o_orderdate >= '1995-01-01'").select("o_orderkey", "o_orderpriority")
    l = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("double"), 2).alias("revenue"), F.count("*").alias("lines"))


QUERIES = {f.__name__: f for f in (
    task_versions, claims_page, limited_claims, next_claims, span_overlaps, claim_parents, highlight_segments, claim_slices, evidence_components, set_cover, url_first_wins, query_union, published_days,
    stale_hashes, state_histogram, risk_order, cluster_id_sets, orphan_evidence, claims_upserted, rolling_minute, sessions, newest_undoable, label_cube, publisher_share, report_fields, order_revenue)}
_EV0 = "ev0 AS (SELECT * EXCLUDE (_n) FROM (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY retrieved_at DESC NULLS LAST) AS _n FROM evidence_items) WHERE _n = 1)"
_SITE = lambda h: f"array_to_string(list_slice(string_split({h}, '.'), CASE WHEN array_to_string(list_slice(string_split({h}, '.'), -2, -1), '.') IN {urls.LONG_SUFFIXES} THEN -3 ELSE -2 END, -1), '.')"
_WS = r"[\s\x{A0}\x{3000}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}]+"
_UNITS = "(length({0}) + length(regexp_replace({0}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"
SQL = {
    "task_versions": f"WITH {TK} SELECT task_id, status, updated_at, list_sort(list_distinct(failed_providers)) AS failed_providers FROM tk",
    "claims_page": f"WITH {CL} SELECT claim_id, task_id, char_start, count(*) OVER (PARTITION BY task_id) AS total FROM cl ORDER BY task_id, char_start, claim_id LIMIT 50 OFFSET 100",
    "limited_claims": f"WITH {CL}, {TK}, r AS (SELECT task_id, claim_id, claim_limit, row_number() OVER (PARTITION BY task_id ORDER BY char_start, claim_id)::INT AS n, count(*) OVER (PARTITION BY task_id) AS found FROM cl JOIN tk USING (task_id)) SELECT task_id, claim_id, n, greatest(found - claim_limit, 0) AS left_out FROM r WHERE n <= claim_limit",
    "next_claims": f"WITH {CL} SELECT claim_id, lead(claim_id) OVER w AS next_id, lead(char_start) OVER w - char_end AS gap FROM cl WINDOW w AS (PARTITION BY task_id ORDER BY char_start, char_end, claim_id)",
    "span_overlaps": "WITH s AS (SELECT DISTINCT task_id, span_no, span_start, span_end FROM text_spans WHERE span_end > span_start) SELECT a.task_id, a.span_no AS span_no_a, b.span_no AS span_no_b FROM s a JOIN s b ON a.task_id = b.task_id AND a.span_no < b.span_no AND a.span_start < b.span_end AND b.span_start < a.span_end",
    "claim_parents": f"WITH {CL}, s AS (SELECT DISTINCT task_id, span_start, span_end FROM text_spans), p AS (SELECT claim_id, c.char_start, s.span_start, s.span_end, row_number() OVER (PARTITION BY claim_id ORDER BY s.span_start DESC NULLS LAST, s.span_end DESC) AS n FROM cl c LEFT JOIN s ON c.task_id = s.task_id AND s.span_start <= c.char_start) SELECT claim_id, CASE WHEN char_start < span_end THEN span_start END::BIGINT AS span_start, CASE WHEN char_start < span_end THEN span_end END::BIGINT AS span_end FROM p WHERE n = 1",
    "highlight_segments": f"""WITH {CL}, {TK}, t AS (SELECT task_id, {_UNITS.format("trim(input_text, ' ')")}::INT AS len FROM tk WHERE length(trim(input_text, ' ')) > 0), j AS (SELECT task_id, char_start, char_end, len FROM cl JOIN t USING (task_id)),
x AS (SELECT task_id, char_start AS pos, 1 AS d FROM j WHERE char_start >= 0 AND char_end > char_start AND char_end <= len UNION ALL SELECT task_id, char_end, -1 FROM j WHERE char_start >= 0 AND char_end > char_start AND char_end <= len UNION ALL SELECT task_id, 0, 0 FROM j UNION ALL SELECT task_id, len, 0 FROM j),
m AS (SELECT task_id, pos, sum(d) AS d FROM x GROUP BY 1, 2), s AS (SELECT task_id, pos AS seg_start, lead(pos) OVER w AS seg_end, (sum(d) OVER w)::BIGINT AS covers FROM m WINDOW w AS (PARTITION BY task_id ORDER BY pos)) SELECT * FROM s WHERE seg_end > seg_start""",
    "evidence_components": f"""WITH RECURSIVE {_EV0}, e AS (SELECT evidence_id, claim_id, {_SITE(HOST)} AS s, content_hash AS h FROM ev0),
n AS (SELECT a.evidence_id AS x, b.evidence_id AS y FROM e a JOIN e b ON a.claim_id = b.claim_id AND (a.s = b.s OR (a.h = b.h AND a.h <> ''))), r AS (SELECT x, y FROM n UNION SELECT r.x, n.y FROM r JOIN n ON r.y = n.x) SELECT x AS evidence_id, min(y) AS component FROM r GROUP BY 1""",
    "url_first_wins": "SELECT claim_id, url, result_id, TRY_CAST(metadata['provider_score'] AS DOUBLE) AS provider_score FROM (SELECT *, row_number() OVER (PARTITION BY claim_id, url ORDER BY coalesce(metadata['content_kind'] = 'raw_text', false) DESC, length(coalesce(content, '')) DESC, query_no, result_id) AS n FROM search_results) WHERE n = 1",
    "query_union": f"WITH u AS (SELECT DISTINCT claim_id, query_no, result_id, {_SITE(HOST)} AS site FROM search_results) SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY claim_id, site ORDER BY query_no, result_id) AS n FROM u) WHERE n = 1",
    "published_days": "SELECT DISTINCT result_id, coalesce(TRY_CAST(nullif(regexp_extract(trim(published_at), '^([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), '') AS DATE), TRY_CAST(replace(nullif(regexp_extract(trim(published_at), '^([0-9]{4}/[0-9]{2}/[0-9]{2})', 1), ''), '/', '-') AS DATE)) AS day FROM search_results",
    "stale_hashes": f"WITH {_EV0} SELECT source_type, count(*) AS items, count(*) FILTER (coalesce(sha256(excerpt) <> content_hash, true)) AS stale FROM ev0 WHERE excerpt IS NOT NULL GROUP BY 1",
    "state_histogram": f"WITH {CL} SELECT claim_type, state, count(*) AS n FROM cl GROUP BY 1, 2",
    "risk_order": f"WITH {CL} SELECT * FROM (SELECT task_id, claim_id, row_number() OVER (PARTITION BY task_id ORDER BY CASE WHEN label = 'incorrect' THEN 5 WHEN label = 'disputed' THEN 4 WHEN label = 'evidence_insufficient' THEN 3 WHEN label IS NULL THEN 2 WHEN label = 'credible' THEN 1 ELSE 0 END DESC, char_start, claim_id)::INT AS place FROM cl) WHERE place <= 10",
    "cluster_id_sets": f"WITH {_EV0}, {CL}, f AS (SELECT claim_id, list(DISTINCT cluster_id) AS f FROM ev0 GROUP BY 1), j AS (SELECT c.claim_id, list_distinct(coalesce(evidence_cluster_ids, [])) AS s, coalesce(f, []) AS f FROM cl c LEFT JOIN f USING (claim_id)) SELECT claim_id, len(list_intersect(s, f))::INT AS shared, len(list_filter(s, lambda x: NOT list_contains(f, x)))::INT AS stored_only, len(list_filter(f, lambda x: NOT list_contains(s, x)))::INT AS found_only FROM j",
    "orphan_evidence": f"WITH {_EV0} SELECT evidence_id, claim_id FROM ev0 WHERE claim_id NOT IN (SELECT claim_id FROM claims WHERE claim_id IS NOT NULL)",
    "claims_upserted": f"WITH {CL} SELECT claim_id, CASE WHEN state = 'failed' AND retry_count < 2 THEN 'pending' ELSE state END AS state, CASE WHEN state = 'failed' AND retry_count < 2 THEN NULL ELSE label END AS label, CASE WHEN state = 'failed' AND retry_count < 2 THEN retry_count + 1 ELSE retry_count END::INT AS retry_count FROM cl",
    "rolling_minute": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS in_minute FROM events",
    "sessions": "WITH g AS (SELECT *, CASE WHEN coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000, true) THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, (sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS session FROM g) SELECT user_id, session, count(*) AS events, round(sum(value), 4) AS value FROM s GROUP BY 1, 2",
    "newest_undoable": "WITH l AS (SELECT user_id, max(ts) AS cut FROM events WHERE event_type = 'error' GROUP BY 1), e AS (SELECT e.*, row_number() OVER (PARTITION BY e.user_id ORDER BY ts DESC, event_id DESC) AS n FROM events e LEFT JOIN l USING (user_id) WHERE event_type <> 'error' AND (cut IS NULL OR ts > cut)) SELECT user_id, event_id FROM e WHERE n = 1",
    "label_cube": f"WITH {CL} SELECT claim_type, label, count(*) AS n, grouping(claim_type, label)::BIGINT AS level FROM cl GROUP BY CUBE (claim_type, label)",
    "publisher_share": f"WITH {_EV0}, p AS (SELECT publisher, count(*) AS n, count(*) FILTER (is_reprint) AS reprints FROM ev0 GROUP BY 1) SELECT publisher, n, reprints, round(n / (SELECT sum(n) FROM p), 6) AS share FROM p",
    "report_fields": f"WITH {CL} SELECT claim_id, label, regexp_replace(replace(replace(replace(coalesce(normalized_claim, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '([\\\\`*_{{}}\\[\\]()#+\\-.!|])', '\\\\\\1', 'g') AS markdown FROM cl",
    "order_revenue": "SELECT o_orderpriority, round(sum(l_extendedprice * (1 - l_discount))::DOUBLE, 2) AS revenue, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate >= '1995-01-01' GROUP BY 1",
}
