"""Queries on requests, library upkeep and what is shown, with their SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from attestia.functions import checks as K
from attestia.operators import library as L
from attestia.session import table
from attestia.streaming import limits

from .judging import CL, TK, _claims, _evidence, _tasks
from .searching import DOCS, _docs


def request_errors(spark, d):
    """What each task's request lacks."""
    return _tasks(spark, d).select("task_id", K.task_errors().alias("errors"))


def import_errors(spark, d):
    """What each upload's request lacks, its first page taken as the pasted text."""
    x = _docs(spark, d).withColumn("content", F.get("pages", F.lit(0))).withColumn("file", F.lit(None).cast("string"))
    return x.select("document_id", K.import_errors().alias("errors"))


def document_filter(spark, d):
    """Documents tagged 'harbour' that mention 'a' in title, publisher or tags."""
    return L.filtered(_docs(spark, d), "harbour", "A").select("document_id")


def reindex_remaining(spark, d):
    """Chunks still without a vector of the current model after one call on the stored vectors."""
    c = table(spark, d, "kb_chunks").select("chunk_id", F.get_json_object("data", "$.excerpt").alias("text"), "embedding", "embedding_model")
    encode = lambda todo: todo.select("chunk_id", F.array(F.char_length("text").cast("double"), F.lit(1.0)).alias("embedding"))
    return L.reindexed(c, encode, "lattice-base-64")[1]


def file_badges(spark, d):
    return _docs(spark, d).groupBy(K.file_badge(F.col("filename")).alias("badge")).agg(F.count("*").alias("documents"))


def recovered_claims(spark, d):
    """States after a restart."""
    t, c = limits.recovered(_tasks(spark, d), _claims(spark, d).select("claim_id", "task_id", "state", "label"))
    return c.join(t.select("task_id", "status"), "task_id", "left").groupBy("status", "state", F.col("label").isNull().alias("unlabelled")).agg(F.count("*").alias("n"))


def budgeted_claims(spark, d):
    """Claims that may start within a budget of 60 units, a unit for every ten characters before them."""
    c = _claims(spark, d).withColumn("cost", (F.col("char_end") - F.col("char_start")) / 10.0)
    return limits.within_budget(c, "task_id", ["char_start", "claim_id"], "cost", 60.0).groupBy("task_id").agg(F.count_if("started").alias("started"), F.count_if(~F.col("started")).alias("left"))


def judge_requests(spark, d):
    """Length of the bounded request block of every item."""
    return _evidence(spark, d).select("evidence_id", F.length(K.judge_request()).alias("n"))


def invalid_highlights(spark, d):
    """Claims of each task that cannot be highlighted: range out of the text or overlapping an earlier claim."""
    from pyspark.sql import Window

    t = _tasks(spark, d).select("task_id", F.trim("input_text").alias("text"))
    from attestia.functions.text import utf16_length

    w = Window.partitionBy("task_id").orderBy("char_start", "char_end", "claim_id").rowsBetween(Window.unboundedPreceding, -1)
    c = _claims(spark, d).join(t, "task_id").withColumn("reached", F.max("char_end").over(w))
    ok = (F.col("char_start") >= 0) & (F.col("char_end") > F.col("char_start")) & (F.col("char_end") <= utf16_length(F.col("text"))) & (F.coalesce("reached", F.lit(0)) <= F.col("char_start"))
    return c.groupBy("task_id").agg(F.count("*").alias("claims"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("invalid"))


def shown_shares(spark, d):
    """Share of processed claims of each task as it is shown."""
    c = _claims(spark, d).groupBy("task_id").agg((F.count_if(F.col("state") == "done") / F.count("*")).alias("share"))
    return _tasks(spark, d).join(c, "task_id", "left").select("task_id", K.percent_shown(F.col("share")).alias("shown"), K.day_shown(F.col("created_at")).alias("day"))


QUERIES = {f.__name__: f for f in (request_errors, import_errors, document_filter, reindex_remaining, file_badges, recovered_claims, budgeted_claims, judge_requests, invalid_highlights, shown_shares)}


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '{K.OUTER}', '', 'g')"


def _utf16(x: str) -> str:
    return f"(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


SQL = {
    "request_errors": f"WITH {TK}, x AS (SELECT task_id, {_trim("coalesce(input_text, '')")} AS t, claim_limit AS l FROM tk) SELECT task_id, list_filter([CASE WHEN t = '' THEN 'text_blank' END, CASE WHEN length(t) > {K.TEXT_MOST} THEN 'text_long' END, CASE WHEN l IS NULL OR l < 1 OR l > {K.CLAIMS_MOST} THEN 'claim_limit' END], lambda e: e IS NOT NULL) AS errors FROM x",
    "document_filter": f"WITH {DOCS} SELECT document_id FROM docs WHERE list_contains(tags, 'harbour') AND contains(lower(concat_ws(' ', title, publisher, array_to_string(coalesce(tags, []), ' '))), 'a')",
    "reindex_remaining": f"SELECT greatest(count(*) FILTER (embedding IS NULL OR NOT coalesce(embedding_model = 'lattice-base-64', false)) - {L.MOST_REINDEXED}, 0) AS remaining FROM kb_chunks",
    "file_badges": f"WITH {DOCS}, s AS (SELECT lower(regexp_extract(coalesce(filename, ''), '[.]([A-Za-z0-9]+)$', 1)) AS s FROM docs) SELECT CASE WHEN s = 'pdf' THEN 'PDF' WHEN s = 'docx' THEN 'DOCX' WHEN s IN ('md', 'markdown') THEN 'MD' WHEN s = 'txt' THEN 'TXT' ELSE 'FILE' END AS badge, count(*) AS documents FROM s GROUP BY 1",
    "recovered_claims": f"WITH {CL}, {TK}, j AS (SELECT cl.state, cl.label, tk.status, coalesce(tk.status IN ('created', 'running') AND cl.state IN ('pending', 'retrieving', 'judging'), false) AS hit FROM cl LEFT JOIN tk USING (task_id)) SELECT CASE WHEN status IN ('created', 'running') THEN 'interrupted' ELSE status END AS status, CASE WHEN hit THEN 'failed' ELSE state END AS state, hit OR label IS NULL AS unlabelled, count(*) AS n FROM j GROUP BY 1, 2, 3",
    "budgeted_claims": f"WITH {CL}, s AS (SELECT task_id, 60.0::DOUBLE - coalesce(sum((char_end - char_start) / 10.0::DOUBLE) OVER (PARTITION BY task_id ORDER BY char_start NULLS FIRST, claim_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM cl) SELECT task_id, count(*) FILTER (l - least(30, l * 0.4) > 0) AS started, count(*) FILTER (NOT l - least(30, l * 0.4) > 0) AS left FROM s GROUP BY 1",
    "invalid_highlights": f"WITH {CL}, {TK}, c AS (SELECT cl.task_id, char_start AS a, char_end AS b, {_utf16("trim(input_text, ' ')")} AS n, max(char_end) OVER (PARTITION BY cl.task_id ORDER BY char_start NULLS FIRST, char_end NULLS FIRST, claim_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM cl JOIN tk USING (task_id)) SELECT task_id, count(*) AS claims, count(*) FILTER (NOT coalesce(a >= 0 AND b > a AND b <= n AND coalesce(r, 0) <= a, false)) AS invalid FROM c GROUP BY 1",
    "shown_shares": f"WITH {CL}, {TK}, c AS (SELECT task_id, count(*) FILTER (state = 'done') / count(*) AS s FROM cl GROUP BY 1) SELECT task_id, coalesce(floor(s * 100 + 0.5)::INT::VARCHAR || '%', 'n/a') AS shown, coalesce(strftime(created_at, '%Y-%m-%d'), 'n/a') AS day FROM tk LEFT JOIN c USING (task_id)",
}
