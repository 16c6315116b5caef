"""Queries on review events, evaluation and task outcomes, with their SQL."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attestia.operators import evaluation as E
from attestia.operators import review as R
from attestia.session import table

from .judging import CL, TK, VERDICT, _claims, _tasks, claim_verdicts


def _operations(spark, d):
    """One operation a task with claims: every first claim is deleted by the task's newest reviewer."""
    first = _claims(spark, d).groupBy("task_id").agg(F.min_by("claim_id", F.struct("char_start", "claim_id")).alias("c"))
    return first.select(F.concat(F.lit("op_"), "task_id").alias("op_id"), "task_id", F.lit("delete").alias("action"), F.lit("reviewer").alias("reviewer"), F.array("c").alias("claim_ids"), F.lit(None).cast(R.SPANS).alias("spans"))


def review_applied(spark, d):
    """Claims left after the first of each finished task was deleted in review."""
    events = R.reviewed(_tasks(spark, d), _claims(spark, d), _operations(spark, d), limit=1_000_000)
    return R.applied(_claims(spark, d), events).select("claim_id", "task_id", "char_start", "state", "label")


def review_codes(spark, d):
    """What became of each of these operations."""
    events = R.reviewed(_tasks(spark, d), _claims(spark, d), _operations(spark, d), limit=1_000_000)
    return events.select("task_id", F.coalesce("error", F.lit("OK")).alias("code"), F.size("after").alias("left"))


def undo(spark, d):
    """Whether each of these operations can be undone at once, and whether the snapshot is the stored state."""
    before = _claims(spark, d)
    events = R.reviewed(_tasks(spark, d), before, _operations(spark, d), limit=1_000_000).filter("error IS NULL")
    log = events.select(F.col("op_id").alias("event_id"), "task_id", F.lit(1).alias("seq"), "before_claims", "after_claims", F.lit(None).cast("timestamp").alias("undone_at"))
    wanted = events.select("task_id", F.col("op_id").alias("event_id"), "reviewer")
    return R.undo_codes(_tasks(spark, d), R.applied(before, events), log, wanted).select("task_id", F.coalesce("error", F.lit("OK")).alias("code"), F.json_array_length("restored").alias("restored"))


def _rows(spark, d):
    """Claims as evaluation rows: stored label as gold, recomputed one as prediction, the task's time and checks."""
    t = _tasks(spark, d)
    took = F.unix_micros(F.col("updated_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))
    checks = F.create_map(F.lit("ended"), F.coalesce(F.col("status").isin("succeeded", "partial"), F.lit(False)), F.lit("not_cut"), ~F.coalesce("truncated", F.lit(False)))
    t = t.select("task_id", (took / 1000.0).alias("elapsed_ms"), checks.alias("functional_checks"), F.when(F.col("segmentation_method") == "model", "human").otherwise("synthetic").alias("source"))
    got = claim_verdicts(spark, d).select("claim_id", F.col("label").alias("predicted"))
    return _claims(spark, d).select("claim_id", "task_id", F.col("label").alias("expected")).join(got, "claim_id").join(t, "task_id", "left")


def evaluation_metrics(spark, d):
    c = E.classification(_rows(spark, d))
    return c.select(*[F.round(x, 6).alias(x) if x in ("accuracy", "abstention_rate") else x for x in c.columns])


def evaluation_checks(spark, d):
    return E.functional(_rows(spark, d))


def evaluation_quality(spark, d):
    q = E.quality(_rows(spark, d))
    return q.withColumn("human_accuracy", F.round("human_accuracy", 6))


def evaluation_timing(spark, d):
    return E.timing(_rows(spark, d)).select("samples", F.round("total_ms", 0).alias("total_ms"), F.round("mean_ms", 2).alias("mean_ms"))


def evaluation_report(spark, d):
    return E.report(_rows(spark, d)).select(F.length("json").alias("json"), "markdown")


def gold_faults(spark, d):
    """Evidence claims against claims by id: repeated, unknown and missing keys."""
    cases = table(spark, d, "claims").select(F.col("claim_id").alias("case_id"))
    return E.faults(cases, table(spark, d, "search_results").select(F.col("claim_id").alias("case_id"), F.col("publisher").alias("label")), "label")


def mapped_predictions(spark, d):
    """Claims mapped to the cases that tasks pose, by unique text."""
    t = _tasks(spark, d).filter("input_text IS NOT NULL")
    cases = t.select(F.col("task_id").alias("case_id"), F.trim("input_text").alias("input_text"), F.lit(None).cast("string").alias("target_claim"))
    claims = _claims(spark, d).select("claim_id", F.lit(None).cast("string").alias("case_id"), "label", "normalized_claim", "source_text")
    return E.mapped(cases, claims)


def terminal_status(spark, d):
    """How each task ends by its claims: failed without any, partial where it was cut or something failed, else succeeded."""
    c = _claims(spark, d).groupBy("task_id").agg(F.count("*").alias("n"), F.bool_or(F.coalesce(F.col("state").isin("failed", "unchecked"), F.lit(False))).alias("bad"))
    j = _tasks(spark, d).join(c, "task_id", "left")
    failures = F.coalesce(F.size("failed_providers"), F.lit(0)) > 0
    status = F.when(F.coalesce("n", F.lit(0)) == 0, F.when(failures, "failed").otherwise("succeeded")).when(F.coalesce("truncated", F.lit(False)) | failures | F.col("bad"), "partial").otherwise("succeeded")
    return j.select("task_id", status.alias("ends_as"))


def progress(spark, d):
    """Risky claims and the share processed of each task, in percent."""
    c = _claims(spark, d).groupBy("task_id").agg(F.count("*").alias("n"), F.count_if(F.col("label").isin("incorrect", "disputed")).alias("risky"), F.count_if(F.col("state") == "done").alias("done"))
    return c.select("task_id", "risky", F.least(F.lit(100), F.floor(F.col("done") * 100 / F.col("n") + 0.5)).cast("int").alias("percent"))


def queue_preview(spark, d):
    """Four claims of each task as they are shown while it runs: the last done, the active, the waiting, then earlier done ones from the last."""
    active, done = F.col("state").isin("retrieving", "judging"), F.coalesce(F.col("state") == "done", F.lit(False))
    c = _claims(spark, d).withColumn("done_no", F.when(done, F.row_number().over(Window.partitionBy("task_id", done).orderBy(F.col("char_start").desc(), F.col("claim_id").desc()))))
    tier = F.when(F.col("done_no") == 1, 0).when(F.coalesce(active, F.lit(False)), 1).when(~done, 2).otherwise(3)
    w = Window.partitionBy("task_id").orderBy(tier, F.when(F.col("done_no").isNull(), F.col("char_start")), "done_no", "claim_id")
    return c.select("task_id", "claim_id", F.row_number().over(w).alias("place")).filter("place <= 4")


def retry_codes(spark, d):
    """Whether each claim may be tried again."""
    return R.retry_codes(_tasks(spark, d), _claims(spark, d), _claims(spark, d)).select("claim_id", F.coalesce("error", F.lit("OK")).alias("code"))


QUERIES = {f.__name__: f for f in (retry_codes, review_applied, review_codes, undo, evaluation_metrics, evaluation_checks, evaluation_quality, evaluation_timing, evaluation_report, gold_faults, mapped_predictions, terminal_status, progress, queue_preview)}
_F4 = "('credible', 'incorrect', 'disputed', 'evidence_insufficient')"
_OPS = f"{CL}, {TK}, f AS (SELECT task_id, first(claim_id ORDER BY char_start NULLS FIRST, claim_id) AS c, count(*) AS n FROM cl GROUP BY 1), o AS (SELECT f.task_id, c, n, CASE WHEN status IS NULL THEN 'NOT_FOUND' WHEN status IN ('created', 'running') THEN 'TASK_BUSY' ELSE 'OK' END AS code FROM f LEFT JOIN tk USING (task_id))"
_ROWS = f"{VERDICT}, {TK}, r AS (SELECT c.claim_id, c.label AS expected, v.label AS predicted, t.status, t.truncated, CASE WHEN t.task_id IS NULL THEN NULL WHEN t.segmentation_method = 'model' THEN 'human' ELSE 'synthetic' END AS source, t.task_id AS tid, (epoch_us(t.updated_at) - epoch_us(t.created_at)) / 1000.0::DOUBLE AS ms FROM cl c JOIN v USING (claim_id) LEFT JOIN tk t ON c.task_id = t.task_id)"
SQL = {
    "retry_codes": f"""WITH {CL}, {TK} SELECT claim_id, CASE WHEN tk.status IS NULL THEN 'NOT_FOUND' WHEN tk.status IN ('created', 'running') THEN 'TASK_BUSY' WHEN coalesce(retry_count, 0) >= 2 THEN 'RETRY_LIMIT'
 WHEN coalesce(state = 'failed', false) OR coalesce(label = 'evidence_insufficient', false) OR coalesce(len(retrieval_warnings) > 0, false) OR coalesce(manually_edited AND state = 'unchecked', false) OR coalesce(state = 'unchecked' AND unchecked_reason = 'task_budget', false) THEN 'OK' ELSE 'RETRY_NOT_ALLOWED' END AS code FROM cl LEFT JOIN tk USING (task_id)""",
    "review_applied": f"WITH {_OPS} SELECT claim_id, cl.task_id, char_start, state, label FROM cl LEFT JOIN o USING (task_id) WHERE NOT coalesce(code = 'OK' AND claim_id = c, false)",
    "review_codes": f"WITH {_OPS} SELECT task_id, code, (n - CASE code WHEN 'OK' THEN 1 ELSE 0 END)::INT AS left FROM o",
    "undo": f"WITH {_OPS} SELECT task_id, 'OK' AS code, n::INT AS restored FROM o WHERE code = 'OK'",
    "evaluation_metrics": f"""WITH {_ROWS}, e AS (SELECT *, CASE WHEN predicted IN {_F4} THEN predicted ELSE 'unknown' END AS p FROM r WHERE expected IN {_F4})
SELECT count(*) AS denominator, count(*) FILTER (p = expected) AS correct, round(count(*) FILTER (p = expected) / nullif(count(*), 0), 6) AS accuracy, count(*) FILTER (p IN ('evidence_insufficient', 'unknown')) AS abstentions, round(count(*) FILTER (p IN ('evidence_insufficient', 'unknown')) / nullif(count(*), 0), 6) AS abstention_rate,
 count(*) FILTER (predicted IS NOT NULL AND predicted NOT IN {_F4} AND predicted <> 'not_applicable') AS invalid_outputs, count(*) FILTER (expected = 'evidence_insufficient' AND predicted = 'incorrect') AS insufficient_as_incorrect FROM e""",
    "evaluation_checks": f"WITH {_ROWS}, c AS (SELECT unnest([{{'k': 'ended', 'ok': coalesce(status IN ('succeeded', 'partial'), false)}}, {{'k': 'not_cut', 'ok': NOT coalesce(truncated, false)}}]) AS c FROM r WHERE tid IS NOT NULL) SELECT c.k AS check, count(*) FILTER (c.ok) AS passed, count(*) FILTER (NOT c.ok) AS failed FROM c GROUP BY 1",
    "evaluation_quality": f"WITH {_ROWS}, sq AS (SELECT *, coalesce(source, 'synthetic') AS so FROM r) SELECT count(*) FILTER (so = 'human') AS human, 0::BIGINT AS public_seed, count(*) FILTER (so = 'synthetic') AS synthetic, count(*) FILTER (so = 'human' AND expected IN {_F4}) AS human_denominator, count(*) FILTER (so = 'human' AND expected IN {_F4} AND predicted = expected) AS human_correct, round(count(*) FILTER (so = 'human' AND expected IN {_F4} AND predicted = expected) / nullif(count(*) FILTER (so = 'human' AND expected IN {_F4}), 0), 6) AS human_accuracy FROM sq",
    "evaluation_timing": f"WITH {_ROWS} SELECT count(ms) AS samples, round(sum(ms), 0) AS total_ms, round(avg(ms), 2) AS mean_ms FROM r",
    "gold_faults": "WITH k AS (SELECT DISTINCT claim_id AS case_id FROM claims), g AS (SELECT claim_id AS case_id, count(*) AS n FROM search_results GROUP BY 1), b AS (SELECT coalesce(k.case_id, g.case_id) AS case_id, k.case_id IS NOT NULL AS known, n FROM k FULL JOIN g ON k.case_id = g.case_id), f AS (SELECT case_id, unnest([CASE WHEN coalesce(trim(case_id), '') = '' THEN 'blank' END, CASE WHEN coalesce(trim(case_id), '') <> '' AND n > 1 THEN 'repeated' END, CASE WHEN coalesce(trim(case_id), '') <> '' AND NOT known THEN 'unknown' END, CASE WHEN n IS NULL THEN 'missing' END]) AS fault FROM b) SELECT * FROM f WHERE fault IS NOT NULL",
    "mapped_predictions": f"WITH {CL}, {TK}, k AS (SELECT DISTINCT task_id AS case_id, trim(input_text, ' ') AS t FROM tk WHERE input_text IS NOT NULL), s AS (SELECT DISTINCT claim_id, label, unnest([normalized_claim, source_text]) AS t FROM cl), h AS (SELECT claim_id, label, count(DISTINCT case_id) AS matches, min(case_id) AS one FROM s JOIN k USING (t) GROUP BY 1, 2) SELECT claim_id, CASE WHEN matches = 1 THEN one END AS case_id, label, matches FROM h",
    "terminal_status": f"WITH {CL}, {TK}, a AS (SELECT task_id, count(*) AS n, bool_or(coalesce(state IN ('failed', 'unchecked'), false)) AS bad FROM cl GROUP BY 1) SELECT task_id, CASE WHEN coalesce(n, 0) = 0 THEN CASE WHEN coalesce(len(failed_providers), 0) > 0 THEN 'failed' ELSE 'succeeded' END WHEN coalesce(truncated, false) OR coalesce(len(failed_providers), 0) > 0 OR bad THEN 'partial' ELSE 'succeeded' END AS ends_as FROM tk LEFT JOIN a USING (task_id)",
    "progress": f"WITH {CL} SELECT task_id, count(*) FILTER (label IN ('incorrect', 'disputed')) AS risky, least(100, floor(count(*) FILTER (state = 'done') * 100.0 / count(*) + 0.5))::INT AS percent FROM cl GROUP BY 1",
    "queue_preview": f"WITH {CL}, n AS (SELECT *, CASE WHEN state = 'done' THEN row_number() OVER (PARTITION BY task_id, coalesce(state = 'done', false) ORDER BY char_start DESC NULLS LAST, claim_id DESC) END AS dn FROM cl), t AS (SELECT task_id, claim_id, row_number() OVER (PARTITION BY task_id ORDER BY CASE WHEN dn = 1 THEN 0 WHEN state IN ('retrieving', 'judging') THEN 1 WHEN dn IS NULL THEN 2 ELSE 3 END, CASE WHEN dn IS NULL THEN char_start END NULLS FIRST, dn NULLS FIRST, claim_id)::INT AS place FROM n) SELECT * FROM t WHERE place <= 4",
}
