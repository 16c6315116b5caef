"""Review of claims as events: each operation gives the task's new claims and an event that can be undone.

Claims: claim_id, task_id, char_start, char_end, source_text, normalized_claim, state and what a check left behind.
Operations, at most one a task and call: op_id, task_id, action (edit, delete, add, split, merge), reviewer,
claim_ids array<string>, and spans array<struct<char_start:int,char_end:int,normalized_claim:string>> for add and split
(edit: one span, of which only the text counts). Snapshots are JSON of the task's claims in order.

Defined results: a faulty operation changes nothing and gives an event with its code; tasks without an operation pass
through; ranges are UTF-16 units of the stripped input.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestia.functions.text import utf16_length, utf16_slice

MOST_CLAIMS = 15
SPANS = "array<struct<char_start:int,char_end:int,normalized_claim:string>>"
OPERATIONS = f"op_id string, task_id string, action string, reviewer string, claim_ids array<string>, spans {SPANS}"
KEPT = ("claim_id", "task_id", "char_start", "char_end", "source_text", "normalized_claim", "state", "label", "support_score")
BUSY = ("created", "running")


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def _ordered(claims: Column) -> Column:
    """Claims by place, ties by the longer, then id."""
    return F.array_sort(claims, lambda a, b: F.when(a["char_start"] != b["char_start"], F.signum(a["char_start"] - b["char_start"])).when(a["char_end"] != b["char_end"], F.signum(a["char_end"] - b["char_end"]))
        .otherwise(F.when(a["claim_id"] < b["claim_id"], -1).when(a["claim_id"] > b["claim_id"], 1).otherwise(0)).cast("int"))


def reviewed(tasks: DataFrame, claims: DataFrame, operations: DataFrame, limit: int = MOST_CLAIMS) -> DataFrame:
    """(op_id, task_id, action, reviewer, error, before_claims, after_claims, after): the event of every operation;
    *after* are the task's claims as rows. Touched claims lose label and score and go back to 'unchecked'."""
    kinds = {c: dict(claims.dtypes)[c] for c in KEPT}
    state = claims.groupBy("task_id").agg(_ordered(F.collect_list(F.struct(*KEPT))).alias("before"))
    o = operations.join(tasks.select("task_id", "status", F.trim("input_text").alias("text")), "task_id", "left").join(state, "task_id", "left")
    row_type = "struct<" + ",".join(f"{c}:{t}" for c, t in kinds.items()) + ">"
    o = o.withColumn("before", F.coalesce("before", F.array().cast(f"array<{row_type}>"))).withColumn("spans", F.coalesce("spans", F.array().cast(SPANS))).withColumn("claim_ids", F.array_distinct(F.coalesce("claim_ids", F.array().cast("array<string>"))))
    picked = F.filter("before", lambda c: F.array_contains(F.col("claim_ids"), c["claim_id"]))
    o = o.withColumn("picked", picked)
    act = lambda *a: F.col("action").isin(*a)
    inside = lambda s: (s["char_start"] >= 0) & (s["char_end"] > s["char_start"]) & (s["char_end"] <= utf16_length(F.col("text")))
    readable = lambda s: F.coalesce(inside(s) & (F.trim(utf16_slice(F.col("text"), s["char_start"], s["char_end"])) != ""), F.lit(False))
    one = F.get("picked", F.lit(0))
    at = F.transform("picked", lambda p: F.array_position(F.transform("before", lambda b: b["claim_id"]), p["claim_id"]))
    adjacent = F.array_max(at) - F.array_min(at) == F.size("picked") - 1
    parts_fit = F.forall("spans", lambda s: (s["char_start"] >= one["char_start"]) & (s["char_end"] <= one["char_end"])) & F.forall(
        F.sequence(F.lit(1), F.greatest(F.size("spans"), F.lit(1))), lambda i: (i >= F.size("spans")) | (F.get("spans", i - 1)["char_end"] <= F.get("spans", i)["char_start"]))
    need = {"edit": (1, 1), "delete": (1, None), "add": (0, 0), "split": (1, 1), "merge": (2, None)}
    counts = F.lit(False)
    for action, (least, most) in need.items():
        counts = counts | (act(action) & (F.size("claim_ids") >= least) & (F.lit(True) if most is None else F.size("claim_ids") <= most))
    texts = F.forall("spans", lambda s: F.coalesce(F.trim(s["normalized_claim"]), F.lit("")) != "")
    grown = F.size("before") + F.when(act("add"), F.size("spans")).when(act("split"), F.size("spans") - 1).otherwise(0)
    spans_wanted = F.when(act("edit", "add"), F.size("spans") == 1).when(act("split"), F.size("spans") >= 2).otherwise(F.size("spans") == 0)
    error = (
        F.when(F.col("status").isNull(), "NOT_FOUND").when(F.col("status").isin(*BUSY), "TASK_BUSY").when(_blank("reviewer") | ~counts | ~spans_wanted | ~texts, "INVALID_REVIEW")
        .when(F.size("picked") < F.size("claim_ids"), "NOT_FOUND").when(act("add", "split") & ~F.forall("spans", readable), "INVALID_RANGE").when(act("split") & ~parts_fit, "INVALID_RANGE")
        .when(act("merge") & ~adjacent, "INVALID_REVIEW").when(grown > limit, "CLAIM_LIMIT")
    )

    def fresh(start: Column, end: Column, text: Column, name: Column) -> Column:
        values = {"claim_id": name, "task_id": F.col("task_id"), "char_start": start, "char_end": end, "source_text": utf16_slice(F.col("text"), start, end), "normalized_claim": text, "state": F.lit("unchecked"), "label": F.lit(None), "support_score": F.lit(None)}
        return F.struct(*[values[c].cast(kinds[c]).alias(c) for c in KEPT])

    # Ids follow from the operation, so that a recomputed row keeps them.
    name = lambda n: F.concat(F.lit("c_"), F.substring(F.sha2(F.concat_ws("\x00", "op_id", n.cast("string")), 256), 1, 32))
    others = F.filter("before", lambda c: ~F.array_contains(F.col("claim_ids"), c["claim_id"]))
    made = F.transform("spans", lambda s, n: fresh(s["char_start"], s["char_end"], F.trim(s["normalized_claim"]), name(n)))
    edited = F.transform("picked", lambda c: fresh(c["char_start"], c["char_end"], F.trim(F.get("spans", F.lit(0))["normalized_claim"]), c["claim_id"]))
    joined = F.array(fresh(F.array_min(F.transform("picked", lambda c: c["char_start"])), F.array_max(F.transform("picked", lambda c: c["char_end"])), F.array_join(F.transform("picked", lambda c: c["normalized_claim"]), " "), name(F.lit(0))))
    new = F.when(act("edit"), edited).when(act("delete"), F.array().cast(f"array<{row_type}>")).when(act("merge"), joined).otherwise(made)
    o = o.withColumn("error", error).withColumn("after", F.when(F.col("error").isNull(), _ordered(F.concat(others, new))).otherwise(F.col("before")))
    return o.select("op_id", "task_id", "action", "reviewer", "error", F.to_json("before").alias("before_claims"), F.to_json("after").alias("after_claims"), "after")


def applied(claims: DataFrame, events: DataFrame) -> DataFrame:
    """The claims (KEPT) of all tasks after the events of *reviewed* without error."""
    good = events.filter("error IS NULL")
    rest = claims.join(good.select("task_id"), "task_id", "left_anti").select(*KEPT)
    return rest.unionByName(good.select(F.explode("after").alias("c")).select(*[F.col(f"c.{c}") for c in KEPT]))


def history(events: DataFrame) -> DataFrame:
    """Events of each task, newest first, with their place; *seq* orders them."""
    return events.withColumn("place", F.row_number().over(Window.partitionBy("task_id").orderBy(F.col("seq").desc(), F.col("event_id").desc())))


def undo_codes(tasks: DataFrame, claims: DataFrame, events: DataFrame, wanted: DataFrame) -> DataFrame:
    """(task_id, event_id, reviewer, error, restored): whether each wanted undo (task_id, event_id, reviewer) may be done.

    Only the newest event that still stands, and only while the task's claims are those it left; *restored* is then its
    snapshot from before. *events*: event_id, task_id, seq, before_claims, after_claims, undone_at.
    """
    now = claims.groupBy("task_id").agg(F.to_json(_ordered(F.collect_list(F.struct(*KEPT)))).alias("now"))
    newest = events.filter("undone_at IS NULL").groupBy("task_id").agg(F.max_by("event_id", "seq").alias("newest"))
    w = wanted.join(tasks.select("task_id", "status"), "task_id", "left").join(events.select("task_id", "event_id", "before_claims", "after_claims", F.lit(True).alias("known")), ["task_id", "event_id"], "left")
    w = w.join(newest, "task_id", "left").join(now, "task_id", "left")
    error = (
        F.when(_blank("reviewer"), "INVALID_REVIEW").when(F.col("status").isNull(), "NOT_FOUND").when(F.col("status").isin(*BUSY), "TASK_BUSY").when(F.col("known").isNull(), "NOT_FOUND")
        .when(~F.coalesce(F.col("newest") == F.col("event_id"), F.lit(False)), "UNDO_ORDER").when(F.coalesce("now", F.lit("[]")) != F.col("after_claims"), "STATE_CHANGED")
    )
    return w.select("task_id", "event_id", "reviewer", error.alias("error"), F.when(error.isNull(), F.col("before_claims")).alias("restored"))


def retry_codes(tasks: DataFrame, claims: DataFrame, wanted: DataFrame, most: int = 2) -> DataFrame:
    """(claim_id, error): why each wanted retry (claim_id) may not begin, null where it may; the first reason that applies.

    Claims need source_text, normalized_claim, retry_count, retrieval_warnings, manually_edited and unchecked_reason beside KEPT.
    """
    lost = r"^(?:(?:该|这一|这个)学科(?:在|于|以|的|是|为|位列|排名|获得|入选|上榜)|[它他她](?:们)?(?:最终|主要|通常|在|于|的|是|为|位于|成立|创立|出生|毕业|流入|注入|发源|拥有|支持|能|不))"
    unresolved = F.coalesce(F.col("source_text").rlike(lost) & F.col("normalized_claim").rlike(lost), F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False))
    again = (
        yes(F.col("state") == "failed") | yes(F.col("label") == "evidence_insufficient") | yes(F.size("retrieval_warnings") > 0)
        | yes(F.col("manually_edited") & (F.col("state") == "unchecked")) | yes((F.col("state") == "unchecked") & (F.col("unchecked_reason") == "task_budget"))
    )
    w = wanted.select("claim_id").distinct().join(claims.withColumn("_known", F.lit(True)), "claim_id", "left").join(tasks.select("task_id", "status"), "task_id", "left")
    code = (
        F.when(F.col("_known").isNull() | F.col("status").isNull(), "NOT_FOUND").when(F.col("status").isin(*BUSY), "TASK_BUSY").when(unresolved, "RETRY_NOT_ALLOWED")
        .when(F.coalesce("retry_count", F.lit(0)) >= most, "RETRY_LIMIT").when(~again, "RETRY_NOT_ALLOWED")
    )
    return w.select("claim_id", code.alias("error"))
