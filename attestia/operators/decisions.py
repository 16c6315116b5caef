"""Decisions of a judge on evidence, taken over only where the quoted passages bear them.

A judge is any table of decisions (claim_id, evidence_id, relation, excerpt, checks, alignment). Each decision meets
its item by claim and evidence id; ids that are unknown or given twice are void. Everything else is per row.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestia.functions.alignment import checked, explicit_denial, problem
from attestia.functions.claims import grounded

ALIGNMENT = "struct<entity:string,predicate:string,scope:string,value:string>"
DECISIONS = f"claim_id string, evidence_id string, relation string, excerpt string, checks array<struct<part_id:int,relation:string,excerpt:string,alignment:{ALIGNMENT}>>, alignment {ALIGNMENT}"
_CHECKS = "array<struct<part_id:int,part_text:string,relation:string,excerpt:string>>"
_DIRECT = ("supports", "refutes")


def _settle(relation: str, excerpt: str | None, checks: list[dict] | None, alignment: dict | None, text: str, parts: list[str], whole: str) -> tuple[str, list[dict], str | None]:
    """(relation, checks, code) that stand of one decision."""
    excerpt = grounded(excerpt, text)
    if relation in (*_DIRECT, "partially_supports") and not excerpt:
        return "unknown", [], "quote_not_found"
    if checks:
        ids = [c["part_id"] for c in checks]
        if len(set(ids)) < len(ids) or not all(i and 1 <= i <= len(parts) for i in ids):
            return "unknown", [], "part_ids"
        kept, codes = [], []
        for c in checks:
            quote = grounded(c["excerpt"], text)
            stands, code = checked(c["relation"], quote, text, parts[c["part_id"] - 1], c["alignment"], whole)
            kept.append({"part_id": c["part_id"], "part_text": parts[c["part_id"] - 1], "relation": stands, "excerpt": quote if stands in (*_DIRECT, "partially_supports") else None})
            codes += [code] if code else []
        got = [c["relation"] for c in kept]
        if "refutes" in got:
            relation = "refutes"
        elif len(got) == len(parts) and set(got) == {"supports"}:
            relation = "supports"
        else:
            relation = "partially_supports" if {"supports", "partially_supports"} & set(got) else "unknown"
        return relation, kept, codes[0] if codes else None
    if len(parts) == 1:
        relation, code = checked(relation, excerpt, text, parts[0], alignment, whole)
        return relation, [{"part_id": 1, "part_text": parts[0], "relation": relation, "excerpt": excerpt}] if relation in _DIRECT else [], code
    if relation in _DIRECT and not parts:
        return "unknown", [], "no_parts"
    if relation == "supports":
        return "partially_supports", [], "parts_not_covered"
    if relation == "refutes" and not any(explicit_denial(p, text, excerpt or "", whole) for p in parts):
        return "unknown", [], "no_part_denied"
    return relation, [], None


def apply_decisions(evidence: DataFrame, decisions: DataFrame, claims: DataFrame, parts: DataFrame) -> DataFrame:
    """*evidence* with relation, checks, relevance and time_fit as far as the decisions bear them, and *decision_note*.

    *parts*: (claim_id, part_id, part_text). Items without a valid decision become unknown with scores of 0. A
    decision on another claim's item, on no item or given twice changes nothing; repeated evidence rows all change.
    """
    once = decisions.withColumn("_n", F.count("*").over(Window.partitionBy("claim_id", "evidence_id")))
    once = once.dropDuplicates(["claim_id", "evidence_id"]).select("claim_id", "evidence_id", F.struct("relation", "excerpt", "checks", "alignment", "_n").alias("_d"))
    lists = parts.groupBy("claim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("part_id", "part_text"))), lambda p: p["part_text"]).alias("_parts"))
    both = evidence.join(once, ["claim_id", "evidence_id"], "left").join(lists, "claim_id", "left").join(claims.select("claim_id", F.col("normalized_claim").alias("_whole")), "claim_id", "left")
    kept = [c for c in evidence.columns if c not in ("relation", "checks", "relevance", "time_fit")]
    schema = evidence.select(*kept).schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, text, part, whole in zip(*(batch.column(c).to_pylist() for c in ("_d", "excerpt", "_parts", "_whole"))):
                if d is None:
                    rows.append(("unknown", [], "no_decision"))
                elif d["_n"] != 1:
                    rows.append(("unknown", [], "decided_twice"))
                else:
                    rows.append(_settle(d["relation"], d["excerpt"], d["checks"], d["alignment"], text or "", part or [], whole or ""))
            direct = [r in _DIRECT or any(c["relation"] in _DIRECT for c in cs) for r, cs, _ in rows]
            relevance = [0.9 if x else 0.6 if r == "partially_supports" else 0.0 for x, (r, _, _) in zip(direct, rows)]
            fit = [0.5 if r in (*_DIRECT, "partially_supports") else 0.0 for r, _, _ in rows]
            checks = pa.array([cs for _, cs, _ in rows], pa.list_(pa.struct([("part_id", pa.int32()), ("part_text", pa.string()), ("relation", pa.string()), ("excerpt", pa.string())])))
            out = {c: batch.column(c) for c in kept} | {"relation": pa.array([r for r, _, _ in rows], pa.string()), "checks": checks, "relevance": pa.array(relevance, pa.float64()), "time_fit": pa.array(fit, pa.float64()), "decision_note": pa.array([n for _, _, n in rows], pa.string())}
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return both.mapInArrow(run, f"{schema},relation:string,checks:{_CHECKS},relevance:double,time_fit:double,decision_note:string".replace("struct<", "struct<"))


def alignment_problems(quotes: DataFrame) -> DataFrame:
    """*quotes* (part, text, quote, relation, whole, ...) with the column *problem*: the first veto, null where there is none."""
    kept = quotes.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [problem(p or "", t or "", q or "", r, w or "") for p, t, q, r, w in zip(*(batch.column(c).to_pylist() for c in ("part", "text", "quote", "relation", "whole")))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.string())], names=[*kept, "problem"])

    return quotes.mapInArrow(run, quotes.schema.simpleString()[len("struct<") : -1] + ",problem:string")


#: What a judge answers: decisions as JSON, maybe in one Markdown fence.
PAYLOAD = f"decisions array<struct<evidence_id:string,relation:string,excerpt:string,reason:string,checks:array<struct<part_id:int,relation:string,excerpt:string,alignment:{ALIGNMENT}>>,alignment:{ALIGNMENT}>>"
# Relations a decision may have, and why an answer ended early.
RELATIONS = ("supports", "refutes", "partially_supports", "irrelevant", "unknown")
ENDED = {"content_filter": "LLM_CONTENT_FILTER", "length": "LLM_TRUNCATED", "repetition_truncation": "LLM_REPETITION"}


def parsed(responses: DataFrame, most: int = 5) -> DataFrame:
    """(claim_id, code, decisions) of raw answers (claim_id, body): *code* tells why an answer cannot be used, else it is null.

    The envelope is JSON with choices[0].message.content and finish_reason. Nothing is repaired: prose around the JSON, an
    unknown relation, a missing id or more than *most* decisions make the whole answer void.
    """
    at = lambda path: F.get_json_object("body", path)
    content = F.trim(at("$.choices[0].message.content"))
    inner = F.regexp_extract(content, r"(?is)\A```(?:json)?\s*(.*?)\s*```\z", 1)
    r = responses.withColumn("_c", F.when(inner != "", inner).otherwise(content)).withColumn("_p", F.from_json("_c", PAYLOAD, {"mode": "PERMISSIVE"}))
    ended = F.create_map(*[F.lit(x) for k, v in ENDED.items() for x in (k, v)])
    good = F.forall("_p.decisions", lambda d: F.coalesce(d["evidence_id"] != "", F.lit(False)) & F.coalesce(d["relation"].isin(*RELATIONS), F.lit(False)))
    code = (
        F.when(at("$.choices[0].message").isNull(), "LLM_RESPONSE").when(at("$.choices[0].message.refusal").isNotNull(), "LLM_CONTENT_FILTER")
        .when(F.try_element_at(ended, at("$.choices[0].finish_reason")).isNotNull(), F.try_element_at(ended, at("$.choices[0].finish_reason")))
        .when(F.coalesce(content, F.lit("")) == "", "LLM_EMPTY").when(F.get_json_object("_c", "$").isNull(), "LLM_JSON")
        .when(F.col("_p.decisions").isNull() | (F.size("_p.decisions") > most) | ~good, "LLM_SCHEMA")
    )
    return r.select("claim_id", code.alias("code"), F.when(code.isNull(), F.col("_p.decisions")).alias("decisions"))


def decisions_of(answers: DataFrame) -> DataFrame:
    """The decisions of usable answers of *parsed*, as apply_decisions takes them."""
    d = answers.filter("code IS NULL").select("claim_id", F.explode("decisions").alias("d"))
    return d.select("claim_id", "d.evidence_id", "d.relation", "d.excerpt", "d.checks", "d.alignment")
