import json

import pytest

from attestia.functions import atoms
from attestia.operators import decisions, extraction
from attestia.sources import search


def test_partitions_are_checked():
    text = "1850年，乙国签署甲约，割让丙岛。如果下雨，比赛取消。"
    ok = [("1850年，乙国签署甲约，", ""), ("割让丙岛。", "1850年，乙国"), ("如果下雨，比赛取消。", "")]
    assert [c.normalized for c in atoms.partition(text, ok)] == ["1850年,乙国签署甲约", "1850年,乙国割让丙岛。", "如果下雨,比赛取消。"]
    for bad in (ok[:2], [*ok[:2], ("如果下雨，", ""), ("比赛取消。", "")], [("1850年，", ""), *ok], [(text, "")], [ok[0], ("割让丙岛。", "丁国"), ok[2]], [("乙国", ""), *ok[1:]], [("", "")]):
        with pytest.raises(atoms.PartitionError):
            atoms.partition(text, bad)
    assert atoms.partition("", []) == []


def test_segmenter_falls_back(spark):
    answers = spark.createDataFrame([("a", "乙厂成立于2010年。"), ("b", "乙厂成立于2010年。"), ("c", None), ("d", "乙厂很大。")], "task_id string, input_text string")
    segments = spark.createDataFrame([("a", 1, "乙厂成立于2010年。", None), ("b", 1, "乙厂成立于", None)], "task_id string, ord int, source string, context string")
    got = {r.task_id: (r.method, [c.normalized for c in r.claims]) for r in extraction.segmented(answers, segments).collect()}
    assert got == {"a": ("model", ["乙厂成立于2010年。"]), "b": ("rules_fallback", ["乙厂成立于2010年。"]), "c": ("rules", []), "d": ("rules", ["乙厂很大。"])}


def test_answers_of_a_judge(spark):
    one = {"decisions": [{"evidence_id": "e", "relation": "supports", "excerpt": "x", "alignment": {"entity": "match", "predicate": "match", "scope": "match", "value": "match"}}]}
    body = lambda content, finish="stop", **m: json.dumps({"choices": [{"finish_reason": finish, "message": {"content": content, **m}}]})
    text = json.dumps(one)
    rows = [
        ("ok", body(text)), ("fence", body(f"```json\n{text}\n```")), ("prose", body(f"Sure: {text}")), ("cut", body(text, "length")), ("filter", body(text, "content_filter")), ("refused", body(text, refusal="no")), ("empty", body(" ")),
        ("odd", body(text.replace("supports", "maybe"))), ("many", body(json.dumps({"decisions": one["decisions"] * 6}))), ("none", "not json"), ("null", None), ("shape", body("{}")),
    ]
    got = decisions.parsed(spark.createDataFrame(rows, "claim_id string, body string"))
    assert {r.claim_id: r.code for r in got.collect()} == {
        "ok": None, "fence": None, "prose": "LLM_JSON", "cut": "LLM_TRUNCATED", "filter": "LLM_CONTENT_FILTER", "refused": "LLM_CONTENT_FILTER", "empty": "LLM_EMPTY", "odd": "LLM_SCHEMA", "many": "LLM_SCHEMA", "none": "LLM_RESPONSE", "null": "LLM_RESPONSE", "shape": "LLM_SCHEMA"}
    assert {(r.claim_id, r.evidence_id, r.alignment.value) for r in decisions.decisions_of(got).collect()} == {("ok", "e", "match"), ("fence", "e", "match")}


def test_web_search_filters_sites(spark):
    pages = spark.createDataFrame([("old mill", 1, "https://a.org/1", "t", "s", None, None, 0.5), ("old mill", 2, "https://x.edu.cn/2", "t", "s", "whole", "2020", None), ("old mill", 3, " ", "t", "s", None, None, None)], "query string, ord int, url string, title string, snippet string, raw_content string, published_at string, score double")
    asked = spark.createDataFrame([("q", "Old  mill"), ("s", "old mill (site:edu.cn OR site:b.org)"), ("n", " ")], "query_id string, query string")
    got = {(r.query_id, r.ord): (r.content, r.metadata) for r in search.web_search(asked, pages).collect()}
    assert got == {("q", 1): ("s", {"provider_score": "0.5", "content_kind": "search_snippet"}), ("q", 2): ("whole", {"content_kind": "raw_text"}), ("s", 2): ("whole", {"content_kind": "raw_text"})}
