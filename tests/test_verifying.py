from pyspark.sql import functions as F

from attestia.functions import planning as P
from attestia.operators import admission, evaluation, merging, review


def test_queries_leave_the_answer_out():
    for claim, answer, word in (("丙河最终注入东海。", "东海", "入海口"), ("乙厂成立于2010年。", "2010", "成立时间"), ("太阳从东方升起。", "东", "方向"), ("鲸鱼是鱼类。", "鱼类", "分类")):
        first, *later = P.queries(claim, ())
        assert claim.rstrip("。") in first and any(word in q for q in later) and all(answer not in q for q in later if "site:" not in q), (claim, first, later)
    long = P.queries("甲" * 300 + "。")
    assert 0 < len(long) <= 3 and all(len(q) <= 160 for q in long) and P.queries("") == P.queries(None) == []
    two = P.queries("1850年，乙国签署甲约，割让丙岛。")
    assert len(two) == 3 and "割让" in two[2]
    assert P.bounded(["一二，三四，五六"], 6) == "一二，" and P.bounded(["aaa bbb ccc"], 9) == "aaa bbb"
    assert P.topic_share("水的沸点", "水的沸点 100") == (1.0, 1) and P.topic_share(None, None) == (0.0, 0)
    assert P.usable_text("乙厂创立于1998年", "x", "乙厂成立于2010年。") and not P.usable_text("乙厂很大", "x", "乙厂成立于2010年。")
    assert not P.about_subject("风很大", "声音在水中传播") and P.about_subject("声波很快", "声音在水中传播")


def test_admission_and_ranking(spark):
    claims = spark.createDataFrame([("c", "乙厂成立于2010年。", ["乙厂"], []), ("d", None, None, None)], "claim_id string, normalized_claim string, entities array<string>, conditions array<string>")
    rows = [
        ("c", "https://a.gov.cn/1", "乙厂", "P", "乙厂创立于2010年。它很大。", None, {"content_kind": "raw_text"}), ("c", "https://a.gov.cn/1#x", "乙厂", "P", None, "乙厂成立。", {"content_kind": "search_snippet"}),
        ("c", "https://b.gov.cn/2", "乙厂", "P", "乙厂创立于2010年。它很大。", None, None), ("c", "https://z.org/3", "乙厂之歌 歌词", "P", "乙厂成立于2010年", None, None), ("c", "https://weibo.com/4", "乙厂", "P", "乙厂成立于2010年", None, None),
        ("c", "https://q.org/5", "乙厂", "P", "无关的内容", None, None), ("c", "ftp://q.org/6", "乙厂", "P", "乙厂成立", None, None), ("d", "https://q.org/7", None, None, "x", None, None), (None, None, None, None, None, None, None), ("c", "https://other.org/8", "乙厂", "P", "", "乙厂的成立", None),
    ]
    results = spark.createDataFrame(rows, "claim_id string, url string, title string, publisher string, content string, snippet string, metadata map<string,string>")
    found = admission.admitted(results, claims)
    got = {r.url: r for r in found.collect()}
    assert set(got) == {"https://a.gov.cn/1", "https://b.gov.cn/2", "https://other.org/8"} and got["https://a.gov.cn/1"].form == "body"
    ranked = {r.url: (r.cluster_id, r.place) for r in admission.ranked(found).collect()}
    # One text on two sites is one cluster; its second page comes last.
    assert ranked == {"https://a.gov.cn/1": ("ec_0001", 1), "https://other.org/8": ("ec_0002", 2), "https://b.gov.cn/2": ("ec_0001", 3)}


def test_merging_gives_uploads_no_vote(spark):
    rows = [
        ("c", "w1", "k1", 1, "web", "https://a.org/1", "alpha text", "h1", 0.5), ("c", "w2", "k2", 2, "web", "https://b.org/1", "beta text", "h2", 0.5), ("c", "w3", "k3", 3, "web", "https://www.a.org/2", "gamma text", None, 0.5),
        ("c", "u1", "u1", 4, "knowledge", None, "beta text", None, 0.55), ("c", "u2", "u2", 5, "knowledge", "https://b.org/9", "delta", None, 0.55), ("c", "u3", "u3", 6, "knowledge", None, None, "h1", 0.55), ("c", "w4", "k4", 7, "web", "https://b.org/1", "beta text", "h2", 0.5),
    ]
    e = spark.createDataFrame(rows, "claim_id string, evidence_id string, cluster_id string, ord int, source_type string, url string, excerpt string, content_hash string, authority double")
    groups = {r.evidence_id: (r.group_no, r.position) for r in merging.grouped(e).collect()}
    assert groups["u2"] == (0, 1) and groups["w1"][0] == groups["w3"][0] == groups["u3"][0] and groups["w2"][0] == groups["u1"][0] == groups["w4"][0] and groups["u1"][1] > groups["w2"][1]
    none = spark.createDataFrame([], "claim_id string, part_id int, part_text string")
    got = {r.slot: r.evidence_id for r in merging.merged(e, none, 4).collect()}
    assert len(got) == 4 and got[1] == "u2" and {got[2], got[3]} <= {"w1", "w2", "w3", "w4"} and merging.merged(e.limit(0), none).count() == 0


def test_review_operations_and_undo(spark):
    tasks = spark.createDataFrame([("t", "succeeded", "好事一。好事二。😀好事三。"), ("b", "running", "x"), ("e", "partial", None)], "task_id string, status string, input_text string")
    kinds = "claim_id string, task_id string, char_start int, char_end int, source_text string, normalized_claim string, state string, label string, support_score int"
    claims = spark.createDataFrame([("c1", "t", 0, 4, "好事一。", "好事一", "done", "credible", 90), ("c2", "t", 4, 8, "好事二。", "好事二", "done", None, None), ("c3", "t", 8, 14, "😀好事三。", "好事三", "done", None, None), ("x", "b", 0, 1, "x", "x", "done", None, None)], kinds)

    def run(action, ids, spans=None, task="t", reviewer="r", limit=15):
        ops = spark.createDataFrame([("o", task, action, reviewer, ids, spans)], review.OPERATIONS)
        return review.reviewed(tasks, claims, ops, limit)

    code = lambda *a, **k: run(*a, **k).first().error
    assert code("merge", ["c1", "c3"]) == "INVALID_REVIEW" and code("delete", ["x"], task="b") == "TASK_BUSY" and code("delete", ["c1"], task="?") == "NOT_FOUND" and code("delete", ["zz"]) == "NOT_FOUND" and code("delete", ["c1"], reviewer=" ") == "INVALID_REVIEW"
    assert code("add", [], [(8, 9, "half")]) == "INVALID_RANGE" and code("add", [], [(0, 99, "far")]) == "INVALID_RANGE" and code("add", [], [(0, 2, "n")], limit=3) == "CLAIM_LIMIT" and code("split", ["c1"], [(0, 2, "a"), (1, 3, "b")]) == "INVALID_RANGE" and code("edit", ["c1"], [(0, 0, " ")]) == "INVALID_REVIEW"
    after = lambda *a: [(c.char_start, c.char_end, c.normalized_claim, c.state, c.label) for c in run(*a).first().after]
    assert after("merge", ["c1", "c2"])[0] == (0, 8, "好事一 好事二", "unchecked", None) and after("split", ["c3"], [(8, 12, "a"), (12, 14, "b")])[2:] == [(8, 12, "a", "unchecked", None), (12, 14, "b", "unchecked", None)]
    assert after("edit", ["c1"], [(0, 0, "新")])[0] == (0, 4, "新", "unchecked", None) and len(after("delete", ["c1", "c2"])) == 1 and code("add", [], [(0, 2, "n")], task="e") == "INVALID_RANGE"
    done = run("delete", ["c1"])
    left = review.applied(claims, done)
    assert {r.claim_id for r in left.collect()} == {"c2", "c3", "x"}
    log = done.select(F.col("op_id").alias("event_id"), "task_id", F.lit(1).alias("seq"), "before_claims", "after_claims", F.lit(None).cast("timestamp").alias("undone_at"))
    wanted = spark.createDataFrame([("t", "o", "r"), ("t", "p", "r"), ("t", "o", "")], "task_id string, event_id string, reviewer string")
    got = [(r.event_id, r.reviewer, r.error) for r in review.undo_codes(tasks, left, log, wanted).collect()]
    assert sorted(got) == [("o", "", "INVALID_REVIEW"), ("o", "r", None), ("p", "r", "NOT_FOUND")]
    assert review.undo_codes(tasks, claims, log, wanted.limit(1)).first().error == "STATE_CHANGED"
    newer = log.unionByName(log.withColumn("event_id", F.lit("q")).withColumn("seq", F.lit(2)))
    assert review.undo_codes(tasks, left, newer, wanted.limit(1)).first().error == "UNDO_ORDER" and [r.event_id for r in review.history(newer).orderBy("place").collect()] == ["q", "o"]


def test_evaluation_faults_and_report(spark):
    cases = spark.createDataFrame([("a", "text a", None), ("b", "text b", "target b"), ("c", "text c", None), ("d", "text c", None)], "case_id string, input_text string, target_claim string")
    gold = spark.createDataFrame([("a", "credible"), ("a", "credible"), ("x", "odd"), ("", "credible"), ("b", None)], "case_id string, label string")
    assert {(r.case_id, r.fault) for r in evaluation.faults(cases, gold, "label", evaluation.LABELS).collect()} == {("a", "repeated"), ("x", "unknown"), ("x", "label"), ("", "blank"), ("b", "label"), ("c", "missing"), ("d", "missing")}
    claims = spark.createDataFrame([("1", None, "l", "target b", None), ("2", "a", "l", None, None), ("3", None, "l", "text c", "x"), ("4", None, "l", "none", None)], "claim_id string, case_id string, label string, normalized_claim string, source_text string")
    assert {(r.claim_id, r.case_id, r.matches) for r in evaluation.mapped(cases, claims).collect()} == {("1", "b", 1), ("2", "a", 1), ("3", None, 2)}
    rows = [("credible", "credible", "human", 1.5, {"x": True}), ("incorrect", "nonsense", "synthetic", None, {"x": False, "y": None}), ("evidence_insufficient", "incorrect", None, 2.5, None), ("not_applicable", "not_applicable", "human", None, None), ("disputed", None, "curated_public_fact_seed", None, None)]
    df = spark.createDataFrame(rows, "expected string, predicted string, source string, elapsed_ms double, functional_checks map<string,boolean>")
    c = evaluation.classification(df).first()
    assert (c.denominator, c.correct, c.abstentions, c.invalid_outputs, c.insufficient_as_incorrect) == (4, 1, 2, 1, 1)
    assert {(r.check, r.passed, r.failed) for r in evaluation.functional(df).collect()} == {("x", 1, 1), ("y", 0, 1)} and evaluation.quality(df).first()[:] == (2, 1, 2, 1, 1, 1.0) and evaluation.timing(df).first()[:] == (2, 4.0, 2.0)
    r = evaluation.report(df).first()
    assert "- agreement: 1/4 (25.0%)" in r.markdown and "| credible | 1 | 0 | 0 | 0 | 0 |" in r.markdown and '"matrix"' in r.json and evaluation.report(df.limit(0)).count() == 1
    noted = spark.createDataFrame([("human", "credible", None), ("synthetic", None, None), ("odd", "credible", ("d", "b", "a", "r"))], "source string, label string, annotation struct<checked_at:string,label_basis:string,annotator:string,reviewer:string>")
    assert [r.errors for r in evaluation.annotation_errors(noted).collect()] == [["checked_at", "label_basis", "annotator", "reviewer"], [], ["source"]]
