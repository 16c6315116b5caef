import pytest

from attestia.functions import alignment as A
from attestia.functions import atoms

SUPPORTED = [
    ("乙厂成立于2010年。", "乙厂创立于2010年5月8日。"), ("乙厂位于上海。", "乙厂位于上海市。"), ("乙厂研发投入为0.5亿元。", "乙厂研发支出为5000万元。"), ("2024年乙厂研发投入为1亿元。", "2024年，乙厂研发投入为10000万元。"),
    ("水的沸点是100摄氏度。", "水的沸点是100℃。"), ("列车速度是36km/h。", "列车速度是10米/秒。"), ("在标准大气压下，水的沸点是100摄氏度。", "在1个标准大气压下，水的沸点是100摄氏度。"),
]
VETOED = [
    ("乙厂研发投入为100亿元。", "新乙厂研发投入为100亿元。", None, "figure_not_bound"), ("乙厂研发投入为100亿元。", "乙厂研发投入为10亿元，营收为100亿元。", "营收为100亿元", "figure_not_quoted"),
    ("2024年乙厂研发投入为100亿元。", "2023年乙厂研发投入为100亿元。", None, "period"), ("乙厂因为创新而获奖。", "乙厂进行了创新并获奖。", None, "no_cause"), ("所有设备支持中文。", "部分设备支持中文。", None, "only_some"),
    ("乙厂位于上海。", "据称乙厂位于上海。", None, "extra_qualifier"), ("乙厂位于上海。", "乙厂不在上海。", None, "polarity"), ("如果下雨，比赛取消。", "比赛取消。", None, "condition_missing"), ("设备质量是1kg。", "设备质量是1km。", None, "value_missing"),
]
NOT_REFUTED = [("乙厂成立于2010年。", "乙厂成立于2010年5月。", "claim_repeated"), ("乙厂位于上海。", "乙厂坐落于上海市西区。", "same_answer"), ("乙厂研发投入为1亿元。", "乙厂研发投入为10000万元。", "figure_value_equal"), ("乙厂研发投入为100亿元。", "乙厂研发投入为90亿美元。", "value_not_comparable"), ("Oslo is in Norway.", "Oslo is in Norway.", "claim_repeated")]
REFUTED = [("乙厂成立于2010年。", "乙厂成立于1998年。"), ("乙厂位于上海。", "乙厂位于北京，而非上海。"), ("乙厂研发投入为100亿元。", "乙厂研发投入为90亿元。"), ("设备质量不是1kg。", "设备质量是1000克。")]


def test_vetoes():
    for part, text in SUPPORTED:
        assert A.problem(part, text, text, "supports") is None, (part, text)
    for part, text, quote, code in VETOED:
        assert A.problem(part, text, quote or text, "supports") == code, (part, text)
    for part, text, code in NOT_REFUTED:
        assert A.problem(part, text, text, "refutes") == code, (part, text)
    for part, text in REFUTED:
        assert A.problem(part, text, text, "refutes") is None, (part, text)
    # Every place of a repeated quote must pass.
    assert A.problem("乙厂位于上海。", "乙厂位于上海。丙厂位于上海。", "位于上海", "supports") == "property_not_bound"
    assert A.problem("a", "b", "c", "supports") == A.problem(None, None, None, "supports") == "place_unclear"
    assert A.literal_support("乙厂位于上海。", "乙厂位于上海。", "乙厂位于上海。") and A.explicit_denial("乙厂位于上海。", "乙厂位于北京，而非上海。", "乙厂位于北京，而非上海。")


@pytest.mark.parametrize("off", ["entity", "predicate", "scope", "value"])
def test_every_dimension_must_be_confirmed(off):
    for relation, value in (("supports", "match"), ("refutes", "conflict")):
        text = "声音能在水中传播。" if relation == "supports" else "声音不能在水中传播。"
        whole = {"entity": "match", "predicate": "match", "scope": "match", "value": value}
        assert A.checked(relation, text, text, "声音能在水中传播。", whole) == (relation, None)
        assert A.checked(relation, text, text, "声音能在水中传播。", whole | {off: "unknown"})[0] == "unknown"
    assert A.checked("supports", "x", "y", "x", None) == ("unknown", "quote_not_found") and A.checked("irrelevant", None, "", "", None) == ("irrelevant", None)


def test_decisions_meet_items(spark):
    from attestia.operators import decisions as D

    body = "乙厂成立于2010年。乙厂位于北京，而非上海。"
    ok = {"entity": "match", "predicate": "match", "scope": "match", "value": "match"}
    ev = spark.createDataFrame(
        [(f"e{i}", "c", body, "supports", [], 0.9, 0.5, i) for i in range(5)] + [("e9", "d", None, "supports", None, None, None, 9)],
        "evidence_id string, claim_id string, excerpt string, relation string, checks array<struct<part_id:int,part_text:string,relation:string,excerpt:string>>, relevance double, time_fit double, _d int")
    first, second = "乙厂成立于2010年。", "乙厂位于北京，而非上海。"
    given = [
        ("c", "e0", "supports", body, [(1, "supports", first, ok), (2, "refutes", second, ok | {"value": "conflict"})], None), ("c", "e1", "supports", body, [(1, "supports", first, ok)], None),
        ("c", "e2", "supports", body, [(1, "supports", first, ok), (1, "supports", first, ok)], None), ("c", "e3", "supports", body, None, ok), ("c", "e3", "refutes", body, None, ok), ("c", "none", "supports", body, None, ok), ("d", "e9", "supports", "x", None, ok),
    ]
    claims = spark.createDataFrame([("c", "乙厂成立于2010年，它位于上海。"), ("d", "x")], "claim_id string, normalized_claim string")
    from attestia.operators.extraction import parts_of_claims

    got = {r.evidence_id: r for r in D.apply_decisions(ev.drop("_d"), spark.createDataFrame(given, D.DECISIONS), claims, parts_of_claims(claims)).collect()}
    assert {k: (r.relation, r.decision_note) for k, r in got.items()} == {
        "e0": ("refutes", None), "e1": ("partially_supports", None), "e2": ("unknown", "part_ids"), "e3": ("unknown", "decided_twice"), "e4": ("unknown", "no_decision"), "e9": ("unknown", "quote_not_found")}
    assert got["e0"].relevance == got["e1"].relevance == 0.9 and got["e4"].relevance == got["e4"].time_fit == 0 and [c.relation for c in got["e0"].checks] == ["supports", "refutes"]


def test_atomic_claims_and_references():
    forms = lambda t: [c.normalized for c in atoms.atoms(t)]
    assert forms("1850年，乙国签署甲约，割让丙岛，宣布开埠。") == ["1850年,乙国签署甲约", "1850年,乙国割让丙岛", "1850年,乙国宣布开埠。"]
    assert forms("乙厂成立于2010年，总部位于上海。") == ["乙厂成立于2010年", "总部位于上海。"]
    assert forms("丙河发源于西山，它最终注入东海。") == ["丙河发源于西山", "丙河最终注入东海。"]
    assert forms("乙厂因为创新而获奖，它成立于2010年。") == ["乙厂因为创新而获奖", "乙厂成立于2010年。"]
    for whole in ("如果下雨，比赛取消。", "乙厂收购丙厂，它位于上海。", "她说乙厂发布新机，但销量下降。"):
        assert len(atoms.atoms(whole)) == 1
    text = "东方大学入选的学科是化学。该学科在2020年获得第一。\n该学科位列第二。"
    got = atoms.resolved(text, atoms.atoms(text))
    assert got[1].normalized == "东方大学的化学学科在2020年获得第一。" and atoms.unresolved(got[2].source, got[2].normalized) and text[got[1].start : got[1].end] == got[1].source
    assert atoms.judgment_parts("在标准大气压下，水的沸点是90摄氏度。") == ["在标准大气压下，水的沸点是90摄氏度。"] and atoms.coverage_parts("1,234人，a；b") == ["1,234人，", "a；", "b"]
    assert len(atoms.coverage_parts("，".join("abcdefghijk"))) == 8 and atoms.atoms(None) == atoms.judgment_parts(None) == []
    assert atoms.slot_of("2010年乙厂成立于上海。")[:3] == ("乙厂", "2010年", "成立时间") and atoms.slot_of("乙厂，位于上海") is None
    assert atoms.slot_of("丙河注入东海").strength("丙河最终注入东海") == 3
