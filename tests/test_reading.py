from attestia.functions import claims as C
from attestia.operators import extraction as X
from attestia.plans import moving


def test_statements_are_exact_slices():
    t = "😀 2024年，甲公司发布A产品。它说：“好！真的？”Dr. Lee met v2.1.\n# Heading\n- item one; item two\n!!!"
    got = [t[a:b] for a, b in C.statements(t)]
    assert got == ["😀 2024年，甲公司发布A产品。", "它说：“好！真的？”", "Dr. Lee met v2.1.", "- item one;", "item two"]
    assert C.statements("") == C.statements(None) == [] and C.statements("See https://a.example/x.y?z for it. End") == [(0, 35), (36, 39)]


def test_kinds_and_anchors():
    assert C.kind_of("我建议多喝水") == "opinion" and C.kind_of("建议零售价为5元") == "general" and C.kind_of("我认为公司成立于2001年") == "statistic"
    assert C.kind_of("研究表明如此") == "paper_citation"
    assert C.plain("## **Bold** [a](b) Atlas_900 ~5%") == "Bold a Atlas_900 ~5%"
    assert C.conditions("截至2023年，甲公司在北京的人数") and C.named("甲公司发布“天问” Atlas-900") == ["天问", "Atlas-900", "甲公司"]


def test_grounding_and_passages():
    assert C.grounded("20°C", "约20℃，") == "20℃" and C.grounded("a", "b") is None and C.grounded("x y", "xy xy") is None and C.grounded(None, "a") is None and C.grounded("a", None) is None
    body = "Nothing here. The mill closed in 1903. The end. " + "z" * 3000
    assert "mill closed" in C.passage(body, ["mill", "1903"]) and len(C.passage("y" * 5000, [])) <= 1000 and C.passage(None, []) is None


def test_extraction_limit_and_units(spark):
    df = spark.createDataFrame([("a", "  😀好事一。好事二。好事三。", 1), ("b", None, 2), ("c", " ", 3)], "task_id string, t string, number int")
    got = X.extracted(df, "task_id", "t", 2).collect()
    assert [(r.number, r.found, r.char_start, r.char_end) for r in got] == [(1, 3, 0, 6), (2, 3, 6, 10)]


def test_citations(spark):
    want = spark.createDataFrame([(1, "A Study of Mills", ["Ann Lee"], 1999, None), (2, "Other", None, None, None), (3, "None", None, None, None)], "citation_id int, title string, authors array<string>, year int, doi string")
    rec = spark.createDataFrame([(1, 1, "Unlike", None, None, None), (1, 2, "A study of mills.", ["B. Lee"], 1999, "10.1/x"), (2, 1, "Different thing", None, None, None)], "citation_id int, ord int, title string, authors array<string>, year int, doi string")
    assert {r.citation_id: (r.status, r.record_no) for r in X.citation_checks(want, rec).collect()} == {1: ("found", 1), 2: ("not_found", 0), 3: ("uncertain", None)}


def test_readable_results_read_the_whole_content(spark, tmp_path):
    rows = [("r1", "A & B", "First <line> of it.\n\nSecond \\ line."), ("r1", "A & B", "First <line> of it.\n\nSecond \\ line."), ("r2", None, "Only this"), ("r3", "No content", None)]
    spark.createDataFrame(rows, "result_id string, title string, content string").write.parquet(f"{tmp_path}/search_results.parquet")
    got = sorted(tuple(r) for r in moving.readable_results(spark, str(tmp_path)).collect())
    assert got == [("r1", len("A & B\nFirst <line> of it.\nSecond \\ line.")), ("r2", len("Only this"))]
