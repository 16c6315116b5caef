from attestia.engine import Engine
from attestia.functions.register import register


def test_sql_names(spark):
    register(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM statements('😀好。水在100米处。')").collect()] == [(1, "😀好。", 0, 4, "general"), (2, "水在100米处。", 4, 12, "statistic")]
    assert spark.sql("SELECT * FROM amounts('5 km of rope')").first()[:] == ("kilometre", 5.0)
    assert spark.sql("SELECT nfkc('ﬁ') AS a, readable_text('<p>x</p>') AS b, ground_quote('20°C', '20℃') AS c").first()[:] == ("fi", "x", "20℃")


def test_engine(spark, data):
    e = Engine(spark, data)
    assert e.verdicts().count() == e.claims().count() and e.summaries().count() == e.tasks().count()
    assert e.export("markdown").count() == e.export("json").count() > 0
    q = spark.createDataFrame([("q", "harbour archive")], "query_id string, query string")
    assert e.search(q).count() <= 5
    ids = e.documents().select("document_id").limit(2)
    assert e.delete(ids)["kb_documents"].count() == e.documents().count() - 2
    assert e.import_(e.documents().select("document_id", "pages")).count() == 0
    assert e.status().first()["documents"] == e.documents().count()


def test_engine_verifies_reviews_and_searches(spark, data):
    from attestia.engine import Engine
    from attestia.operators import review

    e = Engine(spark, data)
    answers = spark.createDataFrame([("t1", "乙厂成立于2010年。我建议购买。")], "task_id string, input_text string")
    first = e.extract(answers).filter("claim_type <> 'opinion'").first()
    results = spark.createDataFrame([(first.claim_id, "https://a.gov.cn/1", "乙厂", "P", "乙厂创立于1998年。", None, None)], "claim_id string, url string, title string, publisher string, content string, snippet string, metadata map<string,string>")
    claims, evidence, verdicts = e.verify(answers, results)
    assert claims.count() == 2 and [r.excerpt for r in evidence.collect()] == ["乙厂创立于1998年。"] and sorted(r.label for r in verdicts.collect()) == ["evidence_insufficient", "not_applicable"]
    asked = spark.createDataFrame([("q", "harbour mill")], "query_id string, query string")
    vectors = spark.createDataFrame([("q", [1.0] * 64)], "query_id string, q array<double>")
    assert e.search(asked, vectors=vectors, model="lattice-base-64").count() <= 5 and e.listing(limit=3).count() == 3 and e.document("?").count() == 0
    assert e.review(spark.createDataFrame([], review.OPERATIONS)).count() == 0
