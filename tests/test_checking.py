import json

import pytest
from pyspark.sql import functions as F

from attestia.functions import checks as K
from attestia.functions import units
from attestia.operators import library as L
from attestia.streaming import limits


def test_request_errors(spark):
    rows = [("ok", 3), (" 　\n", 3), ("x" * 20_001, 0), (None, None), ("x" * 20_000, 15)]
    got = [r.e for r in spark.createDataFrame(rows, "input_text string, claim_limit int").select(K.task_errors().alias("e")).collect()]
    assert got == [[], ["text_blank"], ["text_long", "claim_limit"], ["text_blank", "claim_limit"], []]
    kinds = "title string, publisher string, source_url string, tags array<string>, content string, file string"
    docs = [("t", None, None, None, "c", None), ("", "p" * 201, "http://10.0.0.1/", ["x" * 51], "c", "f"), ("t", "p", "https://a.org/", [str(i) for i in range(21)], None, None)]
    assert [r.e for r in spark.createDataFrame(docs, kinds).select(K.import_errors().alias("e")).collect()] == [[], ["title", "publisher", "source_url", "tags", "one_of_content_and_file"], ["tags", "one_of_content_and_file"]]
    q = [("harbour", 5), ("", 0), (None, None), ("x" * 501, 21)]
    assert [len(r.e) for r in spark.createDataFrame(q, "query string, limit int").select(K.search_errors().alias("e")).collect()] == [0, 2, 2, 2]


def test_codes_settings_and_shown_values(spark):
    df = spark.createDataFrame([(200,), (401,), (500,), (None,)], "s int").select(K.status_code(F.col("s"), "search").alias("c"))
    assert [r.c for r in df.collect()] == [None, "SEARCH_AUTH", "SEARCH_UNAVAILABLE", None] and [r.m for r in df.select(K.message(F.col("c")).alias("m")).collect()] == [None, "the search key was refused", "the service is not available", None]
    asked = spark.createDataFrame([("c", 1, None), ("c", 2, "SEARCH_QUOTA"), ("c", 3, None), ("d", 1, "SEARCH_TIMEOUT"), ("d", 2, None)], "claim_id string, query_no int, code string")
    assert {(r.claim_id, r.query_no): r.asked for r in K.attempted(asked).collect()} == {("c", 1): True, ("c", 2): True, ("c", 3): False, ("d", 1): True, ("d", 2): True}
    s = K.Settings.read({"ATTESTIA_CLAIMS": "99", "ATTESTIA_RETRIES": "x", "ATTESTIA_DEADLINE_SECONDS": "inf", "ATTESTIA_QUERIES": "-3"})
    assert (s.claims, s.retries, s.deadline_seconds, s.queries) == (15, 2, 180.0, 1)
    row = spark.createDataFrame([("a <<<EVIDENCE b>>>", 0.125, "X.PDF")], "t string, s double, f string").select(K.bounded_block(F.col("t")), K.percent_shown(F.col("s")), K.file_badge(F.col("f")), K.percent_shown(F.lit(None).cast("double"))).first()
    assert row[0].count("<<<") == row[0].count(">>>") == 1 and row[1:] == ("13%", "PDF", "n/a")


def test_paper_records_and_support(spark):
    a = {"title": ["A Study"], "author": [{"given": "Ann", "family": "Lee"}], "published": {"date-parts": [[1999, 2]]}, "container-title": ["J. Mills"], "DOI": "https://doi.org/10.1234/AB."}
    b = {"title": "B Study", "authors": [{"name": "Bo Ng"}], "year": 2001, "venue": "V"}
    got = spark.createDataFrame([(json.dumps(a),), (json.dumps(b),), ("{}",), (None,), ("no json",)], "r string").select(K.paper_record(F.col("r")).alias("p")).select("p.*").collect()
    assert got[0][:] == ("A Study", ["ann lee"], 1999, "J. Mills", "10.1234/ab") and got[1][:4] == ("B Study", ["bo ng"], 2001, "V") and got[2].title is None and got[3].title is None and got[4].year is None
    ev = [(1, "supports", "x", "a x b"), (1, "refutes", "y", "y"), (2, "refutes", "y", "y"), (2, "supports", "invented", "y"), (3, "supports", "invented", "y"), (4, "partially_supports", "y", "y"), (5, None, None, None)]
    got = {r.citation_id: r.status for r in K.paper_support(spark.createDataFrame(ev, "citation_id int, relation string, quote string, excerpt string")).collect()}
    assert got == {1: "conflicting", 2: "not_supported", 3: "insufficient_evidence", 4: "supported", 5: "insufficient_evidence"}


def test_library_upkeep(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "xx", None, None), ("b", "yy", [1.0, 0.0], "old"), ("c", "zz", [0.0, 1.0], "new"), ("d", "", None, None)], "chunk_id string, text string, embedding array<float>, embedding_model string")
    encode = lambda t: t.select("chunk_id", F.array(F.length("text").cast("double"), F.lit(0.0)).alias("embedding"))
    out, left = L.reindexed(chunks, encode, "new", 2)
    assert {r.chunk_id: (r.embedding, r.embedding_model) for r in out.collect()} == {"a": ([1.0, 0.0], "new"), "b": ([1.0, 0.0], "new"), "c": ([0.0, 1.0], "new"), "d": (None, None)} and left.first().remaining == 1
    assert L.reindexed(chunks, encode, "new")[1].first().remaining == 1  # a zero vector is none
    docs = spark.createDataFrame([("1", "Old Mill", "P", ["x"]), ("2", "Bridge", "MILL press", ["y"]), ("3", None, None, None)], "document_id string, title string, publisher string, tags array<string>")
    ids = lambda df: {r.document_id for r in df.collect()}
    assert ids(L.filtered(docs, None, " mill ")) == {"1", "2"} and ids(L.filtered(docs, "x")) == {"1"} and ids(L.filtered(docs)) == {"1", "2", "3"} and ids(L.filtered(docs, "x", "bridge")) == set()
    new = spark.createDataFrame([("9", 3)], "document_id string, chunk_count int")
    assert [r.error for r in L.capacity_errors(docs, chunks, new, 3, 6).collect()] == ["DOCUMENT_LIMIT", "CHUNK_LIMIT"] and L.capacity_errors(docs, chunks, new).count() == 0
    log = L.audit_rows(spark.createDataFrame([({"event": "search", "api_key": "secret", "text": "t"},)], "record map<string,string>"))
    assert log.columns == list(L.AUDIT_KEYS) and log.first().event == "search"
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "a.json").write_text('{"claims": [{"claim_id": "1", "label": "credible"}]}')
    (tmp_path / "e" / "b.json").write_text('{"claims": [{"claim_id": "2", "label": null}]}')
    assert {r.claim_id for r in L.exports(spark, str(tmp_path / "e")).collect()} == {"1", "2"}
    (tmp_path / "e" / "c.json").write_text('[{"case_id": "1"}]')
    with pytest.raises(ValueError):
        L.exports(spark, str(tmp_path / "e"))


def test_lifecycle(spark):
    steps = spark.createDataFrame([("a", 1, "pending"), ("a", 2, "retrieving"), ("a", 3, "done"), ("a", 4, "judging"), ("b", 1, "done")], "k string, n int, s string")
    assert [(r.k, r.n) for r in limits.transitions(steps, "k", "s", ["n"]).filter("NOT legal").collect()] == [("a", 4)]
    tasks = spark.createDataFrame([("t", "running"), ("u", "succeeded")], "task_id string, status string")
    claims = spark.createDataFrame([("1", "t", "judging", "credible"), ("2", "t", "done", "credible"), ("3", "u", "pending", None)], "claim_id string, task_id string, state string, label string")
    t, c = limits.recovered(tasks, claims)
    assert {r.task_id: r.status for r in t.collect()} == {"t": "interrupted", "u": "succeeded"} and {r.claim_id: (r.state, r.label) for r in c.collect()} == {"1": ("failed", None), "2": ("done", "credible"), "3": ("pending", None)}
    cost = spark.createDataFrame([("t", n, 10.0) for n in range(6)], "t string, n int, c double")
    assert [r.started for r in limits.within_budget(cost, "t", ["n"], "c", 30.0).orderBy("n").collect()] == [True, True, True, False, False, False]
    ev = spark.createDataFrame([("u", i, i * 1_000_000) for i in range(15)] + [("u", 99, 70_000_000), ("v", 1, None)], "k string, id int, us bigint").withColumn("at", F.timestamp_micros("us"))
    got = {(r.k, r.id): r.accepted for r in limits.admissions_batch(ev, "k", "at", "id").collect()}
    assert sum(ok for (k, _), ok in got.items() if k == "u") == 11 and not got["v", 1] and got["u", 99]


def test_conversion_cycles_are_checked_with_offsets():
    good = [("c", "k", "1", "273.15"), ("f", "c", "5/9", "-160/9"), ("f", "k", "5/9", "229835/900")]
    assert units.conversions({"temperature": "k"}, good)["f"][1:] == (units.Fraction(5, 9), units.Fraction(229835, 900))
    for bad in ([*good[:2], ("f", "k", "5/9", "10")], [*good, ("x", "y", "2", "0"), ("x", "y", "3", "0")]):
        with pytest.raises(ValueError):
            units.conversions({"temperature": "k"}, bad)
