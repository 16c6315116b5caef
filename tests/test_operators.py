import datetime as dt
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from attestia.operators import fusion, graph, intervals, judging, quantities, retrieval, versions
from attestia.sources import files, html, search, sinks
from attestia.streaming import limits

EV = "evidence_id string, claim_id string, cluster_id string, url string, excerpt string, relation string, checks array<struct<part_id int, part_text string, relation string, excerpt string>>, quality_reason string, source_type string, authority double, relevance double, time_fit double"


def item(e, claim, cluster, relation, a, source="web", checks=None, excerpt="x", note="body"):
    return (e, claim, cluster, "https://a.example", excerpt, relation, checks, note, source, a, 1.0, 1.0)


def test_verdicts_count_clusters_not_copies(spark):
    claims = spark.createDataFrame([("c1",), ("c2",), ("c3",), ("c4",)], "claim_id string")
    rows = [
        item("1", "c1", "k1", "refutes", 0.19), item("2", "c1", "k2", "refutes", 0.29),  # qualities .595 and .645
        item("3", "c2", "k1", "supports", 0.44), item("4", "c2", "k1", "supports", 0.44),  # copies of one source
        item("5", "c3", "k1", "supports", 1.0, "knowledge"), item("6", "c3", "k2", "supports", 1.0, "knowledge"),
    ]
    got = {r.claim_id: r for r in judging.verdicts(claims, spark.createDataFrame(rows, EV)).collect()}
    assert (got["c1"].label, got["c1"].support_score, got["c1"].refute) == ("incorrect", 12, 0.764)
    assert got["c2"].label == "evidence_insufficient" and got["c2"].support_score is None
    assert got["c3"].label == "evidence_insufficient" and got["c3"].support == 0
    assert got["c4"].support == 0 and got["c4"].label == "evidence_insufficient"


def test_verdicts_of_empty_evidence(spark):
    claims = spark.createDataFrame([("c1",)], "claim_id string")
    assert [r.label for r in judging.verdicts(claims, spark.createDataFrame([], EV)).collect()] == ["evidence_insufficient"]


def test_part_without_support_counts_as_zero(spark):
    checks = [(1, "a", "supports", "x"), (2, "b", "unknown", "x")]
    got = {(r.part_id): r.strength for r in judging.part_strengths(spark.createDataFrame([item("1", "c", "k", "unknown", 0.9, checks=checks)], EV)).collect()}
    assert got[1] > 0.9 and got[2] == 0


def test_coverage_gate(spark):
    tasks = spark.createDataFrame([("t1", False, 0), ("t2", True, 3), ("t3", None, None)], "task_id string, truncated boolean, claims_unchecked int")
    rows = [("t1", "general", "credible", "done", 90)] * 4 + [("t1", "general", "evidence_insufficient", "done", None), ("t2", "general", "credible", "done", 90)]
    claims = spark.createDataFrame(rows, "task_id string, claim_type string, label string, state string, support_score int")
    got = {r.task_id: r for r in judging.coverage(claims, tasks).collect()}
    assert got["t1"].score == 90 and got["t1"].verification_coverage == 0.8
    assert got["t2"].score is None and got["t2"].claims_extracted == 4
    assert got["t3"].score is None and got["t3"].verification_coverage is None and got["t3"].claims_extracted == 0


def test_latest_upsert_delete(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", None), (None, 5)], "k string, v int")
    assert sorted((r.k or "", r.v) for r in versions.latest(df, "k", "v").collect()) == [("", 5), ("a", 2), ("b", None)]
    new = spark.createDataFrame([("a", 9), ("c", 1)], "k string, v int")
    assert {(r.k, r.v) for r in versions.upsert(versions.latest(df.na.drop(), "k", "v"), new, "k").collect()} == {("a", 9), ("c", 1)}
    assert [r.k for r in versions.without_known(new, df, "k").collect()] == ["c"]


def brute_bm25(queries, passages, top):
    """(query, passage, score, rank) from all pairs; words are cut at spaces."""
    import collections
    import math

    n, mean = len(passages), sum(len(set(t.split())) for _, t in passages) / len(passages)
    df = collections.Counter(w for _, t in passages for w in set(t.split()))
    out = collections.defaultdict(lambda: collections.defaultdict(float))
    for q, text in queries:
        for w in set(text.split()):
            for k, t in passages:
                if w in (words := set(t.split())):
                    out[q][k] += max(math.log((n - df[w] + 0.5) / (df[w] + 0.5)), 1e-6) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(words) / mean))
    ranked = {q: sorted(((-round(x, 6), k) for k, x in found.items()))[:top] for q, found in out.items()}
    return [(q, k, -x, r + 1) for q, best in sorted(ranked.items()) for r, (x, k) in enumerate(best)]


@pytest.mark.parametrize("sizes", [(100_000, 5_000), (7, 3)])
def test_bm25_equals_brute_force_without_all_pairs(spark, monkeypatch, sizes):
    rng, words = random.Random(5), [f"w{i}" for i in range(40)]
    passages = [(f"p{i:03}", " ".join(rng.choices(words, weights=range(40, 0, -1), k=rng.randrange(3, 20)) + ["harbour"])) for i in range(300)]
    passages += [("p000", "w39 harbour w1"), ("p999", "alone")]  # a key with two texts
    queries = [(f"q{i:03}", " ".join(["harbour"] + rng.sample(words, rng.randrange(1, 5)))) for i in range(120)] + [("q000", "w39 w1"), ("q998", "unknown"), ("q999", "harbour")]
    for name, value in zip(("BUCKET_POSTINGS", "BUCKET_TAILS"), sizes):
        monkeypatch.setattr(retrieval, name, value, raising=False)
    seen, ranked = [], retrieval.ranked
    monkeypatch.setattr(retrieval, "ranked", lambda scores, *a: (seen.append(scores.count()), ranked(scores, *a))[1])
    got = retrieval.bm25(spark.createDataFrame(queries, "qid string, q string"), "qid", "q", spark.createDataFrame(passages, "id string, t string"), "id", "t", 3)
    got = [(r.qid, r.id, r.score, r["rank"]) for r in got.select("qid", "id", "score", "rank").orderBy("qid", "rank").collect()]
    assert got == brute_bm25(queries, passages, 3)
    if sizes[0] > 1000:
        assert max(seen) <= 120 * 7 * 3  # best passages of a tail, not the 36,000 pairs


@pytest.mark.parametrize("ties, blocks", [("asc", None), ("desc", (7, 90))])
def test_vector_search_equals_brute_force_and_sends_only_the_best(spark, monkeypatch, ties, blocks):
    import numpy as np

    rng = np.random.default_rng(3)
    vectors = np.round(rng.normal(size=(600, 8)), 1).tolist()
    vectors[5:9], vectors[20] = [vectors[4]] * 4, [float("nan")] * 8
    passages = [(f"p{i:03}", v) for i, v in enumerate(vectors)] + [("short", [1.0]), ("none", None), ("p900", [1e200] + [0.0] * 7)]
    queries = [(f"q{i:02}", vectors[i]) for i in range(20)] + [("qn", None)]
    for name, value in zip(("BLOCK_ASKED", "BLOCK_OWN"), blocks or ()):
        monkeypatch.setattr(retrieval, name, value, raising=False)
    seen, ranked = [], retrieval.ranked
    monkeypatch.setattr(retrieval, "ranked", lambda scores, *a: (seen.append(scores.count()), ranked(scores, *a))[1])
    schema = "string, v array<double>"
    got = retrieval.vector_topk(spark.createDataFrame(queries, f"qid {schema}"), "qid", "v", spark.createDataFrame(passages, f"id {schema}").repartition(8), "id", "v", 5, 0.5, ties)
    got = [(r.qid, r.id, r.score, r["rank"]) for r in got.orderBy("qid", "rank").collect()]
    wanted = []
    for q, v in queries[:-1]:
        scored = [(k, round(float(np.dot(v, w)), 6)) for k, w in sorted(passages, reverse=ties == "desc") if w is not None and len(w) == 8]
        best = sorted((x for x in scored if x[1] >= 0.5), key=lambda x: -x[1])[:5]
        wanted += [(q, k, x, n + 1) for n, (k, x) in enumerate(best)]
    assert got == wanted
    assert blocks or seen[-1] <= 20 * 5


def test_bm25_prefers_rare_terms_and_breaks_ties(spark):
    p = spark.createDataFrame([(1, "rare apple"), (2, "apple pear"), (3, "apple pear"), (4, None), (5, "")], "id int, t string")
    q = spark.createDataFrame([("q", "rare apple"), ("n", None), ("p", "pear")], "qid string, q string")
    got = [(r.qid, r.id, r["rank"]) for r in retrieval.bm25(q, "qid", "q", p, "id", "t", 2).orderBy("qid", "rank").collect()]
    assert got == [("p", 2, 1), ("p", 3, 2), ("q", 1, 1), ("q", 2, 2)]


def test_fusion_keeps_two_a_document(spark):
    a = spark.createDataFrame([("q", i, i, "d1") for i in range(1, 5)], "qid string, id int, rank int, doc string")
    b = spark.createDataFrame([("q", 9, 1, "d2"), ("q", 2, 2, "d1")], "qid string, id int, rank int, doc string")
    got = retrieval.fused({"keyword": a, "semantic": b}, "qid", "id", 5, "doc").orderBy("rank").collect()
    assert [(r.id, r.matched_by) for r in got] == [(2, ["keyword", "semantic"]), (1, ["keyword"]), (9, ["semantic"])]


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [("g", i, (s := rng.randrange(3000)), s + rng.randrange(0, 900)) for i in range(80)]
    want = {(i, j) for _, i, a, b in rows for _, j, c, d in rows if i < j and a < d and c < b and b > a and d > c}
    got = [(r.k_a, r.k_b) for r in intervals.overlapping(spark.createDataFrame(rows, "g string, k int, s int, e int"), "g", "k", "s", "e").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_containing_and_segments(spark):
    points = spark.createDataFrame([("t", 0), ("t", 5), ("t", 12), ("u", 1)], "t string, at bigint")
    spans = spark.createDataFrame([("t", 0, 4), ("t", 4, 10)], "t string, a int, b int")
    assert {(r.t, r.at): r.span_start for r in intervals.containing(points, spans, "t", "at", "a", "b").collect()} == {("t", 0): 0, ("t", 5): 4, ("t", 12): None, ("u", 1): None}
    seg = intervals.segments(spark.createDataFrame([("t", 2, 4, 10), ("t", 3, 6, 10), ("t", 8, 20, 10)], "t string, a int, b int, n int"), "t", "a", "b", "n")
    assert [(r.seg_start, r.seg_end, r.covers) for r in seg.orderBy("seg_start").collect()] == [(0, 2, 0), (2, 3, 1), (3, 4, 2), (4, 6, 1), (6, 10, 0)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (200, 200), (None, 3)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 200: 200}
    rows = spark.createDataFrame([("e1", "a", "x"), ("e2", "b", "x"), ("e3", "b", "y"), ("e4", "c", None), ("e5", "", "")], "id string, s string, h string")
    assert {r.id: r.component for r in graph.linked_by_keys(rows, "id", ["s", "h"]).collect()} == {"e1": "e1", "e2": "e1", "e3": "e1", "e4": "e4", "e5": "e5"}


def test_cover(spark):
    rows = [("c", "a", [1], True, 0.9), ("c", "b", [1, 2], False, 0.1), ("c", "d", None, True, None)]
    got = fusion.cover(spark.createDataFrame(rows, "claim_id string, evidence_id string, parts array<int>, web boolean, authority double")).orderBy("pick").collect()
    assert [r.evidence_id for r in got] == ["b", "a", "d"]


def test_common_units(spark):
    records = spark.createDataFrame([("claim", "1", "A wall 5-7 m high, 5 m long", 1), ("claim", "2", None, 2), ("claim", "3", "", 3)], "record_kind string, record_key string, text string, unit int")
    targets = spark.createDataFrame([("length", "millimetre")], "dimension string, common_unit string")
    got = quantities.in_common_units(records, targets)
    assert sorted((r.record_key, r.dimension, r.base_value) for r in got.collect()) == [("1", "length", 5000), ("1", "length", 7000)]
    assert quantities.in_common_units(records.limit(0), targets).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfone\r\ntwo\r")
    (tmp_path / "b.md").write_bytes(b"\xff\xfe")
    (tmp_path / "c.exe").write_bytes(b"x")
    (tmp_path / "e.txt").write_bytes(b"  \n")
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>Head</w:t></w:r></w:p><w:tbl><w:tr>{cell('x')}{cell('y')}</w:tr></w:tbl></w:body></w:document>")
    got = {r.filename: (r.pages, r.error) for r in files.documents(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": (["one\ntwo\n"], None), "b.md": (None, "DOCUMENT_ENCODING"), "c.exe": (None, "DOCUMENT_TYPE"), "d.docx": (["Head\nx\ty"], None), "e.txt": (None, "DOCUMENT_EMPTY")}


def test_html_and_search(spark):
    assert html.readable("<p>A&amp;B</p><script>x</script><div>c  d<br>e</div>") == "A&B\nc d\ne" and html.readable(None) is None
    q = spark.createDataFrame([(1, " Big  Cat "), (2, ""), (3, None)], "query_id int, query string")
    r = spark.createDataFrame([("big cat", 1, "a"), ("BIG CAT", 2, "b"), ("dog", 1, "c")], "query string, ord int, url string")
    assert [x.url for x in search.search(q, r, 1).collect()] == ["a"] and search.search(q, r, -1).count() == 0


def test_import_rejects_known_bodies(spark):
    known = spark.createDataFrame([("a", ["x"])], "document_id string, pages array<string>").withColumn("content_hash", F.sha2(F.to_json("pages"), 256))
    new = spark.createDataFrame([("b", ["x"]), ("c", ["y"]), ("d", ["y"])], "document_id string, pages array<string>")
    assert [r.document_id for r in sinks.import_documents(known, new).collect()] == ["c"]


def test_admission_batch_and_stream(spark, tmp_path):
    base = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(1, i, base + dt.timedelta(seconds=4 * i)) for i in range(30)] + [(2, 100, base)]
    df = spark.createDataFrame(rows, "user int, event_id int, at timestamp")
    times, want = [], {}
    for _, e, t in rows[:30]:
        times, want[e] = limits.admit(times, int(t.timestamp() * 1e6))
    want[100] = True
    assert {r.event_id: r.accepted for r in limits.admissions_batch(df, "user", "at", "event_id").collect()} == want
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = limits.admissions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "user", "at", "event_id")
    q = stream.writeStream.format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.event_id: r.accepted for r in spark.table("admitted").collect()} == want


def test_changed_and_generation(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("a", 1), ("b", 3), ("c", None)], "k string, v int")
    assert sorted(r.k for r in limits.changed(old, new, "k", ["v"]).collect()) == ["b", "c"]
    assert sorted((r.k, r.v) for r in limits.newest_generation(old.unionByName(new), "k", "v").collect()) == [("a", 1), ("a", 1), ("b", 3)]


@pytest.mark.parametrize("name", ["claim_verdicts", "task_coverage", "hybrid_search", "evidence_components"])
def test_queries_run(spark, data, name):
    import __spark_entry__ as e

    assert e.queries()[name](spark, data).count() > 0
