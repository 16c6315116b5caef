"""Queries on terms, the knowledge base and retrieval, with their SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestia.functions.text import CJK_STOP, STOP, terms
from attestia.operators import retrieval as R
from attestia.operators.versions import latest
from attestia.session import table


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "kb_chunks").select("chunk_id", "document_id", F.get_json_object("data", "$.excerpt").alias("excerpt"), "embedding", "embedding_model")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "kb_hits").select("query_id", "query").distinct()


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "kb_documents"), "document_id", "created_at")


def claim_terms(spark, d):
    return table(spark, d, "claims").select("claim_id", F.array_sort(terms(F.col("normalized_claim"))).alias("terms")).distinct()


def normal_terms(spark, d):
    """Search terms of the claims in NFKC, as the engine's own search counts them."""
    return table(spark, d, "claims").select("claim_id", terms(F.col("normalized_claim"), normalize=True).alias("terms")).distinct()


def topic_coverage(spark, d):
    """Share of a claim's terms that an evidence excerpt holds."""
    c = latest(table(spark, d, "claims"), "claim_id", "retry_count").select("claim_id", terms(F.col("normalized_claim")).alias("t")).filter(F.size("t") > 0)
    e = table(spark, d, "evidence_items").select("evidence_id", "claim_id", F.lower("excerpt").alias("x")).filter("x IS NOT NULL").distinct()
    hits = F.size(F.filter("t", lambda t: F.contains(F.col("x"), t)))
    return e.join(c, "claim_id").select("evidence_id", hits.alias("hits"), F.round(hits / F.size("t"), 6).alias("share"))


def kb_duplicates(spark, d):
    """Uploads whose pages are those of an earlier upload, by hash of the pages."""
    docs = _docs(spark, d).select("document_id", F.sha2(F.array_join("pages", "\f", ""), 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("document_id").alias("kept"), F.count("*").alias("copies"))
    return docs.join(first.filter("copies > 1"), "h").select("document_id", "kept", "copies")


def kb_status(spark, d):
    usable = (F.col("embedding_model") == "lattice-base-64") & F.col("embedding").isNotNull()
    c = table(spark, d, "kb_chunks").agg(F.count("*").alias("chunks"), F.count_if(usable).alias("indexed"))
    return _docs(spark, d).agg(F.count("*").alias("documents"), F.sum(F.size("pages")).alias("pages")).join(F.broadcast(c))


def kb_listing(spark, d):
    """Documents, newest first, with their number of chunks: page 2 of 20."""
    n = table(spark, d, "kb_chunks").groupBy("document_id").agg(F.count("*").alias("chunks"))
    return _docs(spark, d).select("document_id", "title", "created_at").join(n, "document_id", "left").na.fill(0, ["chunks"]).orderBy(F.desc("created_at"), "document_id").offset(20).limit(20)


def kb_tags(spark, d):
    return _docs(spark, d).select("document_id", F.explode("tags").alias("tag")).groupBy("tag").agg(F.countDistinct("document_id").alias("documents"))


def chunk_gaps(spark, d):
    """Overlap (negative: gap) of each stored chunk with the one before it in its document and page."""
    from pyspark.sql import Window

    c = table(spark, d, "kb_chunks").select("chunk_id", "document_id", *[F.get_json_object("data", f"$.{k}").cast("int").alias(k) for k in ("page", "char_start", "char_end")])
    w = Window.partitionBy("document_id", "page").orderBy("char_start", "chunk_id")
    return c.select("chunk_id", (F.lag("char_end").over(w) - F.col("char_start")).alias("overlap"))


def bm25_topk(spark, d):
    return R.bm25(_asked(spark, d), "query_id", "query", _chunks(spark, d), "chunk_id", "excerpt", 10)


def vector_topk(spark, d):
    v = table(spark, d, "embeddings")
    return R.vector_topk(v.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id").withColumnRenamed("embedding", "q"), "query_id", "q", v, "vec_id", "embedding", 10, 0.3)


def _channels(spark, d):
    c = _chunks(spark, d)
    usable = c.filter((F.col("embedding_model") == "lattice-base-64") & (F.size("embedding") == 64) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)))
    top = table(spark, d, "kb_hits").filter("hit_rank = 1").select("query_id", "chunk_id").distinct()
    vectors = top.join(usable.select("chunk_id", "embedding"), "chunk_id").select("query_id", F.col("embedding").alias("q"))
    return c, R.bm25(_asked(spark, d), "query_id", "query", c, "chunk_id", "excerpt", 40), R.vector_topk(vectors, "query_id", "q", usable, "chunk_id", "embedding", 40, 0.5, ties="desc")


def hybrid_search(spark, d):
    """Keyword and vector channels fused by reciprocal rank, two passages a document, five a query."""
    c, words, near = _channels(spark, d)
    owner = R.sized(c.select("chunk_id", "document_id"))
    return R.fused({"keyword": words.join(owner, "chunk_id"), "semantic": near.join(owner, "chunk_id")}, "query_id", "chunk_id", 5, "document_id")


def tag_search(spark, d):
    """Keyword search within documents that carry a tag."""
    docs = _docs(spark, d).filter(F.array_contains("tags", "harbour")).select("document_id")
    return R.bm25(_asked(spark, d), "query_id", "query", _chunks(spark, d).join(docs, "document_id", "left_semi"), "chunk_id", "excerpt", 5)


def logged_fusion(spark, d):
    """Logged hits re-fused: hits found by both channels against those of one, per query."""
    h = table(spark, d, "kb_hits").distinct()
    return h.groupBy("query_id").agg(F.count("*").alias("hits"), F.count_if(F.size("matched_by") > 1).alias("both"), F.round(F.max("retrieval_score"), 6).alias("best"))


QUERIES = {f.__name__: f for f in (claim_terms, normal_terms, topic_coverage, kb_duplicates, kb_status, kb_listing, kb_tags, chunk_gaps, bm25_topk, vector_topk, hybrid_search, tag_search, logged_fusion)}


def _terms(x: str) -> str:
    runs = f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z][a-z0-9]*(?:[-_/][a-z0-9]+)*|[0-9]+(?:[.,][0-9]+)?%?|[㐀-鿿]+')"
    split = f"flatten(list_transform({runs}, lambda r: CASE WHEN regexp_matches(r, '^[㐀-鿿]') THEN list_transform(range(1, greatest(length(r) - 1, 1) + 1), lambda i: substr(r, i, 2)) ELSE [r] END))"
    return f"list_distinct(list_filter({split}, lambda t: CASE WHEN regexp_matches(t, '^[㐀-鿿]') THEN t NOT IN {CJK_STOP} ELSE length(t) > 1 AND t NOT IN {STOP} END))"


DOCS = "docs AS (SELECT * EXCLUDE (_n) FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC NULLS LAST) AS _n FROM kb_documents) WHERE _n = 1)"
CHUNKS = "ch AS (SELECT chunk_id, document_id, data->>'$.excerpt' AS excerpt, embedding, embedding_model FROM kb_chunks)"


def _bm25(source: str, top: int) -> str:
    return f"""asked AS (SELECT query_id, unnest({_terms('query')}) AS term FROM (SELECT DISTINCT query_id, query FROM kb_hits)),
sized AS (SELECT chunk_id, {_terms('excerpt')} AS t FROM {source}), tot AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM sized),
post AS (SELECT chunk_id, len(t) AS length, unnest(t) AS term FROM sized), df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
sc AS (SELECT query_id, chunk_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * 2.2 / (1 + 1.2 * (1 - 0.75 + 0.75 * length / mean))), 6) AS score FROM post JOIN asked USING (term) JOIN df USING (term), tot GROUP BY 1, 2),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM sc) WHERE rank <= {top})"""


SQL = {
    "claim_terms": f"SELECT DISTINCT claim_id, list_sort({_terms('normalized_claim')}) AS terms FROM claims",
    "topic_coverage": f"""WITH c AS (SELECT claim_id, {_terms('normalized_claim')} AS t FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY retry_count DESC NULLS LAST) AS n FROM claims) WHERE n = 1),
e AS (SELECT DISTINCT evidence_id, claim_id, lower(excerpt) AS x FROM evidence_items WHERE excerpt IS NOT NULL), j AS (SELECT evidence_id, len(list_filter(t, lambda u: contains(x, u)))::INT AS hits, len(t) AS n FROM e JOIN c USING (claim_id) WHERE len(t) > 0)
SELECT evidence_id, hits, round(hits / n, 6) AS share FROM j""",
    "kb_duplicates": f"WITH {DOCS}, h AS (SELECT document_id, sha256(array_to_string(list_transform(pages, lambda p: coalesce(p, '')), chr(12))) AS h FROM docs), f AS (SELECT h, min(document_id) AS kept, count(*) AS copies FROM h GROUP BY 1 HAVING count(*) > 1) SELECT document_id, kept, copies FROM h JOIN f USING (h)",
    "kb_status": f"WITH {DOCS} SELECT (SELECT count(*) FROM docs) AS documents, (SELECT sum(len(pages))::BIGINT FROM docs) AS pages, count(*) AS chunks, count(*) FILTER (embedding_model = 'lattice-base-64' AND embedding IS NOT NULL) AS indexed FROM kb_chunks",
    "kb_listing": f"WITH {DOCS} SELECT document_id, title, created_at, coalesce(n, 0) AS chunks FROM docs LEFT JOIN (SELECT document_id, count(*) AS n FROM kb_chunks GROUP BY 1) USING (document_id) ORDER BY created_at DESC, document_id LIMIT 20 OFFSET 20",
    "kb_tags": f"WITH {DOCS} SELECT tag, count(DISTINCT document_id) AS documents FROM (SELECT document_id, unnest(tags) AS tag FROM docs) GROUP BY 1",
    "chunk_gaps": "WITH c AS (SELECT chunk_id, document_id, (data->>'$.page')::INT AS page, (data->>'$.char_start')::INT AS a, (data->>'$.char_end')::INT AS b FROM kb_chunks) SELECT chunk_id, lag(b) OVER (PARTITION BY document_id, page ORDER BY a, chunk_id) - a AS overlap FROM c",
    "bm25_topk": f"WITH {CHUNKS}, {_bm25('ch', 10)} SELECT * FROM bm",
    "vector_topk": "WITH p AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p WHERE score >= 0.3) WHERE rank <= 10",
    "hybrid_search": f"""WITH {CHUNKS}, {_bm25('ch', 40)}, us AS (SELECT * FROM ch WHERE embedding_model = 'lattice-base-64' AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0),
qv AS (SELECT DISTINCT query_id, chunk_id FROM kb_hits WHERE hit_rank = 1), p AS (SELECT query_id, v.chunk_id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM qv JOIN us q USING (chunk_id), us v),
ve AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id DESC)::INT AS rank FROM p WHERE score >= 0.5) WHERE rank <= 40),
u AS (SELECT query_id, chunk_id, rank, 0 AS o, 'keyword' AS channel FROM bm UNION ALL SELECT query_id, chunk_id, rank, 1, 'semantic' FROM ve),
f AS (SELECT query_id, chunk_id, document_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, list(channel ORDER BY o) AS matched_by FROM u JOIN ch USING (chunk_id) GROUP BY 1, 2, 3),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, chunk_id) AS r FROM f)
SELECT * FROM (SELECT query_id, chunk_id, document_id, score, matched_by, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM g WHERE r <= 2) WHERE rank <= 5""",
    "tag_search": f"WITH {DOCS}, {CHUNKS}, tagged AS (SELECT * FROM ch WHERE document_id IN (SELECT document_id FROM docs WHERE list_contains(tags, 'harbour'))), {_bm25('tagged', 5)} SELECT * FROM bm",
    "logged_fusion": "SELECT query_id, count(*) AS hits, count(*) FILTER (len(matched_by) > 1) AS both, round(max(retrieval_score), 6) AS best FROM (SELECT DISTINCT * FROM kb_hits) GROUP BY 1",
}
