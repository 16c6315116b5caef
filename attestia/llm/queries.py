"""Queries of this subpackage: name -> (spark, folder) -> DataFrame, with production parameters on whole tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestia.session import table

from . import abuse, boilerplate, bpe, canon, leak, nearpass, neighbours, pieces, sentences


def _records(spark: SparkSession, d: str, tasks: bool = True) -> DataFrame:
    """(record_kind, record_key, text) of the claim and evidence texts, and of the tasks."""
    def of(name: str, key: str, text: str, kind: str) -> DataFrame:
        return table(spark, d, name).select(F.lit(kind).alias("record_kind"), F.col(key).alias("record_key"), F.col(text).alias("text"))

    out = of("claims", "claim_id", "normalized_claim", "claim").unionByName(of("evidence_items", "evidence_id", "excerpt", "evidence"))
    return of("tasks", "task_id", "input_text", "task").unionByName(out) if tasks else out


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = nearpass.near_pairs(table(spark, d, "evidence_items"), "evidence_id", "excerpt")
    return pairs.select(F.col("id_a").alias("evidence_id_a"), F.col("id_b").alias("evidence_id_b"))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each item with words, its class of equal word sets and the number of classes linked to it."""
    return nearpass.near_links(table(spark, d, "evidence_items"), "evidence_id", "excerpt")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.forward_pieces(table(spark, d, "kb_documents"))


def p2_bisected(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of every page by recursive bisection at the strongest boundary near the midpoint."""
    return pieces.bisect_pieces(table(spark, d, "kb_documents"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "tasks"), "task_id", "input_text")


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """(id, neighbour, similarity): the five most similar of every usable vector."""
    return neighbours.nearest(table(spark, d, "kb_chunks").filter(F.col("embedding_model") == "lattice-base-64"), "chunk_id", "embedding", k=5, size=64)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    near = p4_neighbours(spark, d)
    return near.select(F.least("id", "neighbour").alias("chunk_id_a"), F.greatest("id", "neighbour").alias("chunk_id_b")).distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    def of(name: str, key: str, text: str, kind: str) -> DataFrame:
        return table(spark, d, name).select(F.lit(kind).alias("record_kind"), F.col(key).alias("record_key"), "url", "publisher", F.col(text).alias("text"))

    return boilerplate.furniture_lines(of("search_results", "result_id", "content", "search_result").unionByName(of("evidence_items", "evidence_id", "excerpt", "evidence")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return canon.lookalike_pairs(_records(spark, d))


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each record with its class of texts that look the same, and in how many ways the class is spelt."""
    return canon.lookalike_classes(_records(spark, d))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents"), "doc_id", "text", bpe.Vocabulary())


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and the text decoded from its ids."""
    v = bpe.Vocabulary()
    return p8_ids(spark, d).select("doc_id", bpe.decode(F.col("ids"), v).alias("text"))


def p9_regions(spark: SparkSession, d: str) -> DataFrame:
    """Item windows found in documents with at most two edits."""
    return leak.leaked(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_regions(spark, d).filter("edits = 0").select("doc_id", "item_id").distinct()


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Documents that each leaked item was found in."""
    return p9_found(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its score and the nearest abusive example."""
    return abuse.scores(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "moderation_samples"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_scores(spark, d).filter(F.col("score") >= abuse.THRESHOLD).select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """Documents, flagged documents and their share per source."""
    both = table(spark, d, "documents").select("doc_id", "source").join(p10_scores(spark, d).select("doc_id", "score"), "doc_id")
    return both.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("score") >= abuse.THRESHOLD).alias("flagged"), F.round(F.avg((F.col("score") >= abuse.THRESHOLD).cast("int")), 6).alias("rate"))


QUERIES = {f.__name__: f for f in (p1_found, p1_classes, p2_found, p2_bisected, p3_found, p4_neighbours, p4_found, p5_found, p6_found, p6_classes, p8_ids, p8_round_trip, p9_regions, p9_found, p9_items, p10_scores, p10_found, p10_rates)}
SQL: dict[str, str] = {
    # The definition itself: every window of every item searched in every text.
    "p9_found": """
WITH w AS (SELECT item_id, lang, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS words FROM (SELECT DISTINCT item_id, lang, text FROM eval_items)),
l AS (SELECT *, array_to_string(words, '') AS letters FROM w),
v AS (SELECT DISTINCT item_id, CASE WHEN lang = 'zh' THEN substr(letters, i, 20) ELSE array_to_string(words[i:i + 11], '') END AS part FROM l, range(1, 5000) r(i) WHERE i <= CASE WHEN lang = 'zh' THEN length(letters) - 19 ELSE len(words) - 11 END),
d AS (SELECT DISTINCT doc_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS stream FROM documents WHERE text IS NOT NULL)
SELECT DISTINCT doc_id, item_id FROM d JOIN v ON contains(stream, part)""",
    # A recursive walk along each page, one piece a step.
    "p2_found": """
WITH RECURSIVE pages AS (
  SELECT DISTINCT document_id, i AS page_no, pages[i] AS page FROM kb_documents, range(1, len(pages) + 1) r(i) WHERE length(pages[i]) > 420
), cut AS (
  SELECT document_id, page_no, page, NULL::BIGINT AS a, NULL::BIGINT AS b, 0::BIGINT AS nxt FROM pages
  UNION ALL
  SELECT document_id, page_no, page, s, e, CASE WHEN e < length(page) THEN e - 60 END FROM (
    SELECT document_id, page_no, page, nxt AS s, CASE WHEN nxt + 420 >= length(page) THEN length(page) ELSE coalesce(nxt + 260 + (
      SELECT max(x) FROM range(1, 161) t(x) WHERE substr(page, nxt + 260 + x, 1) IN (chr(10), '。', '！', '？') OR (x < 160 AND substr(page, nxt + 260 + x, 2) = '. ')), nxt + 420) END AS e
    FROM cut WHERE nxt IS NOT NULL)
)
SELECT DISTINCT document_id, page_no::BIGINT AS page_no, a AS char_start, b AS char_end FROM cut
WHERE a IS NOT NULL AND trim(substr(page, a + 1, b - a), ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288)) <> ''""",
}
SQL["p9_items"] = f"SELECT item_id, count(*) AS documents FROM ({SQL['p9_found']}) GROUP BY 1"
