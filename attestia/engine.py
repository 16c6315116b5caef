"""Entry points over a folder of tables; every method returns a DataFrame and computes nothing by itself."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestia.operators import admission, evaluation, extraction, judging, library, merging, retrieval, review
from attestia.operators.versions import latest, upsert
from attestia.session import table
from attestia.sources import sinks


class Engine:
    """tasks, claims, evidence_items, kb_documents and kb_chunks of *folder*, newest versions only."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def tasks(self) -> DataFrame:
        return latest(table(self.spark, self.folder, "tasks"), "task_id", "updated_at")

    def claims(self) -> DataFrame:
        return latest(table(self.spark, self.folder, "claims"), "claim_id", "retry_count")

    def evidence(self) -> DataFrame:
        return latest(table(self.spark, self.folder, "evidence_items"), "evidence_id", "retrieved_at")

    def documents(self) -> DataFrame:
        return latest(table(self.spark, self.folder, "kb_documents"), "document_id", "created_at")

    def extract(self, answers: DataFrame, limit: int | str = 15) -> DataFrame:
        """Claim rows of new answers (task_id, input_text)."""
        return extraction.extracted(answers, "task_id", "input_text", limit)

    def verify(self, answers: DataFrame, results: DataFrame, limit: int | str = 15) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(claims, evidence, verdicts) of new answers (task_id, input_text) against search results (claim_id, url, title,
        publisher, content, snippet, metadata). The evidence is clustered and ranked, but undecided until a judge's
        decisions are applied, so every verdict on it is 'evidence_insufficient'; opinions and unresolved claims take none."""
        claims = self.extract(answers, limit)
        asked = claims.filter("state = 'pending' AND label IS NULL")
        found = admission.ranked(admission.admitted(results, asked))
        evidence = found.select(
            F.concat(F.lit("e_"), F.substring(F.sha2(F.concat_ws("\x00", "claim_id", "url"), 256), 1, 32)).alias("evidence_id"), "claim_id", "cluster_id", "url", "title", "publisher", "excerpt", "content_hash", "authority",
            F.lit("unknown").alias("relation"), F.lit("web").alias("source_type"), F.col("form").alias("quality_reason"), F.lit(0.0).alias("relevance"), F.lit(0.0).alias("time_fit"),
            F.array().cast("array<struct<part_id:int,part_text:string,relation:string,excerpt:string>>").alias("checks"))
        return claims, evidence, judging.verdicts(claims, evidence, extraction.parts_of_claims(claims))

    def queries(self) -> DataFrame:
        """The search queries of every stored claim."""
        return admission.planned(self.claims())

    def merged(self, limit: int = 5) -> DataFrame:
        """Stored web and uploaded evidence of every claim in one list."""
        e = self.evidence().withColumn("ord", F.coalesce(F.unix_micros(F.col("retrieved_at").cast("timestamp")), F.lit(0)))
        return merging.merged(e, extraction.parts_of_claims(self.claims()), limit)

    def review(self, operations: DataFrame) -> DataFrame:
        """Events of review operations; *applied* gives the claims they leave."""
        return review.reviewed(self.tasks(), self.claims(), operations)

    def applied(self, events: DataFrame) -> DataFrame:
        return review.applied(self.claims(), events)

    def history(self, events: DataFrame) -> DataFrame:
        return review.history(events)

    def undo(self, events: DataFrame, wanted: DataFrame) -> DataFrame:
        return review.undo_codes(self.tasks(), self.claims(), events, wanted)

    def evaluate(self, rows: DataFrame) -> DataFrame:
        """JSON and Markdown report of rows with expected and predicted labels."""
        return evaluation.report(rows)

    def listing(self, tag: str | None = None, needle: str = "", offset: int = 0, limit: int = 20) -> DataFrame:
        """Documents, newest first, with their number of chunks."""
        n = table(self.spark, self.folder, "kb_chunks").groupBy("document_id").agg(F.count("*").alias("chunks"))
        return library.filtered(self.documents(), tag, needle).drop("pages").join(n, "document_id", "left").na.fill(0, ["chunks"]).orderBy(F.desc("created_at"), "document_id").offset(max(offset, 0)).limit(min(max(limit, 1), 100))

    def document(self, document_id: str) -> DataFrame:
        return self.documents().filter(F.col("document_id") == document_id)

    def reindex(self, encode, model: str) -> tuple[DataFrame, DataFrame]:
        chunks = table(self.spark, self.folder, "kb_chunks").withColumn("text", F.get_json_object("data", "$.excerpt"))
        return library.reindexed(chunks, encode, model)

    def verdicts(self) -> DataFrame:
        return judging.verdicts(self.claims(), self.evidence(), extraction.parts_of_claims(self.claims()))

    def summaries(self) -> DataFrame:
        return judging.coverage(self.claims(), self.tasks())

    def export(self, form: str = "json") -> DataFrame:
        """Reports of finished tasks, as 'json' or 'markdown'."""
        done = self.tasks().filter(F.col("status").isin("succeeded", "partial"))
        if form == "json":
            return sinks.json_reports(done, self.claims(), self.evidence())
        if form == "markdown":
            return sinks.markdown_reports(done, self.claims())
        raise ValueError(f"unknown form {form!r}")

    def search(self, queries: DataFrame, tag: str | None = None, limit: int = 5, vectors: DataFrame | None = None, model: str | None = None) -> DataFrame:
        """Hits of (query_id, query) in the chunks, all or those of documents with a tag: by keywords, and where *vectors*
        (query_id, q) of *model* are given by meaning too, fused by rank with two chunks a document at most."""
        chunks = table(self.spark, self.folder, "kb_chunks").select("chunk_id", "document_id", F.get_json_object("data", "$.excerpt").alias("excerpt"), "embedding", "embedding_model")
        if tag is not None:
            chunks = chunks.join(self.documents().filter(F.array_contains("tags", tag)).select("document_id"), "document_id", "left_semi")
        most = min(max(limit, 1), 20)
        if vectors is None:
            return retrieval.bm25(queries, "query_id", "query", chunks, "chunk_id", "excerpt", most, normalize=True)
        words = retrieval.bm25(queries, "query_id", "query", chunks, "chunk_id", "excerpt", retrieval.PER_CHANNEL, normalize=True)
        usable = chunks.filter(F.col("embedding_model") == model).select("chunk_id", library.unit_vector(F.col("embedding")).alias("v")).filter("v IS NOT NULL")
        near = retrieval.vector_topk(vectors.select("query_id", library.unit_vector(F.col("q")).alias("q")), "query_id", "q", usable, "chunk_id", "v", retrieval.PER_CHANNEL, 0.5, ties="desc")
        owner = chunks.select("chunk_id", "document_id")
        return retrieval.fused({"keyword": words.join(owner, "chunk_id"), "semantic": near.join(owner, "chunk_id")}, "query_id", "chunk_id", most, "document_id")

    def import_(self, new: DataFrame) -> DataFrame:
        """The documents of *new* whose body is not stored yet."""
        return sinks.import_documents(self.documents().withColumn("content_hash", F.sha2(F.to_json("pages"), 256)), new)

    def delete(self, ids: DataFrame) -> dict[str, DataFrame]:
        return sinks.delete_documents({"kb_documents": self.documents(), "kb_chunks": table(self.spark, self.folder, "kb_chunks")}, ids)

    def edit(self, changed: DataFrame) -> DataFrame:
        """Claims with the rows of *changed* (all columns) in place of the stored ones."""
        return upsert(self.claims(), changed, "claim_id")

    def status(self) -> DataFrame:
        chunks = table(self.spark, self.folder, "kb_chunks").agg(F.count("*").alias("chunks"), F.count("embedding").alias("embedded"))
        return self.documents().agg(F.count("*").alias("documents")).join(F.broadcast(chunks))
