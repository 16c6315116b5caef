"""Local and web evidence of a claim in one list, without giving uploads a vote of their own.

Web clusters that share a site, a hash or an excerpt become one group. An upload joins the first group with its hash or
excerpt, without linking groups; the others form one pool, which comes first. The list first covers the claim's parts,
then takes turns over the groups.

Defined results: null hashes and excerpts link nothing; items of equal address and excerpt count once; a claim without
parts is filled in turns only.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestia.functions import planning as P
from attestia.functions.urls import host, site
from attestia.session import written

from .graph import linked_within


def grouped(evidence: DataFrame) -> DataFrame:
    """*evidence* (claim_id, evidence_id, cluster_id, ord, source_type, url, excerpt, content_hash, ...) with group_no (0: the pool of uploads) and position."""
    e = evidence.withColumn("_local", F.coalesce(F.col("source_type") == "knowledge", F.lit(False))).withColumn("_slice", F.when(F.col("excerpt") != "", F.sha2("excerpt", 256)))
    web, uploads = e.filter(~F.col("_local")), e.filter("_local")
    # A page without host has no provenance; all such pages of a claim are one source.
    keyed = web.withColumn("_site", F.coalesce(F.nullif(site(host(F.col("url"))), F.lit("")), F.lit("\x01none")))
    links = linked_within(keyed, "claim_id", "cluster_id", ["_site", "content_hash", "_slice"])
    placed = keyed.join(links, ["claim_id", "cluster_id"])
    first = Window.partitionBy("claim_id", "cluster_id")
    placed = placed.withColumn("_begin", F.min("ord").over(first)).withColumn("_last", F.max("_begin").over(Window.partitionBy("claim_id", "component")))
    placed = placed.withColumn("group_no", F.dense_rank().over(Window.partitionBy("claim_id").orderBy("_last", "component")))
    keys = placed.select("claim_id", "group_no", F.explode(F.array(F.concat(F.lit("h"), F.col("content_hash")), F.concat(F.lit("s"), F.col("_slice")))).alias("_key")).filter("_key IS NOT NULL AND _key <> 'h'").groupBy("claim_id", "_key").agg(F.min("group_no").alias("group_no"))
    asked = uploads.select("claim_id", "evidence_id", F.explode(F.array(F.concat(F.lit("h"), F.col("content_hash")), F.concat(F.lit("s"), F.col("_slice")))).alias("_key"))
    joined = asked.join(keys, ["claim_id", "_key"]).groupBy("claim_id", "evidence_id").agg(F.min("group_no").alias("group_no"))
    uploads = uploads.join(joined, ["claim_id", "evidence_id"], "left").withColumn("group_no", F.coalesce("group_no", F.lit(0))).withColumn("_begin", F.lit(0))
    both = placed.select(*e.columns, "_begin", "group_no").unionByName(uploads.select(*e.columns, "_begin", "group_no"))
    # What the web returned stands before an upload of the same text; of merged clusters the later one comes first.
    turn = Window.partitionBy("claim_id", "group_no").orderBy("_local", F.col("_begin").desc(), "ord", "evidence_id")
    return both.withColumn("position", F.row_number().over(turn)).drop("_begin", "_slice")


def covering(evidence: DataFrame, parts: DataFrame) -> DataFrame:
    """*evidence* with covers: the numbers of the claim's parts that the excerpt is about; empty for a claim of one part."""
    lists = parts.groupBy("claim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("part_id", "part_text"))), lambda p: p["part_text"]).alias("_parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked: dict[str, str] = {}
            got = []
            for text, some in zip(b.column("excerpt").to_pylist(), b.column("_parts").to_pylist()):
                some = some if some and len(some) > 1 else []
                got.append([n for n, p in enumerate(some, 1) if P.usable_text(text, asked.setdefault(p, P.neutral(p)), p)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.list_(pa.int32()))], names=[*b.schema.names, "covers"])

    # Spread by item: the Python work is far more than the bytes that partitions are sized by.
    both = evidence.join(lists, "claim_id", "left").repartition(max(evidence.sparkSession.sparkContext.defaultParallelism, 1), "evidence_id")
    return both.mapInArrow(run, both.schema.simpleString()[len("struct<") : -1] + ",covers:array<int>").drop("_parts")


def merged(evidence: DataFrame, parts: DataFrame, limit: int = 5) -> DataFrame:
    """(claim_id, cluster_id, evidence_id, slot): at most *limit* items a claim, in groups named ec_0001 onwards."""
    e = written(covering(grouped(evidence), parts), "covered")
    same = Window.partitionBy("claim_id", "url", "excerpt").orderBy("_local", "position", "group_no", "evidence_id")
    e = e.withColumn("_n", F.row_number().over(same)).filter("_n = 1")
    # Only these can be chosen, so that a claim with any number of items stays a small group.
    turn = Window.partitionBy("claim_id").orderBy("position", "group_no")
    best = Window.partitionBy("claim_id", "covers").orderBy("_local", F.col("authority").desc_nulls_last(), "group_no", "position")
    e = e.withColumn("turn", F.row_number().over(turn)).withColumn("_best", F.row_number().over(best))
    e = e.filter((F.col("turn") <= 2 * limit) | ((F.size("covers") > 0) & (F.col("_best") <= limit)))

    # A claim's few candidates travel as one row.
    item = F.struct("turn", "covers", (~F.col("_local")).alias("web"), F.coalesce("authority", F.lit(0.0)).alias("authority"), "group_no", "evidence_id")
    rows = e.groupBy("claim_id").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for claim, items in zip(b.column("claim_id").to_pylist(), b.column("items").to_pylist()):
                left, picked = {p for r in items for p in r["covers"]}, []
                while left and len(picked) < limit:
                    r = max(items, key=lambda r: (len(left.intersection(r["covers"])), r["web"], r["authority"], -r["turn"]))
                    if not left.intersection(r["covers"]):
                        break
                    left -= set(r["covers"])
                    picked.append(r)
                    items.remove(r)
                picked += items[: limit - len(picked)]
                names = {no: f"ec_{n:04d}" for n, no in enumerate(sorted({r["group_no"] for r in picked}), 1)}
                out += [(claim, names[r["group_no"]], r["evidence_id"], slot) for slot, r in enumerate(picked, 1)]
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:3]), pa.array(cols[3], pa.int32())], names=["claim_id", "cluster_id", "evidence_id", "slot"])

    return rows.mapInArrow(choose, "claim_id string, cluster_id string, evidence_id string, slot int")
