"""Search results to admitted, clustered and ranked evidence, five items a claim.

Results meet their claim by claim id; passages and scores are computed per row in Arrow batches; everything that
compares results is a window per claim. One claim's results are bounded by its queries, not collected.

Defined results: results without claim, valid address or text give nothing; repeated rows count once; equal ranks keep
the order of url.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestia.functions import planning as P
from attestia.functions.atoms import slot_of
from attestia.functions.claims import passage
from attestia.functions.urls import host, normal_url, site, source_authority, source_kind

MOST_EVIDENCE, MOST_PASSAGES = 5, 3
#: Between passages of one page that stand apart in it.
APART = "\n\n[另一处原文片段]\n\n"
# Words of a kind of works; a title with one is about another matter unless the claim has one.
WORKS = (("歌曲", "歌词", "专辑", "歌手", "音乐", "song", "album", "singer"), ("小说", "网文", "文学作品"), ("游戏攻略", "角色技能", "手游", "游戏"))
MUSIC = ("歌曲", "专辑", "歌手", "音乐", "song", "album", "singer")
WORDS = ("词义", "成语", "俗语", "谚语", "词语", "拼写", "读音", "翻译", "idiom", "meaning", "spelling")


def planned(claims: DataFrame) -> DataFrame:
    """(claim_id, query_no from 1, query) of claims (claim_id, normalized_claim, entities, conditions)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, n, q) for i, c, e, k in zip(*(x.to_pylist() for x in b.columns)) for n, q in enumerate(P.queries(c, e or (), k or ()), 1)]
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], names=["claim_id", "query_no", "query"])

    return claims.select(F.col("claim_id").cast("string"), "normalized_claim", "entities", "conditions").mapInArrow(run, "claim_id string, query_no int, query string")


def allowed(url: Column, claim: Column, title: Column) -> Column:
    """May serve as evidence: no page of a like-named work, no social or community page, music and dictionary pages only on their matter."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    names = lambda c, words: reduce(lambda a, b: a | b, [F.contains(low(c), F.lit(w)) for w in words])
    kind, other_work = source_kind(host(url)), F.lit(False)
    for words in WORKS:
        other_work = other_work | (names(title, words) & ~names(claim, words))
    fits = F.when(kind.isin("social", "community"), False).when(kind == "entertainment", names(claim, MUSIC)).when(kind == "dictionary", names(claim, WORDS)).otherwise(True)
    return ~other_work & fits


def passages_of(body: str | None, wanted: list[str]) -> str:
    """The best passage for each of the first targets; one inside another is left out, the rest stand apart."""
    out: list[str] = []
    for target in wanted[:MOST_PASSAGES]:
        found = passage(body, P.topic_terms(target)) or ""
        if found and not any(found in o for o in out):
            out = [o for o in out if o not in found] + [found]
    return APART.join(out)


_READ = "excerpt string, usable boolean, best_part int, property int, relevance double"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, goals = [], {}
        for claim, entities, conditions, body in zip(*(b.column(c).to_pylist() for c in ("normalized_claim", "entities", "conditions", "body"))):
            key = (claim, tuple(entities or ()), tuple(conditions or ()))
            if key not in goals:
                goals[key] = [(part, topic, slot_of(part)) for part, topic in P.targets(*key)]
            text = passages_of(body, [topic for _, topic, _ in goals[key]])
            usable = [n for n, (part, topic, _) in enumerate(goals[key]) if P.usable_text(text, topic, part)]
            rows.append((text, bool(usable), usable[0] if usable else None, max((s.strength(text) if s else 0) for _, _, s in goals[key]), max(P.topic_share(text, t)[0] for _, t, _ in goals[key])))
        cols = list(zip(*rows)) or [()] * 5
        types = [pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.float64()]
        yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(cols, types))], names=[*b.schema.names, *(f.split(" ")[0] for f in _READ.split(", "))])


def admitted(results: DataFrame, claims: DataFrame) -> DataFrame:
    """(claim_id, url, title, publisher, excerpt, content_hash, form, kind, authority, property, score, relevance, best_part):
    the usable passages, each address once by its fullest text."""
    kind_of_content = F.coalesce(F.try_element_at("metadata", F.lit("content_kind")), F.lit(""))
    r = results.select("claim_id", "url", "title", "publisher", F.coalesce(F.when(F.col("content") != "", F.col("content")), "snippet").alias("body"), kind_of_content.alias("content_kind")).distinct()
    r = r.join(claims.select("claim_id", "normalized_claim", "entities", "conditions"), "claim_id").withColumn("url", normal_url(F.col("url")))
    r = r.filter(F.col("url").isNotNull() & (F.coalesce("body", F.lit("")) != "") & allowed(F.col("url"), F.col("normalized_claim"), F.col("title")))
    schema = r.schema.simpleString()[len("struct<") : -1] + "," + _READ.replace(" ", ":").replace(",:", ",")
    read = r.mapInArrow(_read, schema).filter("usable")
    fullest = Window.partitionBy("claim_id", "url").orderBy(F.col("content_kind") == "search_snippet", F.length("body").desc(), "body")
    once = read.withColumn("_r", F.row_number().over(fullest)).filter("_r = 1")
    kind = source_kind(host(F.col("url")))
    form = F.when(kind.isin("social", "community", "entertainment", "dictionary"), kind).when(F.col("content_kind") == "search_snippet", "snippet").otherwise("body")
    out = once.withColumn("kind", kind).withColumn("form", form).withColumn("authority", source_authority(F.col("kind")))
    score = F.col("relevance") * 0.5 + F.col("authority") * 0.35 + F.when(F.col("form") == "body", 0.15).otherwise(0.0)
    out = out.withColumn("score", F.round(score, 9)).withColumn("relevance", F.round("relevance", 9)).withColumn("content_hash", F.sha2("excerpt", 256))
    return out.select("claim_id", "url", "title", "publisher", "excerpt", "content_hash", "form", "kind", "authority", "property", "score", "relevance", "best_part")


def _rank() -> list[Column]:
    return [F.col("property").desc(), F.col("score").desc(), F.col("relevance").desc(), F.col("url")]


def ranked(evidence: DataFrame, most: int = MOST_EVIDENCE) -> DataFrame:
    """*evidence* with cluster_id and place: the best item of each part first, then the best of each cluster, then the rest; *most* a claim.

    Pages of one site or with one text are one cluster (sites linked by a shared text too); clusters are named in the order of their best item.
    """
    from .graph import linked_within

    keyed = evidence.withColumn("site", site(host(F.col("url"))))
    clusters = linked_within(keyed, "claim_id", "url", ["site", "content_hash"])
    e = keyed.join(clusters, ["claim_id", "url"])
    by = lambda *keys: Window.partitionBy(*keys).orderBy(*_rank())
    e = e.withColumn("in_cluster", F.row_number().over(by("claim_id", "component"))).withColumn("in_part", F.row_number().over(by("claim_id", "best_part")))
    parts = F.size(F.collect_set("best_part").over(Window.partitionBy("claim_id")))
    tier = F.when((parts > 1) & (F.col("in_part") == 1), 0).when(F.col("in_cluster") == 1, 1).otherwise(2)
    order = Window.partitionBy("claim_id").orderBy("tier", *_rank())
    e = e.withColumn("parts", parts).withColumn("tier", tier).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    e = e.withColumn("head", F.first("url").over(Window.partitionBy("claim_id", "component").orderBy(*_rank())))
    heads = e.filter(F.col("url") == F.col("head")).withColumn("cluster_no", F.row_number().over(Window.partitionBy("claim_id").orderBy(*_rank())))
    e = e.join(heads.select("claim_id", "component", "cluster_no"), ["claim_id", "component"])
    return e.withColumn("cluster_id", F.format_string("ec_%04d", "cluster_no")).drop("site", "component", "in_cluster", "in_part", "parts", "tier", "head", "cluster_no")
