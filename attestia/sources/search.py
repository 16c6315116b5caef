"""Web search as a table of results: an exact lookup by normalised query."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestia.functions.text import collapse


def query_key(query: Column) -> Column:
    return F.lower(collapse(query))


def search(queries: DataFrame, results: DataFrame, limit: int = 5) -> DataFrame:
    """*queries* (query_id, query) joined with the first *limit* of *results* (query, ord, ...) for the same query text.

    Blank and null queries find nothing; a negative limit gives none.
    """
    asked = queries.withColumn("_key", query_key(F.col("query"))).filter("_key <> ''")
    w = Window.partitionBy("_key").orderBy("ord")
    some = results.withColumn("_key", query_key(F.col("query"))).drop("query").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).drop("_n")
    return asked.join(some, "_key").drop("_key")


_SITES = r"\A(.+?)\s+\((site:[A-Za-z0-9.-]+(?: OR site:[A-Za-z0-9.-]+)*)\)\z"


def web_search(queries: DataFrame, pages: DataFrame, limit: int = 5) -> DataFrame:
    """*queries* (query_id, query) against *pages* (query, ord, url, title, snippet, raw_content, published_at, score): the
    first *limit* (1 to 5) for the query without its "(site:a OR site:b)" suffix, which becomes a filter on the host.

    Whole text is preferred to a snippet and marked as such; pages without address are left out.
    """
    from attestia.functions.urls import host

    asked = queries.withColumn("_q", collapse("query")).withColumn("_plain", F.regexp_extract("_q", _SITES, 1))
    asked = asked.select("query_id", query_key(F.when(F.col("_plain") != "", F.col("_plain")).otherwise(F.col("_q"))).alias("_key"), F.slice(F.regexp_extract_all(F.regexp_extract("_q", _SITES, 2), F.lit(r"site:([A-Za-z0-9.-]+)"), F.lit(1)), 1, 5).alias("_sites")).filter("_key <> ''")
    found = pages.filter(F.coalesce(F.trim("url"), F.lit("")) != "").withColumn("_key", query_key(F.col("query"))).drop("query").withColumn("_host", host(F.col("url")))
    hits = asked.join(found, "_key").filter((F.size("_sites") == 0) | F.exists("_sites", lambda s: (F.col("_host") == F.lower(s)) | F.endswith(F.col("_host"), F.concat(F.lit("."), F.lower(s)))))
    hits = hits.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("ord", "url"))).filter(F.col("_n") <= min(max(limit, 1), 5))
    whole = F.coalesce(F.trim("raw_content"), F.lit("")) != ""
    content = F.when(whole, F.col("raw_content")).otherwise(F.when(F.col("snippet") != "", F.col("snippet")))
    kept = F.map_filter(F.create_map(F.lit("provider_score"), F.col("score").cast("string"), F.lit("content_kind"), F.when(whole, "raw_text").otherwise("search_snippet")), lambda _, v: v.isNotNull())
    return hits.select("query_id", "ord", "url", "title", F.coalesce("snippet", F.lit("")).alias("snippet"), content.alias("content"), F.col("_host").alias("publisher"), "published_at", kept.alias("metadata"))
