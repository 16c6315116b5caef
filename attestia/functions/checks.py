"""Request checks as error columns, settings with bounds, codes and messages, and what is shown for values. All built in."""
from __future__ import annotations

import math
import os
from dataclasses import dataclass, fields
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import OUTER
from .urls import valid_url

# Bounds of a request.
TEXT_MOST, CLAIMS_MOST, NAME_MOST, URL_MOST, TAGS_MOST, TAG_MOST, QUERY_MOST, HITS_MOST = 20_000, 15, 200, 2_000, 20, 50, 500, 20
# Answers of a provider that mean something else than a fault of its own.
STATUS_CODES = {
    "search": {401: "SEARCH_AUTH", 403: "SEARCH_FORBIDDEN", 429: "SEARCH_RATE_LIMIT", 432: "SEARCH_QUOTA", 433: "SEARCH_QUOTA", 408: "SEARCH_TIMEOUT"},
    "judge": {401: "MODEL_AUTH", 403: "MODEL_FORBIDDEN", 402: "MODEL_QUOTA", 429: "MODEL_RATE_LIMIT", 408: "MODEL_TIMEOUT"},
}
#: After these a provider is not asked again.
PERMANENT = ("SEARCH_AUTH", "SEARCH_FORBIDDEN", "SEARCH_QUOTA", "SEARCH_NETWORK_PERMISSION")
MESSAGES = {
    "SEARCH_AUTH": "the search key was refused", "SEARCH_FORBIDDEN": "the search service refused access", "SEARCH_QUOTA": "the search quota is used up", "SEARCH_RATE_LIMIT": "too many searches at once", "SEARCH_TIMEOUT": "the search took too long",
    "MODEL_AUTH": "the model key was refused", "MODEL_QUOTA": "the model quota is used up", "MODEL_TIMEOUT": "the model took too long", "PIPELINE_INTERNAL": "the run failed", "RETRY_INTERNAL": "the retry failed",
}


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, OUTER, "")


def _listed(checks: dict[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in checks.items()]), lambda x: x.isNotNull())


def task_errors() -> Column:
    """Of input_text and claim_limit: blank, too long after trimming, a limit out of bounds."""
    text, limit = trimmed(F.coalesce("input_text", F.lit(""))), F.col("claim_limit")
    return _listed({"text_blank": text == "", "text_long": F.char_length(text) > TEXT_MOST, "claim_limit": limit.isNull() | (limit < 1) | (limit > CLAIMS_MOST)})


def import_errors() -> Column:
    """Of title, publisher, source_url, tags, content and file (base64): exactly one of text and file, lengths, address, tags."""
    blank = lambda c: trimmed(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    tags = F.transform("tags", trimmed)
    return _listed({
        "title": blank("title") | (F.char_length(trimmed(F.col("title"))) > NAME_MOST), "publisher": F.char_length("publisher") > NAME_MOST, "source_url": ~blank("source_url") & (~valid_url(F.col("source_url")) | (F.char_length("source_url") > URL_MOST)),
        "tags": F.exists(tags, lambda t: F.char_length(t) > TAG_MOST) | (F.size(F.array_distinct(F.filter(tags, lambda t: t != ""))) > TAGS_MOST), "one_of_content_and_file": blank("content") == blank("file"),
    })


def search_errors() -> Column:
    """Of query and limit."""
    q = trimmed(F.coalesce("query", F.lit("")))
    return _listed({"query": (q == "") | (F.char_length(q) > QUERY_MOST), "limit": F.col("limit").isNull() | (F.col("limit") < 1) | (F.col("limit") > HITS_MOST)})


def status_code(status: Column, provider: str) -> Column:
    """The code of a provider's answer; null for an answer that is none (2xx)."""
    known = F.create_map(*[F.lit(x) for k, v in STATUS_CODES[provider].items() for x in (k, v)])
    other = {"search": "SEARCH_UNAVAILABLE", "judge": "MODEL_UNAVAILABLE"}[provider]
    return F.when(~status.between(200, 299), F.coalesce(F.try_element_at(known, status), F.lit(other)))


def message(code: Column) -> Column:
    """What may be told of a code; the same words for any that isn't listed."""
    known = F.create_map(*[F.lit(x) for k, v in MESSAGES.items() for x in (k, v)])
    return F.when(code.isNotNull(), F.coalesce(F.try_element_at(known, code), F.lit("the service is not available")))


def attempted(results: DataFrame) -> DataFrame:
    """*results* (claim_id, query_no, code, ...) with *asked*: queries after a claim's first permanent code are not asked."""
    from pyspark.sql import Window

    first = F.min(F.when(F.col("code").isin(*PERMANENT), F.col("query_no"))).over(Window.partitionBy("claim_id"))
    return results.withColumn("asked", first.isNull() | (F.col("query_no") <= first))


def bounded_block(text: Column, label: str = "EVIDENCE") -> Column:
    """Foreign text between two marks that it cannot contain itself."""
    safe = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("<<<"), F.lit("‹‹‹")), F.lit(">>>"), F.lit("›››"))
    return F.concat(F.lit(f"<<<{label}\n"), safe, F.lit(f"\n{label}>>>"))


def judge_request() -> Column:
    """The evidence of a judge's request as JSON of bounded fields inside a marked block."""
    cut = lambda c, n: F.left(F.coalesce(F.col(c), F.lit("")), F.lit(n)).alias(c)
    return bounded_block(F.to_json(F.struct("evidence_id", cut("title", 200), cut("publisher", 100), cut("excerpt", 1000), cut("quality_reason", 250))))


def percent_shown(share: Column) -> Column:
    """Whole percent, halves up; n/a for null."""
    return F.coalesce(F.concat(F.floor(share * 100 + 0.5).cast("string"), F.lit("%")), F.lit("n/a"))


def day_shown(at: Column) -> Column:
    return F.coalesce(F.date_format(at, "yyyy-MM-dd"), F.lit("n/a"))


def file_badge(name: Column) -> Column:
    """Kind of an upload by its suffix."""
    suffix = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    return F.when(suffix == "pdf", "PDF").when(suffix == "docx", "DOCX").when(suffix.isin("md", "markdown"), "MD").when(suffix == "txt", "TXT").otherwise("FILE")


def author_form(name: Column) -> Column:
    """Lower case, signs to spaces, collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))


def paper_record(record: Column) -> Column:
    """(title, authors, year, journal, doi) of a JSON record in either of the two common shapes."""
    from .text import normal_doi, year_of

    at = lambda path: F.get_json_object(record, path)
    first = lambda *paths: F.coalesce(*[F.when(at(p) != "", at(p)) for p in paths])
    people = F.from_json(F.coalesce(at("$.authors"), at("$.author"), F.lit("[]")), "array<struct<name:string,given:string,family:string>>")
    authors = F.filter(F.transform(people, lambda a: author_form(F.coalesce(a["name"], F.concat_ws(" ", a["given"], a["family"])))), lambda x: x != "")
    year = year_of(first("$.published.date-parts[0][0]", "$.published-print.date-parts[0][0]", "$.publicationDate", "$.year"))
    return F.struct(first("$.title[0]", "$.title").alias("title"), authors.alias("authors"), year.alias("year"), first("$.container-title[0]", "$.container-title", "$.venue", "$.journal.name", "$.journal").alias("journal"), normal_doi(first("$.DOI", "$.doi", "$.externalIds.DOI")).alias("doi"))


def paper_support(evidence: DataFrame) -> DataFrame:
    """(citation_id, status) of evidence (citation_id, relation, quote, excerpt): only quotes that stand in their excerpt count."""
    grounded = F.coalesce((F.col("quote") != "") & F.contains(F.col("excerpt"), F.col("quote")), F.lit(False))
    g = evidence.groupBy("citation_id").agg(F.bool_or(grounded & F.col("relation").isin("supports", "partially_supports")).alias("yes"), F.bool_or(grounded & (F.col("relation") == "refutes")).alias("no"))
    return g.select("citation_id", F.when(F.col("yes") & F.col("no"), "conflicting").when(F.col("yes"), "supported").when(F.col("no"), "not_supported").otherwise("insufficient_evidence").alias("status"))


@dataclass(frozen=True)
class Settings:
    """Limits of a run, each within its bounds; from the environment under *prefix*, the default where a value is no number."""

    input_characters: int = 20_000
    claims: int = 15
    queries: int = 3
    evidence: int = 5
    retries: int = 2
    deadline_seconds: float = 180.0
    concurrency: int = 3

    BOUNDS: ClassVar = {"input_characters": (1, 20_000), "claims": (1, 15), "queries": (1, 3), "evidence": (1, 5), "retries": (0, 2), "deadline_seconds": (1.0, 600.0), "concurrency": (1, 8)}

    @classmethod
    def read(cls, environment: dict[str, str] | None = None, prefix: str = "ATTESTIA_") -> Settings:
        given, out = os.environ if environment is None else environment, {}
        for f in fields(cls):
            try:
                value = float(given[prefix + f.name.upper()])
                if not math.isfinite(value):
                    raise ValueError
            except (KeyError, ValueError):
                continue
            low, high = cls.BOUNDS[f.name]
            out[f.name] = type(f.default)(min(max(value, low), high))
        return cls(**out)
