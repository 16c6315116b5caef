"""Cutting oversized pages at natural boundaries, with overlap and exact code-point offsets.

Two operators share one table of boundaries:

* bisect_pieces: recursive bisection. Cut at the strongest boundary near the midpoint, recurse on
  halves still over the limit less the overlap, then start every later piece one overlap early.
* forward_pieces: a piece ends at the last boundary of a fixed window, the next starts a fixed overlap
  before that end. Each cut depends on the one before, so bisection cannot give these offsets; the
  page is scanned once, with one search a piece.

Defined results: null and blank pages and pages within the limit give no piece of forward_pieces
(whole pages within the limit are one piece of bisect_pieces); pieces of white space only are left
out; documents delivered twice give their pieces once; pages of any length are processed whole.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the chunk layout.
LIMIT, SEARCH_FROM, OVERLAP = 420, 260, 60
# Boundaries that end a piece just after their first character.
MARKS = ("\n", "。", "！", "？", ". ")


def forward_cuts(text: str, limit: int = LIMIT, search_from: int = SEARCH_FROM, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    start, n, out = 0, len(text), []
    while True:
        end = start + limit
        if end >= n:
            end = n
        else:
            best = max(text.rfind(mark, start + search_from, end) for mark in MARKS)
            if best >= 0:
                end = best + 1
        if not text[start:end].isspace():
            out.append((start, end))
        if end >= n:
            return out
        start = end - overlap


def bisect_cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    room, cuts = limit - overlap, []
    # Strongest first: paragraph, line, sentence, clause, word.
    ladder = (("\n\n",), ("\n",), ("。", "！", "？", ". ", "! ", "? "), ("；", "，", "; ", ", "), (" ",))
    todo = [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if b - a <= (limit if a == 0 and b == len(text) else room):
            continue
        mid, reach, cut = (a + b) // 2, max(1, (b - a) // 4), 0
        for marks in ladder:
            found = []
            for mark in marks:
                if (left := text.rfind(mark, max(a, mid - reach), mid)) >= 0:
                    found.append(left + len(mark))
                if (right := text.find(mark, mid, min(b, mid + reach))) >= 0:
                    found.append(right + len(mark))
            found = [x for x in found if a < x < b]
            if found:
                cut = min(found, key=lambda x: (abs(x - mid), x))
                break
        cut = cut or mid
        cuts.append(cut)
        todo += [(a, cut), (cut, b)]
    ends = sorted(cuts) + [len(text)]
    starts = [0, *sorted(cuts)]
    return [(max(0, a - overlap) if a else 0, b) for a, b in zip(starts, ends) if text[a:b].strip()]


def _run(cutter, minimum: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            docs, nos, starts, ends = [], [], [], []
            for doc, no, text in zip(*(c.to_pylist() for c in part.columns)):
                if not text or len(text) <= minimum or text.isspace():
                    continue
                for a, b in cutter(text):
                    docs.append(doc)
                    nos.append(no)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), pa.array(nos, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["document_id", "page_no", "char_start", "char_end"])

    return run


def pages_of(documents: DataFrame) -> DataFrame:
    """(document_id, page_no, page) of a table with *document_id* and *pages*, page_no from 1."""
    return documents.select(F.col("document_id").cast("string").alias("document_id"), F.posexplode("pages").alias("at", "page")).select("document_id", (F.col("at") + 1).cast("bigint").alias("page_no"), "page")


_OUT = "document_id string, page_no bigint, char_start bigint, char_end bigint"


def forward_pieces(documents: DataFrame, limit: int = LIMIT, search_from: int = SEARCH_FROM, overlap: int = OVERLAP) -> DataFrame:
    pages = pages_of(documents).filter(F.char_length("page") > limit)
    return pages.mapInArrow(_run(lambda t: forward_cuts(t, limit, search_from, overlap), limit), _OUT).distinct()


def bisect_pieces(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    return pages_of(documents).mapInArrow(_run(lambda t: bisect_cuts(t, limit, overlap), 0), _OUT).distinct()
