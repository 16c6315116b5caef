"""Text expressions; built in except for Unicode normalisation, which is an Arrow UDF."""
from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .claims import plain as plain_text

# Latin words and Chinese words that are no search terms.
STOP = ("the", "is", "of", "in", "on", "a", "an", "and", "to", "for", "with", "by", "from", "are", "be")
CJK_STOP = ("的", "是", "在", "于", "为", "和", "与", "及", "了")
TERM = r"[A-Za-z][A-Za-z0-9]*(?:[-_/][A-Za-z0-9]+)*|\d+(?:[.,]\d+)?%?|[㐀-鿿]+"
#: White space at either end, of any kind.
_OUTER = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
OUTER = f"^{_OUTER}|{_OUTER}$"
#: A clause with its mark; brackets, titles and numbers are passed over whole.
CLAUSE = r"(?:《[^《》]*》|（[^（）]*）|\([^()]*\)|\[[^\[\]]*\]|【[^【】]*】|\d+(?:[，,；;]\d+)*|[^，,；;])+[，,；;]?"


@F.arrow_udf(StringType())
def nfkc(text: pa.Array) -> pa.Array:
    """Unicode NFKC, which Spark has no function for."""
    return pa.array([None if t is None else t if t.isascii() else unicodedata.normalize("NFKC", t) for t in text.to_pylist()], pa.string())


def terms(text: Column, normalize: bool = False) -> Column:
    """Distinct search terms in order: identifiers and numbers of two signs or more, Chinese runs of one or two characters
    and the pairs of longer ones; no stop words.

    Lower case, so that equal terms meet. Null gives an empty list. *normalize* puts the text in NFKC first, which needs
    Python; without it everything stays in the JVM and the text counts as it is stored.
    """
    form = F.coalesce(nfkc(text) if normalize else text, F.lit(""))
    runs = F.regexp_extract_all(F.lower(form), F.lit(TERM), F.lit(0))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(r) - 1, F.lit(1))), lambda i: F.substr(r, i, F.lit(2)))
    wide = lambda r: r.rlike("^[㐀-鿿]")
    split = F.flatten(F.transform(runs, lambda r: F.when(wide(r), pairs(r)).otherwise(F.array(r))))
    return F.array_distinct(F.filter(split, lambda t: F.when(wide(t), ~t.isin(*CJK_STOP)).otherwise((F.char_length(t) > 1) & ~t.isin(*STOP))))


def clause_parts(text: Column, most: int = 8) -> Column:
    """The clauses of a claim that evidence has to cover, cut after commas and semicolons outside brackets and numbers; the last holds all beyond *most*."""
    cut = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CLAUSE), F.lit(0)), lambda p: F.regexp_replace(p, OUTER, ""))
    parts = F.filter(cut, lambda p: p != "")
    return F.when(F.size(parts) > most, F.concat(F.slice(parts, 1, most - 1), F.array(F.array_join(F.slice(parts, F.lit(most), F.size(parts)), "")))).otherwise(parts)


def utf16_length(text: Column) -> Column:
    """UTF-16 code units of a string."""
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def utf16_slice(text: Column, start: Column, end: Column) -> Column:
    """Code units start .. end; null where the range is empty, out of bounds or splits a surrogate pair."""
    raw = F.encode(text, "UTF-16LE")
    piece = F.substring(raw, start * 2 + 1, (end - start) * 2)
    first, last = F.hex(F.substring(piece, 2, 1)), F.hex(F.substring(piece, F.octet_length(piece), F.lit(1)))
    split = first.between("DC", "DF") | last.between("D8", "DB")
    return F.when((start >= 0) & (end > start) & (end * 2 <= F.octet_length(raw)) & ~split, F.decode(piece, "UTF-16LE"))


def collapse(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


@F.arrow_udf(StringType())
def plain(text: pa.Array) -> pa.Array:
    """NFKC text without Markdown presentation, as claims are normalized."""
    return pa.array([None if t is None else plain_text(t) for t in text.to_pylist()], pa.string())


def markdown_escaped(text: Column) -> Column:
    """Text that Markdown and HTML show as it is."""
    out = F.replace(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.regexp_replace(out, r"([\\`*_{}\[\]()#+\-.!|])", r"\\$1")


def normal_doi(raw: Column) -> Column:
    """A DOI without resolver, prefix and trailing punctuation; null where none is left."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(raw)), r"^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", ""), r"[.,;:)\]}]+$", "")
    return F.when(bare.rlike(r"^10\.\d{4,9}/\S+$"), bare)


def year_of(raw: Column) -> Column:
    """The first year of four digits; null where none."""
    y = F.regexp_extract(raw, r"\b([1-9]\d{3})\b", 1)
    return F.when(y != "", y.cast("int"))
