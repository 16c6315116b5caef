"""Readable text of HTML, as an Arrow UDF over the standard parser."""
from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Elements without readable text, and elements that end a line.
HIDDEN = {"script", "style", "noscript", "template", "svg"}
BREAKS = {"p", "br", "div", "li", "h1", "h2", "h3"}


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], []

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden.append(tag)
        elif tag in BREAKS:
            self.out.append("\n")

    def handle_startendtag(self, tag, attrs):
        if tag in BREAKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if self.hidden and tag == self.hidden[-1]:
            self.hidden.pop()
        elif tag in BREAKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def readable(html: str | None, most: int | None = None) -> str | None:
    """Text without hidden elements, in NFKC, white space collapsed within lines, empty lines left out; cut only where *most* is given. Null gives null."""
    if html is None:
        return None
    reader = _Reader()
    reader.feed(html)
    reader.close()
    text = unicodedata.normalize("NFKC", "".join(reader.out))
    return "\n".join(x for x in (re.sub(r"\s+", " ", line).strip() for line in text.split("\n")) if x)[:most]


@F.arrow_udf(StringType())
def readable_text(html: pa.Array) -> pa.Array:
    return pa.array([readable(x) for x in html.to_pylist()], pa.string())
