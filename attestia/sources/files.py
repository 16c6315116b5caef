"""Document files as (path, filename, pages, error) tables: text, Markdown, DOCX and, where a reader is installed, PDF.

A file that cannot be read becomes a row with *error* and no pages. Files of no bytes never reach the
reader: Spark passes over them when it plans the scan.
"""
from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Limits of one upload.
MOST_BYTES, MOST_CHARS, MOST_PAGES, MOST_INFLATED = 2 * 1024 * 1024, 100_000, 100, 20 * 1024 * 1024
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_text(data: bytes) -> list[str]:
    """Strict UTF-8, with or without a byte order mark; all line ends become \\n."""
    return [data.decode("utf-8-sig").replace("\r\n", "\n").replace("\r", "\n")]


def read_docx(data: bytes) -> list[str]:
    """Paragraphs and tables in order; cells are separated by tabs and rows by line breaks, a merged cell counts once."""
    import xml.etree.ElementTree as ET
    import zipfile

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if sum(i.file_size for i in z.infolist()) > MOST_INFLATED:
            raise ValueError("DOCUMENT_TOO_LARGE")
        xml = z.read("word/document.xml")
    if b"<!DOCTYPE" in xml or b"<!ENTITY" in xml:
        raise ValueError("DOCUMENT_INVALID")

    def paragraph(node) -> str:
        out = []
        for x in node.iter():
            if x.tag == _W + "t":
                out.append(x.text or "")
            elif x.tag == _W + "tab":
                out.append("\t")
            elif x.tag in (_W + "br", _W + "cr"):
                out.append("\n")
        return "".join(out)

    def block(node, depth: int) -> list[str]:
        if depth > 32:
            raise ValueError("DOCUMENT_INVALID")
        out = []
        for x in node:
            if x.tag == _W + "p":
                out.append(paragraph(x))
            elif x.tag == _W + "tbl":
                for row in x.findall(_W + "tr"):
                    cells = []
                    for cell in row.findall(_W + "tc"):
                        merge = cell.find(f"{_W}tcPr/{_W}vMerge")
                        again = merge is not None and merge.get(_W + "val", "continue") == "continue"
                        cells.append("" if again else "\n".join(block(cell, depth + 1)))
                    out.append("\t".join(cells))
            elif x.tag in (_W + "sdt", _W + "sdtContent"):
                out += block(x, depth + 1)
        return out

    body = ET.fromstring(xml).find(_W + "body")
    return ["\n".join(block(body, 0))] if body is not None else [""]


def read_pdf(data: bytes) -> list[str]:
    try:
        from pypdf import PdfReader
    except ImportError:
        raise ValueError("PDF_READER_MISSING") from None
    reader = PdfReader(io.BytesIO(data))
    if reader.is_encrypted or len(reader.pages) > MOST_PAGES:
        raise ValueError("DOCUMENT_INVALID")
    return [p.extract_text() or "" for p in reader.pages]


def read_pages(name: str, data: bytes | None) -> tuple[list[str] | None, str | None]:
    """(pages, None) or (None, error code)."""
    if not data:
        return None, "DOCUMENT_EMPTY"
    if len(data) > MOST_BYTES:
        return None, "DOCUMENT_TOO_LARGE"
    reader = {"txt": read_text, "md": read_text, "markdown": read_text, "docx": read_docx, "pdf": read_pdf}.get(name.rsplit(".", 1)[-1].lower() if "." in name else "")
    if reader is None:
        return None, "DOCUMENT_TYPE"
    try:
        pages = reader(data)
    except UnicodeDecodeError:
        return None, "DOCUMENT_ENCODING"
    except ValueError as e:
        return None, str(e) if str(e).isupper() else "DOCUMENT_INVALID"
    except Exception:
        return None, "DOCUMENT_INVALID"
    if not any(p.strip() for p in pages):
        return None, "DOCUMENT_EMPTY"
    return (pages, None) if sum(map(len, pages)) <= MOST_CHARS else (None, "DOCUMENT_TOO_LARGE")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, filename, pages, error) of the files under *path*; parsing runs in the executors' Python workers."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            paths = part.column(0).to_pylist()
            read = [read_pages(p.rsplit("/", 1)[-1], d) for p, d in zip(paths, part.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([p.rsplit("/", 1)[-1] for p in paths]), pa.array([r[0] for r in read], pa.list_(pa.string())), pa.array([r[1] for r in read], pa.string())], names=["path", "filename", "pages", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInArrow(run, "path string, filename string, pages array<string>, error string")
