"""Answers to claim rows, grounded quotes, passages and citation checks, as Arrow batches over pure functions."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from attestia.functions import atoms
from attestia.functions.claims import cited, grounded, kind_of, passage, units_before

CLAIMS = (
    "claim_id string, task_id string, number int, found int, source_text string, char_start int, char_end int, claim_type string, normalized_claim string, "
    "entities array<string>, conditions array<string>, label string, state string, unchecked_reason string"
)


def segmented(answers: DataFrame, segments: DataFrame) -> DataFrame:
    """(task_id, method, claims array<struct<start,end,source,normalized>>) of answers (task_id, input_text) by proposed
    segments (task_id, ord, source, context): 'model' where the proposal holds, else 'rules_fallback'; 'rules' without one.

    A segmenter is any table of segments. Null and blank answers have no claims.
    """
    lists = segments.groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "source", "context"))), lambda s: F.struct(s["source"].alias("source"), s["context"].alias("context"))).alias("segments"))
    both = answers.select(F.col("task_id").cast("string"), "input_text").join(lists, "task_id", "left")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("source", pa.string()), ("normalized", pa.string())]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            methods, found = [], []
            for text, given in zip(part.column("input_text").to_pylist(), part.column("segments").to_pylist()):
                text, method = (text or "").strip(), "rules" if given is None else "model"
                try:
                    claims = atoms.partition(text, [(s["source"], s["context"] or "") for s in given]) if given is not None else atoms.atoms(text)
                except atoms.PartitionError:
                    method, claims = "rules_fallback", atoms.atoms(text)
                methods.append(method)
                found.append([c._asdict() for c in claims])
            yield pa.RecordBatch.from_arrays([part.column("task_id"), pa.array(methods, pa.string()), pa.array(found, kind)], names=["task_id", "method", "claims"])

    return both.mapInArrow(run, "task_id string, method string, claims array<struct<start:int,end:int,source:string,normalized:string>>")


def extracted(answers: DataFrame, key: str, text: str, limit: int | str = 15) -> DataFrame:
    """Atomic claim rows of every answer: at most *limit* (a number or a column), with the number found; offsets in
    UTF-16 units of the stripped text.

    References are resolved within their paragraph; a claim that still begins with one is 'unchecked'. Opinions are
    'not_applicable'. The id is a digest of task, number and source, so a recomputed row keeps it. Null and blank
    answers and limits of 0 give no row, a null limit is 15; repeated rows are read once each, so deliver one row a key.
    """
    import hashlib

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for k, t, most in zip(*(c.to_pylist() for c in part.columns)):
                t = (t or "").strip()
                found = atoms.atoms(t)
                for n, c in enumerate(atoms.resolved(t, found[: max(0, 15 if most is None else most)]), 1):
                    start, kind = units_before(t, c.start), kind_of(c.normalized)
                    name = "c_" + hashlib.sha256(f"{k}\0{n}\0{c.source}".encode("utf-8", "surrogatepass")).hexdigest()[:32]
                    lost = atoms.unresolved(c.source, c.normalized)
                    rows.append((
                        name, k, n, len(found), c.source, start, start + units_before(c.source, len(c.source)), kind, c.normalized, atoms.names_of(c.normalized), atoms.limits_of(c.normalized),
                        "not_applicable" if kind == "opinion" else None, "unchecked" if lost else "pending", "unresolved_reference" if lost else None,
                    ))
            names = [f.split(" ")[0] for f in CLAIMS.split(", ")]
            types = [{"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}[f.split(" ")[1]] for f in CLAIMS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(names), types)], names=names)

    most = F.col(limit) if isinstance(limit, str) else F.lit(limit)
    return answers.select(F.col(key).cast("string"), F.col(text), most.cast("int")).mapInArrow(run, CLAIMS)


@F.arrow_udf(ArrayType(StringType()))
def judgment_parts(text: pa.Array) -> pa.Array:
    """The facts of a claim that must each be shown; null and blank claims have none."""
    return pa.array([atoms.judgment_parts(t) for t in text.to_pylist()], pa.list_(pa.string()))


def parts_of_claims(claims: DataFrame) -> DataFrame:
    """(claim_id, part_id from 1, part_text) of every claim."""
    return claims.select("claim_id", F.posexplode(judgment_parts("normalized_claim")).alias("n", "part_text")).select("claim_id", (F.col("n") + 1).alias("part_id"), "part_text")


@F.arrow_udf(StringType())
def ground_quote(quote: pa.Array, body: pa.Array) -> pa.Array:
    return pa.array([grounded(q, b) for q, b in zip(quote.to_pylist(), body.to_pylist())], pa.string())


@F.arrow_udf(StringType())
def best_passage(body: pa.Array, terms: pa.Array) -> pa.Array:
    """The passage of a page for a list of terms; null pages give null, null lists count as empty."""
    return pa.array([passage(b, t or []) for b, t in zip(body.to_pylist(), terms.to_pylist())], pa.string())


def citation_checks(wanted: DataFrame, records: DataFrame) -> DataFrame:
    """(citation_id, status, record_no) of citations (citation_id, title, authors, year, doi) against records of the same id (ord, ...)."""
    lists = records.groupBy("citation_id").agg(F.array_sort(F.collect_list(F.struct("ord", "title", "authors", "year", "doi"))).alias("records"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = part.to_pylist()
            got = [cited(r, r["records"] or []) for r in rows]
            yield pa.RecordBatch.from_arrays([part.column("citation_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int32())], names=["citation_id", "status", "record_no"])

    both = wanted.select("citation_id", "title", "authors", "year", "doi").join(lists, "citation_id", "left")
    return both.mapInArrow(run, f"citation_id {dict(wanted.dtypes)['citation_id']}, status string, record_no int")
