"""The Python functions under SQL names."""
from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from attestia.functions.atoms import atoms, resolved, slot_of
from attestia.functions.claims import kind_of, plain, statements, units_before
from attestia.functions.text import nfkc
from attestia.functions.text import plain as plain_text
from attestia.functions.units import make_finder
from attestia.operators.extraction import best_passage, ground_quote, judgment_parts
from attestia.sources.html import readable_text


class Statements:
    """SELECT * FROM statements(text): the statements of one text with UTF-16 offsets."""

    def eval(self, text: str):
        t = (text or "").strip()
        for n, (a, b) in enumerate(statements(t), 1):
            yield n, t[a:b], units_before(t, a), units_before(t, b), kind_of(plain(t[a:b]))


class Atoms:
    """SELECT * FROM atomic_claims(text): the atomic claims of one text, references resolved, with UTF-16 offsets."""

    def eval(self, text: str):
        t = (text or "").strip()
        for n, c in enumerate(resolved(t, atoms(t)), 1):
            yield n, c.source, units_before(t, c.start), units_before(t, c.end), c.normalized


class Slots:
    """SELECT * FROM fact_slot(text): the property a plain claim states; no row where it states none."""

    def eval(self, text: str):
        if (s := slot_of(text)) is not None:
            yield s.subject, s.scope, s.name, list(s.cues)


class Amounts:
    """SELECT * FROM amounts(text): each amount with its unit."""

    def __init__(self):
        self.find = make_finder()

    def eval(self, text: str):
        for unit, value in self.find(text):
            yield unit, float(value)


def register(spark: SparkSession) -> None:
    for name, f in (("nfkc", nfkc), ("readable_text", readable_text), ("ground_quote", ground_quote), ("best_passage", best_passage), ("plain", plain_text), ("judgment_parts", judgment_parts)):
        spark.udf.register(name, f)
    spark.udtf.register("statements", udtf(Statements, returnType="number int, source_text string, char_start int, char_end int, claim_type string"))
    spark.udtf.register("atomic_claims", udtf(Atoms, returnType="number int, source_text string, char_start int, char_end int, normalized_claim string"))
    spark.udtf.register("fact_slot", udtf(Slots, returnType="subject string, scope string, property string, cues array<string>"))
    spark.udtf.register("amounts", udtf(Amounts, returnType="unit string, amount double"))
