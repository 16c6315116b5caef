"""One spelling for texts that look the same.

Tokens that the look-alike table changes or that mix scripts are the suspects; their spellings, counted over
all texts, form vocabulary tries. A weighted edit automaton traverses a trie with a token: drawing the same
(look-alikes, width variants), ignorables on either side and ligatures against their letters cost nothing, any
other edit costs 1. Within the budget (0 by default: only what looks the same) it yields the vocabulary
spellings of the token. The canonical spelling is the drawn form itself where that is of one script, else the
spelling of one script that most texts use (ties: the smallest), else the form given by the table.

A token of one script whose drawn form mixes scripts (most Cyrillic and Greek words) stays as it is unless the
tries say otherwise, any other suspect falls back to its drawn form; only spellings that differ from this rule
are shipped to the workers, that is of disguised words, in blocks of bounded size. Texts never leave their
partition. Pure ASCII texts are canonical already. Defined results: null gives null, blank text gives "".
"""
from __future__ import annotations

import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestia.functions.fold import make_fold
from attestia.session import written

from .shared import pairs_within, stripped

TOKENS = r"[\p{L}\p{M}\p{N}\p{Cf}]+|[^\p{L}\p{M}\p{N}\p{Cf}]+"
#: Replacements shipped to the workers at once.
BLOCK = 500_000
#: Suspect tokens that a trie aims at.
TRIE_TOKENS = 50_000


def scripts(token: str) -> set[str]:
    """Scripts of the letters of a token, by the first word of their names."""
    return {unicodedata.name(ch, "?").split(" ")[0] for ch in token if ch.isalpha()}


def make_suspect(fold):
    """suspect(token): the table changes it, or its letters are of several scripts."""
    known: dict[str, bool] = {}

    def suspect(token: str) -> bool:
        out = known.get(token)
        if out is None:
            if len(known) > 300_000:
                known.clear()
            out = known[token] = fold(token) != token or bool({"CYRILLIC", "GREEK", "ARMENIAN"} & (s := scripts(token))) and len(s) > 1
        return out

    return suspect


def pure(token: str) -> bool:
    """Letters of one script only, in their plain form."""
    return token.isalpha() and len(scripts(token)) == 1 and unicodedata.normalize("NFKC", token) == token


def by_table(token: str, fold) -> str:
    """The spelling of a suspect that the tries don't decide."""
    drawn = fold(token)
    return token if len(scripts(drawn)) > 1 and pure(token) else drawn


class Trie:
    """Vocabulary trie over decomposed spellings, one edge a character, traversed by a weighted edit automaton."""

    def __init__(self, fold, budget: int = 0):
        self.fold, self.budget, self.root, self.drawn = fold, budget, ({}, []), {}

    def piece(self, ch: str) -> str:
        """What an edge is drawn as; nothing for an ignorable."""
        out = self.drawn.get(ch)
        if out is None:
            out = self.drawn[ch] = unicodedata.normalize("NFD", self.fold(ch))
        return out

    def add(self, token: str, n: int) -> None:
        node = self.root
        for ch in unicodedata.normalize("NFD", token):
            node = node[0].setdefault(ch, ({}, []))
        node[1].append((not pure(token), -n, token))

    def spellings(self, token: str) -> list[tuple[int, bool, int, str]]:
        """(cost, not of one script, -count, spelling) of the vocabulary spellings within the budget of *token*."""
        target = unicodedata.normalize("NFD", self.fold(token))
        out, states, seen = [], [(self.root, 0, 0)], {}
        while states:
            node, at, cost = states.pop()
            if seen.get((id(node), at), self.budget + 1) <= cost:
                continue
            seen[id(node), at] = cost
            if at == len(target):
                out += [(cost, *entry) for entry in node[1]]
            for ch, child in node[0].items():
                drawn = self.piece(ch)
                if target.startswith(drawn, at):
                    states.append((child, at + len(drawn), cost))
                if drawn and cost < self.budget:
                    states.append((child, at, cost + 1))
                    if at < len(target):
                        states.append((child, at + 1, cost + 1))
            if at < len(target) and cost < self.budget:
                states.append((node, at + 1, cost + 1))
        return sorted(out)

    def canonical(self, token: str) -> str:
        drawn = self.fold(token)
        if len(scripts(drawn)) < 2:
            return drawn
        found = self.spellings(token)
        return found[0][3] if found and not found[0][1] else drawn


def _suspects(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import regex

    fold, cut = make_fold(), regex.compile(TOKENS)
    suspect = make_suspect(fold)
    for part in parts:
        seen = Counter(t for text in part.column(0).to_pylist() for t in cut.findall(text) if not t.isascii() and suspect(t))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64()), pa.array([zlib.crc32(fold(t).encode("utf-8", "surrogatepass")) for t in seen], pa.int64())], names=["token", "n", "form"])


def _spell(part: pa.Table) -> pa.Table:
    fold = make_fold()
    trie, tokens = Trie(fold), part.column("token").to_pylist()
    for token, n in zip(tokens, part.column("n").to_pylist()):
        trie.add(token, n)
    found = [(t, s) for t in tokens if (s := trie.canonical(t)) != by_table(t, fold)]
    return pa.table({"token": pa.array([t for t, _ in found], pa.string()), "spelling": pa.array([s for _, s in found], pa.string())})


def spellings(texts: DataFrame, text: str) -> DataFrame:
    """(token, spelling) of the suspect tokens whose canonical spelling is not that of the table.

    A class of equal drawn forms is never divided; the number of tries follows the number of suspects.
    """
    found = written(texts.select(text).mapInArrow(_suspects, "token string, n bigint, form bigint").groupBy("form", "token").agg(F.sum("n").alias("n")), "suspects")
    tries = max(1, -(-found.count() // TRIE_TOKENS))
    return found.groupBy(F.pmod("form", F.lit(tries)).alias("bucket")).applyInArrow(_spell, "token string, spelling string")


def canonical_texts(df: DataFrame, text: str, out: str = "canonical") -> DataFrame:
    """*df* with the column *out*: the canonical form of *text* without outer white space."""
    src = df.withColumn(out, stripped(F.col(text)))
    plain = F.col(out).isNull() | ~F.col(out).rlike(r"[^\x00-\x7F]")
    odd = src.filter(~plain)
    changed = written(spellings(odd, out), "spellings")
    blocks = max(1, -(-changed.count() // BLOCK))
    place = odd.columns.index(out)
    schema = odd.schema
    for n in range(blocks):
        block = changed if blocks == 1 else changed.filter(F.pmod(F.xxhash64("token"), F.lit(blocks)) == n)
        shipped = df.sparkSession.sparkContext.broadcast({r["token"]: r["spelling"] for r in block.toLocalIterator()})

        def replace(parts: Iterator[pa.RecordBatch], shipped=shipped, last=n == blocks - 1) -> Iterator[pa.RecordBatch]:
            import regex

            cut, known, fold = regex.compile(TOKENS), shipped.value, make_fold()
            suspect, spelled = make_suspect(fold), {}

            def spell(token: str) -> str:
                new = spelled.get(token)
                if new is None:
                    if len(spelled) > 300_000:
                        spelled.clear()
                    new = spelled[token] = known.get(token) or (by_table(token, fold) if last and suspect(token) else token)
                return new

            for part in parts:
                texts = [t if t.isascii() else "".join(map(spell, cut.findall(t))) for t in part.column(place).to_pylist()]
                yield part.set_column(place, part.schema.field(place), pa.array(texts, part.schema.field(place).type))

        odd = odd.mapInArrow(replace, schema)
    return src.filter(plain).unionByName(odd)


def _forms(records: DataFrame) -> DataFrame:
    """(record_kind, record_key, raw, form): hashes of the stored and of the canonical text; null and blank texts are left out."""
    forms = canonical_texts(records.select("record_kind", "record_key", "text"), "text").filter("canonical <> ''")
    return written(forms.select("record_kind", "record_key", F.xxhash64(stripped(F.col("text"))).alias("raw"), F.xxhash64("canonical").alias("form")), "forms")


def lookalike_classes(records: DataFrame) -> DataFrame:
    """(record_kind, record_key, form, spellings): one row a record and text, its class and the number of different spellings in it."""
    keyed = _forms(records).distinct()
    ways = keyed.select("record_kind", "form", "raw").distinct().groupBy("record_kind", "form").agg(F.count("*").alias("spellings"))
    return keyed.join(ways, ["record_kind", "form"]).select("record_kind", "record_key", "form", "spellings")


def lookalike_pairs(records: DataFrame) -> DataFrame:
    """(record_kind, key_a, key_b) of records (record_kind, record_key, text) that look the same and differ in characters.

    Repeated rows count once; a key with several different texts counts each of them. Null and
    blank texts have no partner. Only hashes are shuffled.
    """
    return pairs_within(_forms(records), ["record_kind", "form"], "record_key", "raw").select("record_kind", F.col("record_key_a").alias("key_a"), F.col("record_key_b").alias("key_b")).distinct()
