"""Byte-level BPE encoding and decoding with built-in expressions only.

A text is cut into words by the tokenizer's public pattern. Each distinct word becomes an
array of byte ids; a fold merges, round by round, every occurrence of the adjacent pair with
the lowest rank, looked up in a literal rank map held in the plan. The ids of the most frequent
words (FREQUENT of them, by counts over all texts) are folded once and held in the plan as well; any
other word is folded where it stands, so no text and no word is shuffled. Both ways give the same ids.

Defined results: an empty and a null text give an empty list; repeated texts give equal lists;
special-token strings inside a text are ordinary text; no length limit.
"""
from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let

TOKENIZERS = os.environ.get("ATTESTIA_TOKENIZERS", "/opt/tokenizers")
#: White space as the tokenizer's regular expressions define it; Java's own \s is ASCII.
_SPACE = r"\t-\r\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The public pre-tokenizer pattern of the vocabulary (fixed value).
WORDS = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
_BUCKETS = 16384
#: Words whose ids are held in the plan: the bound of what reaches the driver (a few MB).
FREQUENT = 65_536


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ranks and pieces of a byte-level BPE file (path is a parameter; nothing is copied)."""

    def __init__(self, folder: str = TOKENIZERS, name: str = "byte_bpe_50k"):
        with open(f"{folder}/{name}.json", encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, vocab = _byte_letters(), model["vocab"]
        self.byte_ids = [0] * 256
        for ch, b in letters.items():
            self.byte_ids[b] = vocab[ch]
        self.pieces = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            self.pieces[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        buckets: list[dict[int, int]] = [{} for _ in range(_BUCKETS)]
        self.joints = set()
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = vocab[left], vocab[right]
            # A pair's value holds its rank above the id of the merged piece: the least value is the next merge.
            buckets[(a * 7919 + b) % _BUCKETS][a * 65536 + b] = rank * 65536 + vocab[left + right]
            self.joints.add((letters[left[-1]], letters[right[0]]))
        self.rank_json = json.dumps(buckets, separators=(",", ":"))

    def rank_map(self) -> Column:
        return F.from_json(F.lit(self.rank_json), "array<map<string,bigint>>").cast("array<map<bigint,bigint>>")

    def joint_map(self) -> Column:
        """True at 256*x+y where some merge joins a piece ending in byte x to one starting with y."""
        return F.from_json(F.lit(json.dumps([(i >> 8, i & 255) in self.joints for i in range(65536)])), "array<boolean>")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORDS), F.lit(0))


def _bytes(word: Column) -> Column:
    """array<int> of the UTF-8 bytes."""
    coded = F.hex(F.encode(word, "UTF-8"))
    return F.transform(F.sequence(F.lit(1), F.octet_length(word)), lambda i: F.conv(F.substr(coded, i * 2 - 1, F.lit(2)), 16, 10).cast("int"))


def _segments(codes: Column, joints: Column) -> Column:
    """Cut where no merge of the vocabulary can join the two bytes: folds over the parts give the same ids."""
    ends = F.filter(F.sequence(F.lit(1), F.size(codes)), lambda i: (i == F.size(codes)) | ~F.get(joints, F.get(codes, i - 1) * 256 + F.get(codes, i)))

    def cut(at: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.slice(at, F.lit(1), F.size(at) - 1))
        return F.transform(F.arrays_zip(starts.alias("a"), at.alias("b")), lambda s: F.slice(codes, s["a"] + 1, s["b"] - s["a"]))

    return let(ends, cut)


def _merge(ids: Column, ranks: Column) -> Column:
    """Fold of merge rounds over one part; a round without a ranked pair leaves it unchanged."""

    def value(left: Column, right: Column) -> Column:
        return F.try_element_at(F.get(ranks, (left * 7919 + right) % _BUCKETS), left.cast("bigint") * 65536 + right)

    def join_all(now: Column, best: Column) -> Column:
        merged = best.bitwiseAND(F.lit(65535)).cast("int")
        empty = F.array().cast("array<int>")
        state = F.struct(empty.alias("done"), F.lit(None).cast("int").alias("held"))
        # The last id is held back until the next shows whether the two join.
        return F.aggregate(
            now, state,
            lambda s, x: F.when(s["held"].isNull(), F.struct(s["done"].alias("done"), x.alias("held")))
            .when(value(s["held"], x) == best, F.struct(F.concat(s["done"], F.array(merged)).alias("done"), F.lit(None).cast("int").alias("held")))
            .otherwise(F.struct(F.concat(s["done"], F.array(s["held"])).alias("done"), x.alias("held"))),
            lambda s: F.when(s["held"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["held"]))),
        )

    def round_(s: Column, _: Column) -> Column:
        best = F.array_min(F.transform(F.sequence(F.lit(1), F.size(s["ids"]) - 1), lambda i: value(F.get(s["ids"], i - 1), F.get(s["ids"], i))))
        return F.when(s["over"] | (F.size(s["ids"]) < 2), s).otherwise(
            let(best, lambda b: F.when(b.isNull(), F.struct(s["ids"].alias("ids"), F.lit(True).alias("over"))).otherwise(F.struct(join_all(s["ids"], b).alias("ids"), F.lit(False).alias("over"))))
        )

    start = F.struct(ids.alias("ids"), F.lit(False).alias("over"))
    return F.aggregate(F.sequence(F.lit(1), F.size(ids)), start, round_, lambda s: s["ids"])


def fold_word(word: Column, vocabulary: Vocabulary) -> Column:
    """array<int>: the ids of one word."""
    base, ranks, joints = F.array(*[F.lit(i) for i in vocabulary.byte_ids]), vocabulary.rank_map(), vocabulary.joint_map()
    return let(_bytes(word), lambda codes: F.flatten(F.transform(_segments(codes, joints), lambda p: _merge(F.transform(p, lambda b: F.get(base, b)), ranks))))


def _slot(word: Column) -> Column:
    return F.pmod(F.hash(word), F.lit(_BUCKETS))


def frequent_ids(lists: DataFrame, column: str, vocabulary: Vocabulary, most: int) -> Column:
    """A literal array of _BUCKETS maps word -> ids of the *most* frequent words of the array column."""
    counts = lists.select(F.explode(column).alias("word")).groupBy("word").count().orderBy(F.desc("count"), "word").limit(most)
    known = counts.select("word", _slot(F.col("word")).alias("slot"), fold_word(F.col("word"), vocabulary).alias("ids")).collect()
    buckets: list[dict[str, list[int]]] = [{} for _ in range(_BUCKETS)]
    for r in known:
        buckets[r["slot"]][r["word"]] = r["ids"]
    return F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<map<string,array<int>>>")


def encode_corpus(df: DataFrame, key: str, text: str, vocabulary: Vocabulary, frequent: int = FREQUENT) -> DataFrame:
    """(key, ids array<int>) for every row. Extra columns are ignored; *frequent* changes the speed only."""
    src = df.select(F.col(key), words(F.col(text)).alias("_words"))
    known = frequent_ids(src, "_words", vocabulary, frequent)
    ids = F.transform("_words", lambda w: F.coalesce(F.try_element_at(F.get(known, _slot(w)), w), fold_word(w, vocabulary)))
    return src.select(key, F.flatten(ids).alias("ids"))


def decode(ids: Column, vocabulary: Vocabulary) -> Column:
    """The text of an id list: binary pieces side by side, read as UTF-8."""
    pieces = F.split(F.lit(",".join(p.hex() for p in vocabulary.pieces)), ",")
    return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "")), "UTF-8")
