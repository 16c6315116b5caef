"""Scores of abusive, hateful or sexual content by nearest labelled examples.

Texts are cut into passages. A passage and every labelled example are TF-IDF vectors over words, word
pairs and, in scripts without spaces, character pairs, after spellings meant to evade filters are undone
(look-alikes, digits for letters, letters set apart, stretched letters). Document frequencies are counted
over the whole corpus; numbers count as one word, every other word as itself. The k most similar examples
are found exactly through an inverted index with block maxima; blocks that cannot reach the k-th best are
not read. The similarity-weighted vote of these examples becomes a probability by a logistic curve fitted
on the examples, each scored without itself. A text's score is that of its worst passage, with the example
as evidence.

Bounds: at most MOST_EXAMPLES examples (a parameter) are indexed and shipped; more raise an error.
Defined results: null and empty texts score 0 without evidence; a repeated row gets the same score;
texts of any length are read whole.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestia.functions.fold import make_fold

MOST_EXAMPLES = 20_000
NEIGHBOURS, BLOCK, DOUBT = 7, 16, 0.4
#: Slope and offset of the curve from votes to probabilities before any example is seen: even odds at half the votes.
PRIOR_CURVE = (12.0, -6.0)
#: Probability from which a text counts as abusive.
THRESHOLD = 0.9
#: Passages scored at once.
STEP = 512
# Signs that stand for letters inside a word.
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})


def make_passages():
    """passages(text) -> lists of features, one list a passage."""
    fold = make_fold()
    cut = re.compile(r"[.!?…。！？\n]+(?=\s|$|[^\x00-\x7f])|[。！？\n]+")
    apart = re.compile(r"(?<![^\W_])(?:[^\W\d_][\s.*_-]){2,}[^\W\d_](?![^\W_])")
    inner = re.compile(r"(?<=[^\W\d_])[-*._](?=[^\W\d_]([-*._]|(?![^\W_])))")
    mixed = re.compile(r"(?<![^\W_])(?=[\w@$!]*[A-Za-z])(?=[\w@$!]*[0-9@$])[\w@$!]*[\w@$]")
    stretched = re.compile(r"([^\W\d_])\1{2,}")
    runs = re.compile(r"[぀-ヿ㐀-鿿]+|[^\W_぀-ヿ㐀-鿿]+")

    own = re.compile(r"(?<![^\W_])[Ͱ-ӿ]{2,}(?![^\W_])")

    def lowered(m: re.Match) -> str:
        # Capitals of a Greek or Cyrillic word aren't drawn like its small letters; one drawn wholly Latin is in disguise.
        return m.group() if fold(m.group()).isascii() else m.group().lower()

    def words(text: str) -> list[str]:
        text = fold(text if text.isascii() else own.sub(lowered, text))
        text = apart.sub(lambda m: re.sub(r"[\s.*_-]", "", m.group()), text)
        text = mixed.sub(lambda m: m.group().translate(SIGNS), text).lower()
        return runs.findall(stretched.sub(r"\1", text))

    def passages(text: str) -> Iterator[list[str]]:
        for part in cut.split(text):
            if not part or not part.strip():
                continue
            out: list[str] = []
            last = "^"
            for w in words(part):
                if w[0] >= "぀" and not "가" <= w[0] <= "힣":
                    out += [w[i : i + 2] for i in range(len(w) - 1)] or [w]
                    last = "^"
                    continue
                if w.isdigit():
                    w = "#"
                else:
                    out.append(w)
                    if len(w) > 3:
                        out.append(w[:4] + "_")
                out.append(last + " " + w)
                last = w
            if out:
                yield out

    return passages


class Index:
    """Exact cosine search over labelled examples by an inverted index cut into blocks of examples.

    The postings of a feature lie block by block, each with its greatest weight. Of a batch of passages the sums
    of these maxima bound every block; a passage's best blocks are read first, and of the others only those
    whose bound reaches the k-th best similarity found so far.
    """

    def __init__(self, examples: list[tuple[int, list[str], int]], df: dict[str, int], total: int):
        # Examples that begin alike lie in one block, which tightens its bounds.
        examples = sorted(examples, key=lambda e: (e[1], e[0]))
        own = Counter(f for _, features, _ in examples for f in set(features))
        self.features = {f: n for n, f in enumerate(own)}
        # A feature is as rare as the corpus and the examples together make it.
        self.idf = np.array([math.log((total + len(examples) + 1) / (df.get(f, 0) + n + 0.5)) for f, n in own.items()])
        self.labels = np.array([y for _, _, y in examples], dtype=bool)
        self.keys, self.texts = [k for k, _, _ in examples], [f for _, f, _ in examples]
        self.blocks = max(1, -(-len(examples) // BLOCK))
        rows, features, weights = self.vectors([f for _, f, _ in examples])
        order = np.lexsort((rows, features))
        self.post_row, self.post_weight = rows[order].astype(np.int64), weights[order]
        # One entry for each (feature, block) with postings.
        cell = features[order].astype(np.int64) * self.blocks + self.post_row // BLOCK
        self.cells, first = np.unique(cell, return_index=True)
        self.cell_first = np.r_[first, len(cell)]
        self.cell_most = np.maximum.reduceat(self.post_weight, first) if len(cell) else np.zeros(0)
        self.feature_cells = np.searchsorted(self.cells, np.arange(len(own) + 1) * self.blocks)
        self.calibration = PRIOR_CURVE
        #: Blocks that could hold a neighbour, and blocks read, since the index was made.
        self.met = self.read = 0

    def vectors(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, feature, weight) of unit TF-IDF vectors."""
        known, sizes = self.features, [len(t) for t in texts]
        found = np.array([known.get(f, -1) for t in texts for f in t], dtype=np.int64)
        whose = np.repeat(np.arange(len(texts)), sizes)
        # Distinct unknown words; pairs and beginnings of words don't count.
        strange = np.array([len({f for f in t if f not in known and f[-1] != "_" and " " not in f}) for t in texts], dtype=np.float64)
        cell, counts = np.unique(whose[found >= 0] * (len(known) + 1) + found[found >= 0], return_counts=True)
        rows, features = cell // (len(known) + 1), cell % (len(known) + 1)
        weights = (1 + np.log(counts)) * self.idf[features]
        # Unknown words count in the length, as rare as words of one example.
        norm = np.sqrt(np.bincount(rows, weights * weights, len(texts)) + 9.0 * strange)
        return rows, features, weights / np.maximum(norm[rows], 1e-12)

    def nearest(self, texts: list[list[str]], k: int = NEIGHBOURS, skip: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(similarities, examples) of the *k* nearest of each text, best first, ties to the earlier example; 0 and -1 where there are fewer."""
        rows, features, q = self.vectors(texts)
        # Every (text, feature, block) with postings.
        lo, many = self.feature_cells[features], self.feature_cells[features + 1] - self.feature_cells[features]
        cell = np.repeat(lo - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum()) if len(many) else np.zeros(0, dtype=np.int64)
        row, weight = np.repeat(rows, many), np.repeat(q, many)
        block = self.cells[cell] % self.blocks
        slot = row * self.blocks + block
        bound = np.bincount(slot, weight * self.cell_most[cell], len(texts) * self.blocks).reshape(len(texts), self.blocks)
        sims = np.zeros((len(texts), self.blocks * BLOCK))
        todo = np.zeros(bound.shape, dtype=bool)
        best = bound.argmax(1) if len(texts) else np.zeros(0, dtype=np.int64)
        todo[np.arange(len(texts)), best] = bound[np.arange(len(texts)), best] > 0
        self.met += int((bound > 0).sum())
        done, least, at_once = np.zeros_like(todo), np.zeros(len(texts)), 1
        while todo.any():
            self.read += int(todo.sum())
            some = np.flatnonzero(todo.ravel()[slot])
            first, size = self.cell_first[cell[some]], self.cell_first[cell[some] + 1] - self.cell_first[cell[some]]
            at = np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if len(size) else np.zeros(0, dtype=np.int64)
            place = np.repeat(row[some] * sims.shape[1], size) + self.post_row[at]
            sims += np.bincount(place, np.repeat(weight[some], size) * self.post_weight[at], sims.size).reshape(sims.shape)
            done |= todo
            if skip is not None:
                sims[np.arange(len(texts)), skip] = 0
            # The blocks that may still hold one of the k, the most promising of each text next.
            live = np.flatnonzero(todo.any(1))
            least[live] = np.partition(sims[live], -k, axis=1)[:, -k] if sims.shape[1] > k else 0
            rest = np.where((bound[live] >= least[live, None] - 1e-12) & ~done[live], bound[live], 0)
            at_once *= 4
            if at_once < self.blocks:
                rest[rest < np.partition(rest, -at_once, axis=1)[:, -at_once][:, None]] = 0
            todo = np.zeros_like(done)
            todo[live] = rest > 0
        width = min(k, sims.shape[1])
        # The k greatest, then ties by number.
        near = np.argpartition(-sims - 1e-13 * np.arange(sims.shape[1], 0, -1), width - 1, axis=1)[:, :width]
        near.sort(axis=1)
        value = np.take_along_axis(sims, near, 1)
        order = np.argsort(-value, axis=1, kind="stable")
        value, near = np.take_along_axis(value, order, 1), np.take_along_axis(near, order, 1)
        return value, np.where(value > 0, near, -1)

    def votes(self, texts: list[list[str]], skip: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(share of abusive votes, best abusive example or -1): the nearer a neighbour, the more its vote counts."""
        value, near = self.nearest(texts, skip=skip)
        yes = (near >= 0) & self.labels[near]
        share = np.where(yes, value**3, 0).sum(1) / ((value**3).sum(1) + DOUBT**3)
        first = yes.argmax(1)
        return share, np.where(yes.any(1), near[np.arange(len(near)), first], -1)

    def scores(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(probability, best abusive example or -1); no probability where no neighbour is abusive."""
        share, best = self.votes(texts)
        slope, offset = self.calibration
        return np.where(best >= 0, 1 / (1 + np.exp(-(slope * share + offset))), 0.0), best

    def calibrate(self) -> None:
        """A logistic curve from votes to probabilities, fitted on the examples, each scored without itself.

        The prior curve weighs as much as a few examples, so that it stands where there are hardly any.
        """
        texts = self.texts
        x = np.concatenate([self.votes(texts[a : a + 200], list(range(a, min(a + 200, len(texts)))))[0] for a in range(0, len(texts), 200)])
        yes, no = self.labels.sum(), (~self.labels).sum()
        if not yes or not no:
            return
        # Targets short of 0 and 1 keep the curve finite where the votes part the labels.
        t = np.where(self.labels, (yes + 1) / (yes + 2), 1 / (no + 2))
        prior = w = np.array(PRIOR_CURVE)
        X = np.c_[x, np.ones(len(x))]
        for _ in range(100):
            p = 1 / (1 + np.exp(-X @ w))
            step = np.linalg.solve((X * (p * (1 - p))[:, None]).T @ X + np.eye(2), X.T @ (t - p) - (w - prior))
            w = w + step
            if np.abs(step).max() < 1e-9:
                break
        self.calibration = (float(w[0]), float(w[1]))


def _frequencies(wanted):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages, known = make_passages(), wanted.value
        for part in parts:
            count, n = Counter(), 0
            for text in part.column(0).to_pylist():
                for p in passages(text):
                    n += 1
                    count.update(known.intersection(p))
            count[""] = n
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["feature", "n"])

    return run


def build(examples: DataFrame, corpus: DataFrame, text: str) -> Index:
    """The index of *examples* (sample_id, text, is_abusive), weighted by frequencies of the whole corpus."""
    rows = examples.filter(F.col("text").isNotNull() & F.col("is_abusive").isNotNull()).select("sample_id", "text", "is_abusive").distinct().orderBy("sample_id").limit(MOST_EXAMPLES + 1).collect()
    if len(rows) > MOST_EXAMPLES:
        raise ValueError(f"more than {MOST_EXAMPLES} labelled examples: sample them first")
    passages = make_passages()
    own = [(r["sample_id"], [f for p in passages(r["text"]) for f in p], int(r["is_abusive"])) for r in rows]
    spark = corpus.sparkSession
    wanted = spark.sparkContext.broadcast({f for _, features, _ in own for f in features})
    counts = corpus.select(text).filter(F.col(text).isNotNull()).mapInArrow(_frequencies(wanted), "feature string, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    df = {r["feature"]: r["n"] for r in counts}
    total = df.pop("", 0)
    index = Index(own, df, total)
    index.calibrate()
    return index


def scores(corpus: DataFrame, key: str, text: str, examples: DataFrame) -> DataFrame:
    """(key, score, evidence): every row of *corpus* with the score of its worst passage and the nearest abusive example."""
    index = build(examples, corpus, text)
    shipped = corpus.sparkSession.sparkContext.broadcast(index)
    kind = dict(corpus.dtypes)[key]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages, ix = make_passages(), shipped.value
        for part in parts:
            # Every distinct passage of the batch is scored once.
            number: dict[tuple[str, ...], int] = {}
            rows, which = [], []
            for n, t in enumerate(part.column(1).to_pylist()):
                for p in passages(t or ""):
                    rows.append(n)
                    which.append(number.setdefault(tuple(p), len(number)))
            texts = list(number)
            got = [ix.scores(texts[a : a + STEP]) for a in range(0, len(texts), STEP)]
            score, best = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0), np.zeros(0, dtype=np.int64))
            rows, which = np.array(rows, dtype=np.int64), np.array(which, dtype=np.int64)
            out, evidence = np.zeros(part.num_rows), np.full(part.num_rows, -1)
            # The worst passage of a text, the first of equals.
            order = np.lexsort((-np.arange(len(rows)), score[which]))
            out[rows[order]], evidence[rows[order]] = np.round(score[which][order], 6), best[which][order]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.float64()), pa.array([None if e < 0 or not o else ix.keys[e] for e, o in zip(evidence, out)], pa.int64())], names=[key, "score", "evidence"])

    return corpus.select(key, text).mapInArrow(run, f"{key} {kind}, score double, evidence bigint")
