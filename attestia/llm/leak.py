"""Passages of held-out items inside a corpus: q-gram lemma filter and banded alignment.

Texts are compared as streams of case-folded letters and digits. A window of an item of length L
that occurs in a text with at most e edits shares at least L + 1 - q(e + 1) q-grams with it, all on
diagonals at most e apart. Of each window only the q e + SPARE q-grams that are rarest among the items
are indexed (an edit spoils at most q of them, so at least SPARE must be met). Shared q-grams are counted
in overlapping bands of diagonals, as array arithmetic over a whole batch of texts; bands that meet the
bound are kept and verified by alignment within the band, which gives the regions.

The items are a stated query set, indexed in blocks of bounded size; every text is scanned whole. q is 5,
less for items whose shortest window is too short for it, so the bound is never below one q-gram.
Defined results: null, empty and letterless texts and items match nothing; an item shorter than the
window cannot leak; repeated rows give a pair once.
"""
from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items indexed and shipped to the workers at once (about 10 kB each).
BLOCK_ITEMS = 10_000
WINDOW_WORDS, WINDOW_LETTERS = 12, 20
Q, SPARE = 5, 8
#: Letters whose q-grams are looked up at once; a longer text is one batch of its own.
BATCH_LETTERS = 2_000_000
_RUNS = re.compile(r"[^\W_]+")


def stream(text: str) -> tuple[str, list[int], list[int]]:
    """Letters and digits of *text*, with starts and ends of its words in that stream."""
    out, starts, ends, inside = [], [], [], False
    n = 0
    for ch in text if text.isascii() else unicodedata.normalize("NFKC", text):
        if ch.isalnum():
            if not inside:
                starts.append(n)
                inside = True
            ch = ch.casefold()
            out.append(ch)
            n += len(ch)
        elif inside and not unicodedata.category(ch) in ("Mn", "Cf"):
            ends.append(n)
            inside = False
    if inside:
        ends.append(n)
    return "".join(out), starts, ends


def letters_of(text: str) -> str:
    """The stream alone."""
    return "".join(_RUNS.findall(text if text.isascii() else unicodedata.normalize("NFKC", text))).casefold()


def gram_codes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each run of *q* code points."""
    out = np.zeros(max(0, len(codes) - q + 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for n in range(q):
            out = (out ^ codes[n : n + len(out)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Items:
    """Windows, q-gram index and bounds of a block of items."""

    BITS = 22

    def __init__(self, rows: list[tuple[int, str | None, str | None]], edits: int):
        self.edits, self.keys, self.items, self.tables = edits, [], [], {}
        by_q: dict[int, list[int]] = defaultdict(list)
        for key, lang, text in rows:
            letters, starts, ends = stream(text or "")
            if lang == "zh":
                windows = [(i, i + WINDOW_LETTERS) for i in range(len(letters) - WINDOW_LETTERS + 1)]
            else:
                windows = [(starts[i], ends[i + WINDOW_WORDS - 1]) for i in range(len(starts) - WINDOW_WORDS + 1)]
            if not windows or key is None:
                continue
            q = min(Q, min(b - a for a, b in windows) // (edits + 1))
            by_q[q].append(len(self.items))
            self.keys.append(key)
            self.items.append([letters, windows, q, None, None])
        for q, some in by_q.items():
            if q < 1:
                raise ValueError("fewer edits than letters of a window, please")
            self.tables[q] = self._table(q, some)

    def _table(self, q: int, some: list[int]):
        codes = {n: gram_codes(code_points(self.items[n][0]), q) for n in some}
        often = Counter(c for x in codes.values() for c in x.tolist())
        hashes, owners, places = [], [], []
        for n in some:
            windows, mine = self.items[n][1], codes[n]
            rarity = np.array([often[c] for c in mine.tolist()]) * (len(mine) + 1) + np.arange(len(mine))
            keep = np.zeros(len(mine), dtype=bool)
            for a, b in windows:
                part = rarity[a : b - q + 1]
                m = min(len(part), q * self.edits + SPARE)
                keep[a + np.argpartition(part, m - 1)[:m]] = True
            upto = np.r_[0, np.cumsum(keep)]
            # Indexed q-grams that a window must share, whatever its edits spoil.
            need = [max(1, int(upto[b - q + 1] - upto[a]) - q * self.edits) for a, b in windows]
            self.items[n][3:] = need, min(need)
            at = np.flatnonzero(keep)
            hashes.append(mine[at])
            owners.append(np.full(len(at), n, dtype=np.int32))
            places.append(at.astype(np.int32))
        hashes, owners, places = map(np.concatenate, (hashes, owners, places))
        order = np.argsort(hashes, kind="stable")
        known, first = np.unique(hashes[order], return_index=True)
        filter_ = np.zeros(1 << self.BITS, dtype=bool)
        filter_[(known >> np.uint64(64 - self.BITS)).astype(np.int64)] = True
        return known, np.r_[first, len(order)], owners[order], places[order], filter_

    def hits(self, codes: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the batch, item, place in the item) of every indexed q-gram of a batch."""
        known, first, owners, places, filter_ = self.tables[q]
        grams = gram_codes(codes, q)
        at = np.flatnonzero(filter_[(grams >> np.uint64(64 - self.BITS)).astype(np.int64)])
        slot = np.searchsorted(known, grams[at])
        slot[slot == len(known)] = 0
        good = known[slot] == grams[at]
        at, slot = at[good], slot[good]
        many = first[slot + 1] - first[slot]
        which = np.repeat(first[slot] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum()) if len(many) else np.zeros(0, dtype=np.int64)
        return np.repeat(at, many), owners[which], places[which]

    def regions(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
        """(number of the text, item, start, end, edits) of the item windows found, each once with the least edits of all its places."""
        streams = [letters_of(t) if t else "" for t in texts]
        begin = 0
        while begin < len(streams):
            end, size = begin + 1, len(streams[begin])
            while end < len(streams) and size + len(streams[end]) < BATCH_LETTERS:
                size += len(streams[end]) + 1
                end += 1
            # A zero between two texts: no q-gram spans it.
            codes = code_points("\0".join(streams[begin:end]))
            starts = np.r_[0, np.cumsum([len(s) + 1 for s in streams[begin:end]])]
            for q in self.tables:
                yield from ((begin + n, *found) for n, *found in self._batch(streams[begin:end], codes, starts, q))
            begin = end

    def _batch(self, streams: list[str], codes: np.ndarray, starts: np.ndarray, q: int) -> Iterator[tuple[int, int, int, int, int]]:
        at, owner, place = self.hits(codes, q)
        if not len(at):
            return
        text = np.searchsorted(starts, at, side="right") - 1
        width, start = self.edits + 1, at - starts[text]
        # Bands overlap by half: a band spans two widths.
        band = (start - place) // width
        low = int(band.min()) - 1
        spread = int(band.max()) - low + 1
        key = (text * len(self.items) + owner) * spread + (band - low)
        key, who = np.r_[key, key - 1], np.r_[np.arange(len(at)), np.arange(len(at))]
        order = np.argsort(key, kind="stable")
        key, who = key[order], who[order]
        heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        many = np.diff(np.r_[heads, len(key)])
        least = np.array([x[4] or 0 for x in self.items])
        found: dict[tuple[int, int, int, int], int] = {}
        enough = many >= least[owner[who[heads]]]
        for h, n in zip(heads[enough], many[enough]):
            some = who[h : h + n]
            places = np.unique(place[some])
            letters, windows, _, need, fewest = self.items[owner[some[0]]]
            if len(places) < fewest:
                continue
            t, item, first = int(text[some[0]]), int(owner[some[0]]), (int(key[h]) % spread + low) * width
            for (a, b), fewest in zip(windows, need):
                known = found.get((t, item, a, b), self.edits + 1)
                if not known or b <= places[0] or a > places[-1]:
                    continue
                if np.searchsorted(places, b - q, side="right") - np.searchsorted(places, a) < fewest:
                    continue
                cost = self.align(streams[t], letters[a:b], first + a, 2 * width, self.edits)
                if cost is not None and cost < known:
                    found[t, item, a, b] = cost
        for (t, item, a, b), cost in found.items():
            yield t, self.keys[item], a, b, cost

    @staticmethod
    def align(text: str, window: str, first: int, width: int, budget: int) -> int | None:
        """Least edits of *window* against a part of *text* on diagonals first .. first + width, or None beyond the budget."""
        span = range(first, first + width)
        for at in span:
            if at >= 0 and text.startswith(window, at):
                return 0
        if not budget:
            return None
        big, n = budget + 1, len(text)
        row = [0 if 0 <= d <= n else big for d in span]
        for i, ch in enumerate(window):
            new = []
            for k, d in enumerate(span):
                at = i + d  # place in the text of this diagonal's character
                best = row[k] + (not (0 <= at < n and text[at] == ch)) if 0 <= at < n else big
                if k + 1 < width:
                    best = min(best, row[k + 1] + 1)  # window letter left out
                if k and 0 <= at < n:
                    best = min(best, new[k - 1] + 1)  # text letter left out
                new.append(min(best, big))
            row = new
            if min(row) > budget:
                return None
        return min(row) if min(row) <= budget else None


def leaked(corpus: DataFrame, key: str, text: str, items: DataFrame, edits: int = 2) -> DataFrame:
    """(key, item_id, item_start, item_end, edits) of item windows found in the corpus, at most *edits* apart.

    *items*: item_id, lang, text. Offsets are in the item's stream of letters and digits.
    """
    kind = dict(corpus.dtypes)[key]
    schema, src = f"{key} {kind}, item_id bigint, item_start int, item_end int, edits int", corpus.select(key, text).filter(F.col(text).isNotNull())

    def blocks() -> Iterator[list[tuple]]:
        rows: list[tuple] = []
        for r in items.select("item_id", "lang", "text").distinct().toLocalIterator():
            rows.append((r["item_id"], r["lang"], r["text"]))
            if len(rows) == BLOCK_ITEMS:
                yield rows
                rows = []
        yield rows

    out = None
    for rows in blocks():
        if not rows and out is not None:
            continue
        shipped = corpus.sparkSession.sparkContext.broadcast(Items(rows, edits))

        def run(parts: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            index = shipped.value
            for part in parts:
                columns = list(zip(*index.regions(part.column(1).to_pylist()))) or [()] * 5
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.int32()) for c in columns[2:])], names=[key, "item_id", "item_start", "item_end", "edits"])

        some = src.mapInArrow(run, schema)
        out = some if out is None else out.unionByName(some)
    return out.distinct()
