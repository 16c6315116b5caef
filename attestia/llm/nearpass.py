"""Records that share most of their words: exact multiset similarity join without comparing all pairs.

Similarity of two texts: shared words, repeats counted, over the words of the longer text. A word's
n-th occurrence is one element of a set, so a text becomes a set and the bound becomes a bound on the
size of the symmetric difference.

Universe-partition pigeonhole: in each size band the elements are hashed to m segments. Two sets
within k differences agree on some segments: if a probing set gives segment i the threshold e_i in
{-1, 0, 1} and the sum of (e_i + 1) exceeds k, then some segment differs by at most e_i. The index
holds every segment of every set and its one-deletion neighbours; the probing side spends its budget
where the expected posting lists are shortest, estimated from corpus-wide element counts (a table of
fixed size). A set travels once to a bucket, with its sketch and a short signature for each segment and
neighbour; lists are met and sketches compared there. Candidates pass a 256-bit parity sketch, then an
exact check. Nothing is capped.

Texts with the same words form one class before the join; copies are never compared with each other.
Defined results: null, blank and wordless texts belong to no class; repeated rows count once; a text
of any length is processed whole.
"""
from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestia.session import written

from attestia.functions.fold import make_fold
from .shared import HOT_GROUP, SALTS, pairs_within

#: Bins of the element counts.
COUNT_BINS = 1 << 16
#: Signatures that a task of the join aims at.
TASK_SIGNATURES = 3_000_000
#: Rows that may be broadcast (16 bytes each); beyond that the joins shuffle.
BROADCAST_ROWS = 1_000_000
#: Pairs compared at once.
CHUNK = 2_000_000


def make_words():
    """words(text): lower-cased runs of letters and digits; in Chinese text every two neighbouring characters."""
    import re

    fold, runs, parts = make_fold(), re.compile(r"[^\W_]+"), re.compile(r"[㐀-鿿𠀀-𯿿]+|[^㐀-鿿𠀀-𯿿]+")

    def words(text: str | None) -> list[str]:
        if not text:
            return []
        text = fold(text).lower()
        if text.isascii():
            return runs.findall(text)
        out: list[str] = []
        for run in runs.findall(text):
            if run.isascii():
                out.append(run)
                continue
            for part in parts.findall(run):
                if "㐀" <= part[0] <= "鿿" or part[0] >= "𠀀":
                    out += [part[i : i + 2] for i in range(len(part) - 1)] or [part]
                else:
                    out.append(part)
        return out

    return words


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Words of the parity sketch, 64 bits each.
SKETCH = [f"s{n}" for n in range(4)]
_SETS = f"id string, class bigint, size int, {', '.join(f'{s} bigint' for s in SKETCH)}, elements array<bigint>"


def _sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    words, known = make_words(), {}

    def code(word: str) -> int:
        if (h := known.get(word)) is None:
            if len(known) > 500_000:
                known.clear()
            h = known[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h

    for part in parts:
        ids, lengths, flat = [], [], []
        for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            found = words(text)
            if found and i is not None:
                ids.append(i)
                lengths.append(len(found))
                flat += [code(w) for w in found]
        if not ids:
            continue
        codes, size = np.array(flat, dtype=np.uint64), np.array(lengths)
        row = np.repeat(np.arange(len(ids)), size)
        order = np.lexsort((codes, row))
        codes, row = codes[order], row[order]
        fresh = np.r_[True, (codes[1:] != codes[:-1]) | (row[1:] != row[:-1])]
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(codes)), 0))
        nth = np.arange(len(codes)) - start
        codes = np.where(nth > 0, _mix(codes + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), codes)
        at = np.r_[0, np.cumsum(size)]
        with np.errstate(over="ignore"):
            whole = _mix(np.add.reduceat(_mix(codes), at[:-1]) + size.astype(np.uint64))
        # Parity sketch: an element flips one bit.
        bit = _mix(codes ^ np.uint64(0x5851F42D4C957F2D))
        one, word = np.left_shift(np.uint64(1), bit & np.uint64(63)), (bit >> np.uint64(6)) % np.uint64(len(SKETCH))
        sketch = [np.bitwise_xor.reduceat(np.where(word == n, one, np.uint64(0)), at[:-1]) for n in range(len(SKETCH))]
        signed = lambda x: pa.array(x.view(np.int64))
        elements = pa.ListArray.from_arrays(pa.array(at, pa.int32()), signed(codes))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), signed(whole), pa.array(size, pa.int32()), *map(signed, sketch), elements], names=["id", "class", "size", *SKETCH, "elements"])


def word_sets(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, class, size, sketch words, elements): the word set of every text that has words."""
    return df.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text")).mapInArrow(_sets, _SETS)


def _allowed(large: int, small: int, share: Fraction) -> int:
    """Most differences of a set of *large* elements and one of at most *small* that share enough."""
    need = -((-share.numerator * large) // share.denominator)
    return small + large - 2 * need


#: Ratio of neighbouring size bands. At 1 / share a set's partners lie in its own band and the one below.
RATIO = 1.25
#: Kinds of a row's signatures: a segment that is not probed, probed exactly, probed with one difference; a
#: segment less one element that only answers, and one that is probed as well.
KINDS = FULL, FULL_EXACT, FULL_NEAR, LESS, LESS_NEAR = 0, 1, 2, 3, 4
_ROWS = f"bucket bigint, class bigint, size int, {', '.join(f'{s} bigint' for s in SKETCH)}, counts array<int>, signatures binary"
#: Bytes of a signature in a bucket: with TASK_SIGNATURES in it, chance meetings are rare beside real ones.
WIDTH = 3


def _bands(longest: int, ratio: float = RATIO) -> np.ndarray:
    """Lower ends of the size bands; the last lies beyond *longest*."""
    ends, at = [1], 1
    while at <= longest:
        at = max(at + 1, int(np.ceil(at * ratio)))
        ends.append(at)
    return np.array(ends)


def _segments_of(codes, row, size, band, bands, share, log_cost, spare):
    """(signature, set, kind) of every segment and every segment less one element, in the partition of each set's *band*."""
    top = bands[band + 1] - 1
    m = np.array([max(1, int(np.ceil((_allowed(int(t), int(t), share) + 1) / 2 * spare))) for t in top])
    base = np.r_[0, np.cumsum(m)]
    slot = base[row] + (_mix(codes ^ np.uint64(0x2545F4914F6CDD1D)) % m[row].astype(np.uint64)).astype(np.int64)
    owner = np.repeat(np.arange(len(m)), m)
    with np.errstate(over="ignore"):
        total = np.zeros(len(owner), dtype=np.uint64)
        np.add.at(total, slot, _mix(codes))
        place = _mix((band[owner].astype(np.uint64) << np.uint64(40)) + (np.arange(len(owner)) - base[:-1][owner]).astype(np.uint64))
        full, less = _mix(total + place), _mix(total[slot] - _mix(codes) + place[slot])
    # Expected list lengths, from the elements' shares of all texts.
    p = log_cost[(codes & np.uint64(COUNT_BINS - 1)).astype(np.int64)]
    weight = np.zeros(len(owner))
    np.add.at(weight, slot, p)
    cost = np.exp2(weight)
    near = cost * 4
    np.add.at(near, slot, np.exp2(weight[slot] - p))
    # Two units of budget a segment: the exact list, then what one difference adds. Cheapest first.
    k = np.array([_allowed(int(s), int(min(s, t)), share) for s, t in zip(size, top)])
    unit, who = np.r_[cost, np.maximum(near, cost)], np.r_[owner, owner]
    order = np.lexsort((unit, who))
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order)) - 2 * base[:-1][who[order]]
    taken = rank < (k + 1)[who]
    near = taken[len(owner) :]
    exact = taken[: len(owner)] | near
    kinds = np.r_[np.where(near, FULL_NEAR, np.where(exact, FULL_EXACT, FULL)), np.where(near[slot], LESS_NEAR, LESS)]
    return np.r_[full, less], np.r_[owner, row], kinds


def _signatures(share: Fraction, costs: np.ndarray, spare: float, parts_of: dict[int, int]):
    """A function for mapInArrow over classes: one row for each (class, bucket) with the signatures that meet there.

    A bucket is a size band and, where the band has many signatures, a part of its signatures by hash. In its own
    band a set answers and probes with the same signatures; below it only sends those it probes. The counts start
    with 1 where the set answers (else 0), then comes the number of its signatures of each kind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_cost = np.log2(np.maximum(costs, 1) / max(1.0, float(costs.max())))
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            size = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            codes = batch.column(2 + len(SKETCH)).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            row = np.repeat(np.arange(n), size)
            bands = _bands(int(size.max()))
            own = np.searchsorted(bands, size, side="right") - 1
            # Partners below: every band between a set's own and that of its smallest partner.
            low = np.searchsorted(bands, [-((-share.numerator * int(s)) // share.denominator) for s in size], side="right") - 1
            for down in range(int((own - low).max()) + 1):
                some = np.flatnonzero(own - low >= down)
                keep = slice(None) if len(some) == n else np.isin(row, some)
                band = own[some] - down
                sig, who, kind = _segments_of(codes[keep], np.repeat(np.arange(len(some)), size[some]), size[some], band, bands, share, log_cost, spare)
                if down:
                    probed = (kind != FULL) & (kind != LESS)
                    sig, who, kind = sig[probed], who[probed], kind[probed]
                parts = np.array([parts_of.get(b, 1) for b in range(len(bands))])[band]
                part = (sig >> np.uint64(40)).astype(np.int64) % parts[who]
                base = np.r_[0, np.cumsum(parts)]
                at = base[who] + part
                order = np.argsort(at * len(KINDS) + kind, kind="stable")
                counts = np.bincount(at * len(KINDS) + kind, minlength=base[-1] * len(KINDS)).reshape(-1, len(KINDS))
                used = np.flatnonzero(counts.sum(1))
                counts = counts[used]
                ends = np.r_[0, np.cumsum(counts.sum(1))] * WIDTH
                packed = sig[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()
                of = np.repeat(np.arange(len(some)), parts)[used]
                bucket = (band[of] << 24) + used - base[of]
                whose, lead = pa.array(some[of]), np.c_[np.full(len(used), down == 0), counts].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket), *(batch.column(c).take(whose) for c in range(2 + len(SKETCH))),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * lead.shape[1], pa.int32()), pa.array(lead.ravel())),
                        pa.Array.from_buffers(pa.binary(), len(used), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(packed)]),
                    ],
                    names=["bucket", "class", "size", *SKETCH, "counts", "signatures"],
                )

    return run


def _meet(share: Fraction):
    """A function for applyInArrow: pairs of classes of one bucket that meet on a probed signature, fit in size and pass the sketch."""

    def run(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        name, size = part.column("class").to_numpy(), part.column("size").to_numpy().astype(np.int64)
        sketch = [part.column(c).to_numpy().view(np.uint64) for c in SKETCH]
        need = -((-share.numerator * size) // share.denominator)
        slack = size - 2 * need
        heads = np.array(pa.concat_arrays(part.column("counts").chunks).flatten()).reshape(len(size), -1)
        answers, counts = heads[:, 0] == 1, heads[:, 1:]
        raw = np.frombuffer(b"".join(part.column("signatures").to_pylist()), dtype=np.uint8).reshape(-1, WIDTH)
        sig = np.zeros(len(raw), dtype=np.uint64)
        for n in range(WIDTH):
            sig |= raw[:, n].astype(np.uint64) << np.uint64(8 * n)
        kind = np.repeat(np.tile(np.array(KINDS, dtype=np.int8), len(heads)), counts.ravel())
        row = np.repeat(np.arange(len(heads), dtype=np.int32), counts.sum(1))
        del raw

        def index(kinds: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
            """Answering signatures, each above its set's size, in order, and the sets."""
            some = np.flatnonzero(np.isin(kind, kinds) & answers[row])
            keys = (sig[some] << np.uint64(32)) | size[row[some]].astype(np.uint64)
            order = np.argsort(keys)
            return keys[order], row[some][order]

        out = [np.zeros(0, dtype=np.uint64)]
        for kinds, asked in (((FULL, FULL_EXACT, FULL_NEAR), (FULL_EXACT, FULL_NEAR, LESS_NEAR)), ((LESS, LESS_NEAR), (FULL_NEAR,))):
            keys, sets = index(kinds)
            some = np.flatnonzero(np.isin(kind, asked))
            # Only partners of a fitting size are looked up: the larger set asks.
            who = row[some]
            lo = np.searchsorted(keys, (sig[some] << np.uint64(32)) | need[who].astype(np.uint64))
            hi = np.searchsorted(keys, (sig[some] << np.uint64(32)) | size[who].astype(np.uint64), side="right")
            found = np.flatnonzero(hi > lo)
            lo, many, who = lo[found], (hi - lo)[found], who[found]
            upto = np.r_[0, np.cumsum(many)]
            a = 0
            while a < len(many):
                b = max(a + 1, int(np.searchsorted(upto, upto[a] + CHUNK, side="right")) - 1)
                # One list longer than a chunk is read in pieces.
                for c in range(0, int(upto[b] - upto[a]), CHUNK):
                    place = np.arange(c, min(c + CHUNK, int(upto[b] - upto[a])))
                    n = np.repeat(np.arange(b - a), many[a:b]) if b > a + 1 else np.zeros(len(place), dtype=np.int64)
                    x, y = who[a + n], sets[lo[a + n] + place - (upto[a + n] - upto[a])]
                    # Half of the sketch drops nearly all; the sum of two words' flips fits a byte.
                    bound = slack[x] + size[y]
                    flips = np.bitwise_count(sketch[0][x] ^ sketch[0][y]) + np.bitwise_count(sketch[1][x] ^ sketch[1][y])
                    close = np.flatnonzero(flips <= bound)
                    x, y, bound, flips = x[close], y[close], bound[close], flips[close].astype(np.int64)
                    flips += sum(np.bitwise_count(s[x] ^ s[y]).astype(np.int64) for s in sketch[2:])
                    fit = (flips <= bound) & ((size[x] > size[y]) | (name[x] < name[y]))
                    out.append(np.unique((x[fit].astype(np.uint64) << np.uint64(32)) | y[fit].astype(np.uint64)))
                a = b
        pairs = np.unique(np.concatenate(out))
        x, y = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        return pa.table({"class_a": name[x], "class_b": name[y]})

    return run


def _count_bins(classes: DataFrame) -> np.ndarray:
    """Texts by element bin: a table of COUNT_BINS numbers whatever the corpus."""
    rows = classes.select(F.explode("elements").alias("e")).groupBy(F.col("e").bitwiseAND(F.lit(COUNT_BINS - 1)).alias("bin")).count().collect()
    out = np.ones(COUNT_BINS)
    for r in rows:
        out[r["bin"]] = r["count"]
    return out


def _parts_of(classes: DataFrame, spare: float) -> dict[int, int]:
    """Parts that each size band is divided into; one row a band reaches the driver."""
    longest = classes.agg(F.max("size").alias("n")).first()["n"]
    if longest is None:
        return {}
    bands = _bands(int(longest))
    band = F.array_size(F.filter(F.lit([int(b) for b in bands]), lambda b: b <= F.col("size"))) - 1
    own = {r["band"]: r["n"] for r in classes.groupBy(band.alias("band")).agg(F.sum("size").alias("n")).collect()}
    # Segments and their one-deletion neighbours, of the band's own sets and of those above that probe it.
    return {b: max(1, -(-int(1.25 * (own.get(b, 0) + own.get(b + 1, 0))) // TASK_SIGNATURES)) for b in range(len(bands))}


def near_classes(classes: DataFrame, share: Fraction = Fraction(4, 5), spare: float = 1.15) -> DataFrame:
    """(class_a, class_b): different classes of which at least *share* of the larger one's elements are shared.

    *classes*: (class, size, sketch words, elements), one row a class.
    """
    slim = classes.select("class", "size", *SKETCH, "elements")
    rows = slim.mapInArrow(_signatures(share, _count_bins(classes), spare, _parts_of(classes, spare)), _ROWS)
    candidates = written(rows.groupBy("bucket").applyInArrow(_meet(share), "class_a bigint, class_b bigint").distinct(), "candidates")
    # Only classes with a candidate take their elements to the exact check.
    ends = candidates.select(F.explode(F.array("class_a", "class_b")).alias("class")).distinct()
    some = written(classes.select("class", "size", "elements").join(_sized(ends), "class", "left_semi"), "ends")
    a = some.select(F.col("class").alias("class_a"), F.col("size").alias("size_a"), F.col("elements").alias("ea"))
    b = some.select(F.col("class").alias("class_b"), F.col("elements").alias("eb"))
    need = F.ceil(F.col("size_a") * F.lit(share.numerator) / F.lit(share.denominator))
    exact = candidates.join(a, "class_a").join(b, "class_b").filter(F.size(F.array_intersect("ea", "eb")) >= need)
    return exact.select("class_a", "class_b")


def _sized(df: DataFrame) -> DataFrame:
    """A broadcast hint where the table has few rows, else the table as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def passages(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(membership (id, class, s0), classes with one row a class)."""
    sets = written(word_sets(df, key, text), "wordsets")
    members = sets.select("id", "class", "s0").distinct()
    # Rows of a repeated class but for its first; a repeated row of the same id is dropped by its class as well.
    many = _sized(written(sets.groupBy("class").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("class", "first"), "classes"))
    heads = sets.join(many, "class", "left").filter("first IS NULL OR first = id").drop("first")
    repeated = _sized(written(sets.groupBy("id").agg(F.count("*").alias("k")).filter("k > 1").select("id"), "repeated"))
    return members, heads.join(repeated, "id", "left_anti").unionByName(heads.join(repeated, "id", "left_semi").dropDuplicates(["class"]))


def near_pairs(df: DataFrame, key: str, text: str, share: Fraction = Fraction(4, 5)) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of different ids whose texts share at least *share* of the longer one's words."""
    members, classes = passages(df, key, text)
    same = pairs_within(members, ["class", "s0"], "id").select("id_a", "id_b")
    links = near_classes(classes, share)
    # The members of a large class are spread over salts, its links repeated.
    spread = members.select("class", "id", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    hot = _sized(written(members.groupBy("class").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_GROUP).select("class", F.lit(True).alias("hot")), "hot"))

    def to_members(table: DataFrame, end: str, out: str) -> DataFrame:
        some = table.join(hot.withColumnRenamed("class", end), end, "left").withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1))))).drop("hot")
        marked = spread.join(hot, "class", "left").select(F.col("class").alias(end), F.col("id").alias(out), F.when(F.col("hot"), F.col("salt")).otherwise(F.lit(-1)).alias("salt"))
        return some.join(marked, [end, "salt"]).drop("salt", end)

    across = to_members(to_members(links, "class_a", "x"), "class_b", "y")
    across = across.filter("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return same.unionByName(across).distinct()


def near_links(df: DataFrame, key: str, text: str, share: Fraction = Fraction(4, 5)) -> DataFrame:
    """(id, class, links): one row a text with its class and the number of other classes it is linked to."""
    members, classes = passages(df, key, text)
    links = near_classes(classes, share)
    ends = links.select(F.col("class_a").alias("class")).unionByName(links.select(F.col("class_b").alias("class"))).groupBy("class").agg(F.count("*").alias("links"))
    return members.select("id", "class").distinct().join(ends, "class", "left").select("id", "class", F.coalesce("links", F.lit(0)).alias("links"))
