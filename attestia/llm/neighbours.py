"""The k most similar vectors of every vector, from robust-pruned directed graphs.

Vectors are divided into shards by their nearest centre (k-means on a bounded sample; every vector is
indexed). Each shard builds a directed graph in batches: greedy searches propose neighbours, relaxed
distance pruning (a candidate is dropped when a kept neighbour is closer to it by the factor alpha)
keeps diverse edges, reverse edges are added and pruned again. Each vector then runs a beam search in
its own shard and in its next nearest shards. Within a shard all searches advance together, so the work is
array arithmetic. A shard that grows beyond SHARD_MOST rows is divided by hash, and queries visit every part.

Equal directions are one point: copies share one search, and a point's copies enter results by id.
Defined results: null vectors and elements, wrong lengths, non-finite and all-zero vectors and other models are not
usable; equal similarities go to the smaller id; repeated rows count once; fewer than k others give all.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestia.session import written

#: Rows the centres are fitted on (SAMPLE_A_CENTRE for each centre where that is more, MOST_SAMPLE at most).
SAMPLE, SAMPLE_A_CENTRE, MOST_SAMPLE = 20_000, 10, 200_000
#: Rows a shard aims at and may hold.
SHARD_AIM, SHARD_MOST = 16_000, 48_000
DEGREE, BEAM, PROBES, ALPHA = 20, 40, 7, 1.2


def usable(df: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """(id, v, point): the stored vectors that have *size* finite values which aren't all zero; equal directions are one point."""
    kind = "array<double>" if dict(df.dtypes)[vector] == "array<double>" else "array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            lengths = np.array(batch.column(1).value_lengths().fill_null(-1))
            some = np.flatnonzero((lengths == size) & np.array(batch.column(0).is_valid()))
            batch = batch.take(pa.array(some))
            X = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(some), size)
            good = np.isfinite(X).all(1) & (X != 0).any(1) if len(some) else np.zeros(0, dtype=bool)
            batch, X = batch.filter(pa.array(good)), X[good]
            if not len(X):
                continue
            X = X / np.abs(X).max(1, keepdims=True)
            steps = np.round(X / np.linalg.norm(X, axis=1, keepdims=True) * 1e7).astype(np.int64).view(np.uint64)
            with np.errstate(over="ignore"):
                x = (steps + odd * np.arange(1, size + 1, dtype=np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                point = (x ^ (x >> np.uint64(32))).sum(1, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(point.view(np.int64))], names=["id", "v", "point"])

    # A null element reads as not a number.
    return df.select(F.col(key).cast("string").alias("id"), F.col(vector).cast(kind).alias("v")).filter("v IS NOT NULL").mapInArrow(run, f"id string, v {kind}, point bigint")


def centres(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """At most *count* unit centres, by k-means on the sphere, in blocks of bounded size."""
    rng = np.random.default_rng(7)
    c = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)]
    step = max(1, 20_000_000 // len(c))
    for _ in range(rounds):
        near = np.concatenate([(sample[a : a + step] @ c.T).argmax(1) for a in range(0, len(sample), step)])
        m = np.zeros(c.shape, dtype=np.float64)
        np.add.at(m, near, sample)
        some = np.bincount(near, minlength=len(c)) > 0
        c[some] = (m[some] / np.maximum(np.linalg.norm(m[some], axis=1, keepdims=True), 1e-12)).astype(c.dtype)
    return c


def prune(X: np.ndarray, me: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning of candidate lists (rows of ids, -1 empty) for the points *me*, all rows together."""
    B = len(me)
    out = np.full((B, degree), -1, dtype=np.int32)
    cand = np.where(cand == me[:, None], -1, cand)
    order = np.argsort(cand, axis=1)
    cand = np.take_along_axis(cand, order, 1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    V = X[cand]
    dist = np.where(cand >= 0, 1 - np.einsum("bcd,bd->bc", V, X[me]), np.inf)
    for r in range(degree):
        best = dist.argmin(1)
        alive = np.isfinite(dist[np.arange(B), best])
        if not alive.any():
            break
        kept = np.where(alive, cand[np.arange(B), best], -1)
        out[:, r] = kept
        between = 1 - np.einsum("bcd,bd->bc", V, X[kept])
        drop = (alpha * between <= dist) & alive[:, None]
        dist[drop] = np.inf
        dist[np.arange(B), best] = np.inf
    return out


def search(X: np.ndarray, graph: np.ndarray, start: np.ndarray, Q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all queries at once: (ids, similarities), best first; -1 where a list is short."""
    n, B = len(X), len(Q)
    ids = np.full((B, beam), -1, dtype=np.int32)
    sims = np.full((B, beam), -np.inf, dtype=np.float32)
    done = np.zeros((B, beam), dtype=bool)
    s = min(len(start), beam)
    ids[:, :s], sims[:, :s] = start[:s], Q @ X[start[:s]].T
    seen = np.zeros((B, n), dtype=bool)
    seen[:, start[:s]] = True
    live = np.arange(B)
    # Every step expands new entries and a beam's entries only improve, so the search ends by itself.
    while len(live):
        # Expand the two best unexpanded entries of each live query.
        score = np.where(done[live] | (ids[live] < 0), -np.inf, sims[live])
        pick = np.argpartition(-score, 1, axis=1)[:, :2]
        good = np.take_along_axis(score, pick, 1) > -np.inf
        stay = good.any(1)
        live, pick, good = live[stay], pick[stay], good[stay]
        if not len(live):
            break
        node = np.where(good, ids[live[:, None], pick], -1)
        done[live[:, None], pick] = True
        near = np.where(node[:, :, None] >= 0, graph[node], -1).reshape(len(live), -1)
        near[seen[live[:, None], near] & (near >= 0)] = -1
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        hit = near >= 0
        r, c = np.nonzero(hit)
        seen[live[r], near[r, c]] = True
        found = np.full(near.shape, -np.inf, dtype=np.float32)
        found[r, c] = np.einsum("nd,nd->n", X[near[r, c]], Q[live[r]])
        all_s = np.concatenate([sims[live], found], 1)
        top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
        sims[live] = np.take_along_axis(all_s, top, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], near], 1), top, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], np.zeros(near.shape, bool)], 1), top, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def build(X: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """(graph, entry points) of one shard. Points enter in batches that double, each searched for in the graph so far."""
    n, room = len(X), degree + degree // 2
    order = np.random.default_rng(11).permutation(n).astype(np.int32)
    first = min(n, room)
    start = order[: min(n, 6)]
    graph = np.full((n, room), -1, dtype=np.int32)
    graph[order[:first], :first] = np.where(order[:first] == order[:first, None], -1, order[:first])
    at = first
    while at < n:
        new = order[at : at + min(at, 1000)]
        at += len(new)
        ids, _ = search(X, graph, start, X[new], beam)
        graph[new, :degree] = prune(X, new, ids, degree, alpha)
        # Reverse edges by their new source, those with fewest first, so that lists are padded little.
        src, dst = graph[new, :degree].ravel(), np.repeat(new, degree)
        src, dst = src[src >= 0], dst[src >= 0]
        by = np.argsort(src, kind="stable")
        src, dst = src[by], dst[by]
        who, begin, count = np.unique(src, return_index=True, return_counts=True)
        few = np.argsort(count, kind="stable")
        for some in np.array_split(few, max(1, len(few) // 500)):
            width = int(count[some].max())
            column = begin[some, None] + np.arange(width)
            extra = np.where(np.arange(width) < count[some, None], dst[np.minimum(column, len(dst) - 1)], -1)
            lists = np.concatenate([graph[who[some]], extra], 1)
            over = (lists >= 0).sum(1) > room
            graph[who[some[~over]]] = -np.sort(-lists[~over], axis=1)[:, :room]
            if over.any():
                graph[who[some[over]]] = -1
                graph[who[some[over]], :degree] = prune(X, who[some[over]], lists[over], degree, alpha)
    return graph, start


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit rows, in doubles."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    X = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in chunks]).astype(np.float64).reshape(len(column), -1)
    X /= np.abs(X).max(1, keepdims=True)
    return X / np.linalg.norm(X, axis=1, keepdims=True)


_FOUND = "point bigint, near array<struct<similarity: double, other: bigint>>"


def _answer(k: int, beam: int):
    """A function for applyInArrow over a part of a shard: its own points are indexed, all its rows ask."""

    def run(part: pa.Table) -> pa.Table:
        V, names, own = _matrix(part.column("v")), part.column("point").to_numpy(), part.column("own").to_numpy(zero_copy_only=False).astype(bool)
        exact, known, most = V[own], names[own], k + 3
        points, others, similarities, lengths = [names[:0]], [names[:0]], [np.zeros(0)], [np.zeros(0, dtype=np.int64)]
        if own.any():
            X = exact.astype(np.float32)
            graph, start = build(X)
            for a in range(0, len(V), 1000):
                Q = V[a : a + 1000]
                ids, _ = search(X, graph, start, Q.astype(np.float32), beam)
                # Exact similarities of the proposals; the point itself is none.
                r, c = np.nonzero((ids >= 0) & (known[ids] != names[a : a + 1000, None]))
                sims = np.full(ids.shape, -np.inf)
                sims[r, c] = np.einsum("nd,nd->n", exact[ids[r, c]], Q[r])
                order = np.argsort(-sims, axis=1, kind="stable")[:, :most]
                sims, ids = np.take_along_axis(sims, order, 1), np.take_along_axis(ids, order, 1)
                good = sims > -np.inf
                points.append(names[a : a + 1000])
                lengths.append(good.sum(1))
                others.append(known[ids[good]])
                similarities.append(sims[good])
        ends = np.r_[0, np.cumsum(np.concatenate(lengths))]
        near = pa.StructArray.from_arrays([pa.array(np.concatenate(similarities)), pa.array(np.concatenate(others))], names=["similarity", "other"])
        return pa.table({"point": pa.array(np.concatenate(points)), "near": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), near)})

    return run


def nearest(df: DataFrame, key: str, vector: str, k: int = 5, size: int = 64, probes: int = PROBES, beam: int = BEAM, aim: int = SHARD_AIM) -> DataFrame:
    """(id, neighbour, similarity): the *k* most similar others of every usable vector of *df*."""
    points = usable(df, key, vector, size)
    members = points.select("id", "point").distinct()
    reps = written(points.groupBy("point").agg(F.min_by("v", "id").alias("v"), F.countDistinct("id").alias("n")), "points")
    total = reps.count()
    if not total:
        return members.select("id", F.lit(None).cast("string").alias("neighbour"), F.lit(None).cast("double").alias("similarity")).limit(0)
    # The k + 1 smallest ids of a point with copies, salted so that many copies never meet in one task.
    copied = members.join(reps.filter("n > 1").select("point"), "point", "left_semi").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(32)))
    top = copied.withColumn("r", F.row_number().over(Window.partitionBy("point", "salt").orderBy("id"))).filter(F.col("r") <= k + 1)
    copies = top.groupBy("point").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids"))
    names = members.join(reps.filter("n = 1").select("point"), "point", "left_semi").select("point", F.array("id").alias("ids")).unionByName(copies)

    count = max(1, round(total / aim))
    room = min(MOST_SAMPLE, max(SAMPLE, SAMPLE_A_CENTRE * count))
    share = min(1.0, 1.2 * room / total)
    sample = reps.filter(F.pmod(F.xxhash64("point"), F.lit(1_000_003)) < int(1_000_003 * share)).select("v").limit(room).toArrow()
    if not sample.num_rows:
        sample = reps.select("v").limit(1).toArrow()
    hubs = centres(_matrix(sample.column("v")).astype(np.float32), count)
    near = min(probes, len(hubs))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                order = np.argsort(-(_matrix(batch.column(1)).astype(np.float32) @ hubs.T), axis=1, kind="stable")[:, :near].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(order) + 1) * near, pa.int32()), pa.array(order.ravel()))], names=["point", "v", "shards"])

    placed = reps.select("point", "v").mapInArrow(place, f"point bigint, v {dict(reps.dtypes)['v']}, shards array<int>")
    load = {r["s"]: r["count"] for r in placed.groupBy(F.col("shards")[0].alias("s")).count().filter(F.col("count") > SHARD_MOST).collect()}
    rows = placed.select("point", "v", F.posexplode("shards").alias("rank", "shard")).withColumn("own", F.col("rank") == 0)
    # Only a shard that is too large is divided, by hash: its own points go to one part, every query to all.
    parts = F.coalesce(F.try_element_at(F.create_map(*[x for s, n in load.items() for x in (F.lit(s), F.lit(-(-n // SHARD_MOST)))]), F.col("shard")), F.lit(1)) if load else F.lit(1)
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("own", F.col("own") & (F.pmod(F.xxhash64("point", F.lit(3)), parts) == F.col("part")))
    found = rows.select("shard", "part", "point", "v", "own").groupBy("shard", "part").applyInArrow(_answer(k, beam), _FOUND)
    best = found.groupBy("point").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near")), False), 1, k + 3).alias("near"))
    # A point with copies is its own first neighbour.
    own = reps.filter("n > 1").select("point", F.array(F.struct(F.lit(1.0).alias("similarity"), F.col("point").alias("other"))).alias("near"))
    lists = best.unionByName(own).select("point", F.explode("near").alias("near")).select("point", F.col("near.other").alias("other"), F.round("near.similarity", 12).alias("similarity"))
    named = lists.join(names.withColumnRenamed("point", "other"), "other").groupBy("point").agg(
        F.slice(F.array_sort(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("similarity")).alias("s"), i.alias("id")))))), 1, k + 1).alias("near")
    )
    out = members.join(named, "point").select("id", F.slice(F.filter("near", lambda n: n["id"] != F.col("id")), 1, k).alias("near"))
    return out.select("id", F.explode("near").alias("n")).select("id", F.col("n.id").alias("neighbour"), (-F.col("n.s")).alias("similarity"))
