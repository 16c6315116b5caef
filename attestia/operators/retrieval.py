"""Keyword, vector and hybrid search over tables of queries and passages.

Scale: postings are one row a (passage, term); only terms that a query has are kept; document frequencies are
aggregated with map-side combine. Postings meet the queries in buckets of counted size, a frequent term cut by passage,
and a term of many queries by query; no (query, passage) pair leaves a bucket that is not among its best there.
Ranking is per query with a window that Spark prunes to the wanted ranks before the shuffle. Null texts have no terms.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestia.functions.text import terms
from attestia.session import written

# Fixed values of the ranking.
K1, B, RRF, PER_CHANNEL, PER_DOCUMENT, MOST_TERMS = 1.2, 0.75, 60, 40, 2, 64
#: Query vectors and passage vectors of a task.
BLOCK_ASKED, BLOCK_OWN = 32_768, 65_536
#: Postings and tails of a task of the keyword search.
BUCKET_POSTINGS, BUCKET_TAILS = 100_000, 5_000
#: Rows that may be broadcast; beyond that the joins shuffle.
BROADCAST_ROWS = 200_000


def postings(passages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, length, term): distinct terms, so a term counts once a passage."""
    return passages.select(key, terms(F.col(text)).alias("t")).select(key, F.size("t").alias("length"), F.explode("t").alias("term"))


def bm25(queries: DataFrame, query_key: str, query_text: str, passages: DataFrame, key: str, text: str, top: int, normalize: bool = False) -> DataFrame:
    """(query_key, key, score, rank): the *top* passages of each query; ties by key.

    A query's terms in order of rarity give its tails: the terms from each one on. A passage is scored in the group of a
    term by the tails that begin with it, and only a tail's best *top* leave the group. The tail of a passage's rarest
    term of the query is its whole score, any other is less, so the largest counts; equal tails are scored once.
    """
    asked = queries.select(F.col(query_key).alias("_query"), F.slice(terms(F.col(query_text), normalize), 1, MOST_TERMS).alias("t")).select("_query", F.explode("t").alias("term"))
    asked = written(asked.groupBy("_query", "term").agg(F.count("*").alias("times")), "asked")
    known = sized(asked.select("term", F.lit(True).alias("known")).distinct())
    # Postings of the queries' terms, and a row without term for each passage: the texts are cut into terms once.
    cut = passages.select(F.col(key).alias("_key"), terms(F.col(text), normalize).alias("t")).select("_key", F.size("t").alias("length"), F.explode(F.concat(F.array(F.lit(None).cast("string")), "t")).alias("term"))
    post = written(cut.join(known, "term", "left").filter("term IS NULL OR known").drop("known"), "postings")
    totals = post.filter("term IS NULL").agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    post = post.filter("term IS NOT NULL")
    df = written(post.groupBy("term").agg(F.count("*").alias("df")), "frequencies")
    buckets = max(1, -(-(df.agg(F.sum("df").alias("n")).first()["n"] or 0) // BUCKET_POSTINGS))
    mean = float(totals["mean"] or 1.0)
    idf = F.greatest(F.log((F.lit(totals["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    by = [F.col("df"), F.xxhash64("term").alias("id")]

    # Each query's terms, rarest first, and its tails.
    weighed = asked.join(df, "term").groupBy("_query").agg(F.array_sort(F.collect_list(F.struct(*by, (idf * F.col("times")).alias("idf")))).alias("w"))
    weighed = written(weighed.withColumn("whole", F.xxhash64("w")), "weighed")
    tails = weighed.select("whole", "w").dropDuplicates(["whole"]).select("whole", F.posexplode("w").alias("at", "first"), "w")
    tails = tails.select("whole", "first.id", "first.df", F.slice("w", F.col("at") + 1, F.size("w")).alias("w")).withColumn("tail", F.xxhash64("w"))
    chains, once = tails.select("whole", "tail"), tails.select("tail", "id", "df", F.transform("w", lambda x: x["id"]).alias("ids"), F.transform("w", lambda x: x["idf"]).alias("idfs")).dropDuplicates(["tail"])

    # Large groups are cut by passage and by tail.
    shares = written(once.groupBy("id").agg(F.max("df").alias("df"), F.count("*").alias("tails")).select("id", F.ceil(F.col("df") / BUCKET_POSTINGS).cast("int").alias("salts"), F.ceil(F.col("tails") / BUCKET_TAILS).cast("int").alias("parts")), "shares")
    bucket = lambda salt, part: F.pmod(F.xxhash64("id", salt, part), F.lit(buckets)).cast("int")
    spread = once.join(sized(shares), "id").withColumn("part", F.pmod(F.col("tail"), F.col("parts")).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    spread = spread.select(bucket("salt", "part").alias("bucket"), "id", "salt", "part", "tail", "ids", "idfs")

    # A passage's factors by term, in the same order; rows of one key add up.
    factor = (K1 + 1) / (1 + K1 * (1 - B + B * F.col("length") / F.lit(mean)))
    own = post.join(sized(df), "term").select("_key", *by, factor.alias("factor")).repartition("_key").groupBy("_key", "df", "id").agg(F.sum("factor").alias("factor"))
    own = own.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("df", "id", "factor"))).alias("w"))
    own = own.select("_key", F.transform("w", lambda x: x["id"]).alias("ids"), F.transform("w", lambda x: x["factor"]).alias("factors")).select("_key", F.posexplode("ids").alias("at", "id"), "ids", "factors")
    rest = lambda c: F.slice(c, F.col("at") + 1, F.size("ids")).alias(c)
    own = own.select("_key", "id", rest("ids"), rest("factors")).join(sized(shares), "id").withColumn("salt", F.pmod(F.xxhash64("_key"), F.col("salts")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    own = own.select(bucket("salt", "part").alias("bucket"), "id", "salt", "part", "_key", "ids", "factors")

    found = own.groupBy("bucket").cogroup(spread.groupBy("bucket")).applyInArrow(_tail_scorer(top), f"tail bigint, _key {dict(passages.dtypes)[key]}, score double")
    best = written(ranked(found, "tail", "_key", top), "tails")
    # What is below the last of a query's whole tail can't be among its best.
    least = best.filter(F.col("rank") == top).select(F.col("tail").alias("whole"), F.col("score").alias("least"))
    merged = chains.join(least, "whole", "left").join(best.drop("rank"), "tail").filter("least IS NULL OR score >= least")
    merged = merged.select("whole", "_key", "score").repartition("whole").groupBy("whole", "_key").agg(F.max("score").alias("score"))
    return weighed.select("_query", "whole").join(ranked(merged, "whole", "_key", top), "whole").select(F.col("_query").alias(query_key), F.col("_key").alias(key), "score", "rank")


def _tail_scorer(top: int):
    """A function for cogrouped applyInArrow over a bucket: the best *top* passages of every tail by its terms."""

    def run(own: pa.Table, tails: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        own, tails = own.combine_chunks(), tails.combine_chunks()
        kind = own.schema.field("_key").type
        out_tail, out_at, out_score = [], [], []
        if own.num_rows and tails.num_rows:
            own = own.take(pc.sort_indices(own, sort_keys=[("id", "ascending"), ("salt", "ascending"), ("part", "ascending"), ("_key", "ascending")], null_placement="at_start"))
            tails = tails.take(pc.sort_indices(tails, sort_keys=[("id", "ascending"), ("salt", "ascending"), ("part", "ascending")]))

            def flat(table: pa.Table, *names: str) -> tuple:
                lists = [table.column(c).combine_chunks() for c in names]
                lists = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in lists]
                ends = np.r_[0, np.cumsum(pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False))]
                return ends, *(c.flatten().to_numpy(zero_copy_only=False) for c in lists)

            def groups(table: pa.Table) -> tuple[list, np.ndarray]:
                cols = [table.column(c).to_numpy() for c in ("id", "salt", "part")]
                new = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in cols], axis=0)])
                return list(zip(*(c[new].tolist() for c in cols))), np.r_[new, table.num_rows]

            ends, ids, factors = flat(own, "ids", "factors")
            tail_ends, tail_ids, idfs = flat(tails, "ids", "idfs")
            tail_names = tails.column("tail").to_numpy()
            names, at = groups(own)
            place = {g: (at[n], at[n + 1]) for n, g in enumerate(names)}
            names, at = groups(tails)
            for n, g in enumerate(names):
                if g not in place:
                    continue
                a, b = place[g]
                many = np.diff(ends[a : b + 1])
                some, some_factors, row = ids[ends[a] : ends[b]], factors[ends[a] : ends[b]], np.repeat(np.arange(b - a), many)
                order = np.argsort(some, kind="stable")
                some, some_factors, row = some[order], some_factors[order], row[order]
                for t in range(at[n], at[n + 1]):
                    score = np.zeros(b - a)
                    mine = tail_ids[tail_ends[t] : tail_ends[t + 1]]
                    lo, hi = np.searchsorted(some, mine), np.searchsorted(some, mine, side="right")
                    for x, y, idf in zip(lo.tolist(), hi.tolist(), idfs[tail_ends[t] : tail_ends[t + 1]].tolist()):
                        score[row[x:y]] += some_factors[x:y] * idf  # a passage has a term once
                    score = np.floor(score * 1e6 + 0.5) / 1e6
                    kept = np.arange(b - a) if b - a <= top else np.flatnonzero(score >= np.partition(score, b - a - top)[b - a - top])
                    kept = kept[np.argsort(-score[kept], kind="stable")[:top]]  # rows are in order of their keys
                    out_tail.append(np.full(len(kept), tail_names[t]))
                    out_at.append(kept + a)
                    out_score.append(score[kept])
        if not out_at:
            return pa.table([pa.array([], pa.int64()), pa.array([], kind), pa.array([], pa.float64())], names=["tail", "_key", "score"])
        return pa.table([pa.array(np.concatenate(out_tail)), own.column("_key").take(pa.array(np.concatenate(out_at))), pa.array(np.concatenate(out_score))], names=["tail", "_key", "score"])

    return run


def sized(df: DataFrame) -> DataFrame:
    """A broadcast hint where the table has few rows, else the table as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def ranked(scores: DataFrame, query_key: str, key: str, top: int, ties: str = "asc") -> DataFrame:
    w = Window.partitionBy(query_key).orderBy(F.col("score").desc(), F.col(key).desc() if ties == "desc" else F.col(key))
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles, added in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_topk(queries: DataFrame, query_key: str, query_vector: str, passages: DataFrame, key: str, vector: str, top: int, least: float, ties: str = "asc") -> DataFrame:
    """(query_key, key, score, rank) by inner product of unit vectors, scores of *least* or more.

    Every query meets every passage of its vector's length, in a grid of query blocks and passage blocks: a vector is sent
    once to each block of the other side, and a block keeps a query's best only. The work is queries times passages; for
    every vector against every other use a graph index instead. Null vectors match nothing.
    """
    asked = queries.select(F.col(query_key).alias("_query"), F.col(query_vector).alias("_v")).filter("_v IS NOT NULL")
    own = passages.select(F.col(key).alias("_key"), F.col(vector).alias("_v")).filter("_v IS NOT NULL")
    across, down = (max(1, -(-df.count() // most)) for df, most in ((asked, BLOCK_ASKED), (own, BLOCK_OWN)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("_a", part("_query", across)).withColumn("_b", every(down))
    right = own.withColumn("_b", part("_key", down)).withColumn("_a", every(across))
    schema = f"_query {dict(queries.dtypes)[query_key]}, _key {dict(passages.dtypes)[key]}, score double"
    found = left.groupBy("_a", "_b").cogroup(right.groupBy("_a", "_b")).applyInArrow(_block_scorer(top, least, ties), schema)
    return ranked(found, "_query", "_key", top, ties).select(F.col("_query").alias(query_key), F.col("_key").alias(key), "score", "rank")


def _block_scorer(top: int, least: float, ties: str):
    """A function for cogrouped applyInArrow: a block's queries and passages -> each query's best *top* pairs."""

    def run(asked: pa.Table, own: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        asked, desc = asked.combine_chunks(), ties == "desc"
        # In the order that ties take.
        own = own.take(pc.sort_indices(own, sort_keys=[("_key", "descending" if desc else "ascending")], null_placement="at_end" if desc else "at_start")).combine_chunks()
        out = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]

        def matrices(table: pa.Table):
            lengths = pc.list_value_length(table.column("_v")).to_numpy()
            for size in np.unique(lengths[lengths > 0]).tolist():
                some = np.flatnonzero(lengths == size)
                yield size, some, np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column("_v").take(pa.array(some)).chunks]).astype(np.float64).reshape(-1, size)

        right = {size: (some, V) for size, some, V in matrices(own)}
        for size, who, Q in matrices(asked):
            if size not in right:
                continue
            what, V = right[size]
            with np.errstate(all="ignore"):
                norm_q, norm_v = np.linalg.norm(Q, axis=1), np.fmax.reduce(np.linalg.norm(V, axis=1))
                reach = np.fmax.reduce(norm_q) * norm_v
                # Single precision finds what can be among the best, double precision scores it.
                single = bool(reach < 1e30)
                slack = 2e-6 + (norm_q * norm_v * (4e-7 * (size + 8)) if single else np.zeros(len(Q)))
                q_fast, v_fast = (Q.astype(np.float32), V.astype(np.float32)) if single else (Q, V)
            for a in range(0, len(Q), 256):
                n = min(256, len(Q) - a)
                last = np.full(n, least, dtype=np.float64)
                held, fresh, waiting = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)), [], 0
                for b in range(0, len(V), 4096):
                    with np.errstate(all="ignore"):
                        scores = q_fast[a : a + n] @ v_fast[b : b + 4096].T
                        q, x = np.divmod(np.flatnonzero(scores >= (last - slack[a : a + n]).astype(scores.dtype)[:, None]), scores.shape[1])
                        exact = np.round(np.einsum("ij,ij->i", Q[a + q], V[b + x]), 6)
                        fit = exact >= last[q]
                    fresh.append((q[fit], b + x[fit], exact[fit]))
                    waiting += len(fresh[-1][0])
                    if waiting >= 4096 or b + 4096 >= len(V):
                        q, x, exact = (np.concatenate(c) for c in zip(held, *fresh))
                        order = np.lexsort((x, -exact, q))
                        q, x, exact = q[order], x[order], exact[order]
                        nth = np.arange(len(q)) - np.searchsorted(q, q)
                        ends = nth == top - 1
                        last[q[ends]] = exact[ends]
                        held, fresh, waiting = tuple(c[nth < top] for c in (q, x, exact)), [], 0
                out.append((who[a + held[0]], what[held[1]], held[2]))
        q, x, exact = (np.concatenate(c) for c in zip(*out))
        return pa.table([asked.column("_query").take(pa.array(q)), own.column("_key").take(pa.array(x)), pa.array(exact)], names=["_query", "_key", "score"])

    return run


def fused(channels: dict[str, DataFrame], query_key: str, key: str, limit: int, document: str | None = None) -> DataFrame:
    """Reciprocal rank fusion of ranked channels; *document* maps a passage to its group, of which two are kept."""
    rows = None
    for n, (name, df) in enumerate(channels.items()):
        some = df.filter(F.col("rank") <= PER_CHANNEL).select(query_key, key, "rank", F.lit(n).alias("o"), F.lit(name).alias("channel"), *([document] if document else []))
        rows = some if rows is None else rows.unionByName(some)
    rows = rows.repartition(query_key)  # all that follows is within a query
    by = [query_key, key, *([document] if document else [])]
    out = rows.groupBy(*by).agg(F.round(F.sum(F.lit(1.0) / (F.col("rank") + RRF)), 6).alias("score"), F.transform(F.array_sort(F.collect_list(F.struct("o", "channel"))), lambda s: s["channel"]).alias("matched_by"))
    if document:
        w = Window.partitionBy(query_key, document).orderBy(F.col("score").desc(), key)
        out = out.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= PER_DOCUMENT).drop("_r")
    return ranked(out, query_key, key, limit)
