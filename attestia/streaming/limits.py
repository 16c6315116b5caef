"""Stateful streaming: rolling admission, task summaries and change signatures."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Requests accepted in a rolling window.
WINDOW_US, ACCEPTED = 60_000_000, 10


def admit(times: list[int], at: int, window: int = WINDOW_US, most: int = ACCEPTED) -> tuple[list[int], bool]:
    """The accepted times still in the window after a request at *at*, and whether it is accepted; rejected ones leave no trace."""
    times = [t for t in times if t > at - window]
    return (times + [at], True) if len(times) < most else (times, False)


def admissions(events: DataFrame, key: str, at: str, event_id: str, watermark: str = "10 minutes") -> DataFrame:
    """(key, event_id, accepted): exact rolling admission of a stream, at most ACCEPTED a key in WINDOW_US.

    *at* is a TIMESTAMP. State holds the accepted times of one window per key and is dropped when the
    watermark has passed it; rows of a micro-batch are taken in time order.
    """
    kinds = dict(events.dtypes)
    out = f"{key} {kinds[key]}, {event_id} {kinds[event_id]}, accepted boolean"

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values(["us", event_id])
        times = list(state.get[0]) if state.exists else []
        got = []
        for t in rows["us"]:
            times, ok = admit(times, int(t))
            got.append(ok)
        state.update((times,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (max(times) if times else 0) // 1000 + WINDOW_US // 1000 + 1))
        yield pd.DataFrame({key: rows[key].to_numpy(), event_id: rows[event_id].to_numpy(), "accepted": got})

    src = events.withWatermark(at, watermark).select(key, event_id, at, F.unix_micros(at).alias("us"))
    return src.groupBy(key).applyInPandasWithState(run, out, "times array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def admissions_batch(events: DataFrame, key: str, at: str, event_id: str) -> DataFrame:
    """The same decisions over a finished table: rows are sorted by key and time within partitions and folded as they
    stream by, so a key of any size takes no more memory than one window of it. Null times are never accepted."""
    kinds = dict(events.dtypes)
    rows = events.select(key, F.unix_micros(F.col(at).cast("timestamp")).alias("us"), event_id).repartition(key).sortWithinPartitions(key, "us", event_id)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, times = object(), []
        for part in parts:
            got = []
            for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if k != now:
                    now, times = k, []
                ok = False
                if t is not None:
                    times, ok = admit(times, t)
                got.append(ok)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(got, pa.bool_())], names=[key, event_id, "accepted"])

    return rows.mapInArrow(run, f"{key} {kinds[key]}, {event_id} {kinds[event_id]}, accepted boolean")


def windowed_counts(events: DataFrame, at: str, kind: str, width: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """(window start, kind, n, value) of tumbling windows; late rows beyond the watermark are dropped. Works on streams and tables."""
    return events.withWatermark(at, watermark).groupBy(F.window(at, width), kind).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.col("window.start").alias("start"), kind, "n", "value")


def newest_generation(rows: DataFrame, key: str, generation: str) -> DataFrame:
    """Rows of the newest generation of each key: stale responses are left out."""
    newest = rows.groupBy(key).agg(F.max(generation).alias(generation))
    return rows.join(newest, [key, generation], "left_semi")


def changed(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of *new* whose signature over *columns* differs from that of *old*, or that *old* lacks."""
    sign = lambda df: df.select(key, F.xxhash64(*columns).alias("_sign"))
    return new.withColumn("_sign", F.xxhash64(*columns)).join(sign(old), [key, "_sign"], "left_anti").drop("_sign")


#: Steps of a task and of a claim that may follow each other.
STEPS = {
    "task": {"created": ("running", "interrupted"), "running": ("succeeded", "partial", "failed", "interrupted"), "interrupted": ("running",), "partial": ("running",), "succeeded": ("running",), "failed": ("running",)},
    "claim": {"pending": ("retrieving", "done", "unchecked", "failed"), "retrieving": ("judging", "done", "failed", "unchecked"), "judging": ("done", "failed", "unchecked"), "failed": ("pending",), "unchecked": ("pending",), "done": ("pending",)},
}


def transitions(events: DataFrame, key: str, state: str, order: list[str], kind: str = "claim") -> DataFrame:
    """*events* with *before* and *legal*: each step of a key against the one before it; the first one may be any."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    allowed = F.create_map(*[x for a, bs in STEPS[kind].items() for x in (F.lit(a), F.array(*map(F.lit, bs)))])
    legal = before.isNull() | (before == F.col(state)) | F.coalesce(F.array_contains(F.try_element_at(allowed, before), F.col(state)), F.lit(False))
    return events.withColumn("before", before).withColumn("legal", legal)


def within_budget(claims: DataFrame, task: str, order: list[str], cost: str, budget: float, reserve: tuple[float, float] = (30.0, 0.4)) -> DataFrame:
    """*claims* with *started*: whether a claim may start before its task's *budget* less the reserve for judging (the
    smaller of *reserve*[0] and the share *reserve*[1] of what is left) is spent by those before it."""
    spent = F.coalesce(F.sum(cost).over(Window.partitionBy(task).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.lit(float(budget)) - spent
    return claims.withColumn("started", left - F.least(F.lit(reserve[0]), left * reserve[1]) > 0)


def recovered(tasks: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks and claims after a restart: active tasks are interrupted, their active claims failed without a label."""
    active = F.col("status").isin("created", "running")
    hit = tasks.filter(active).select("task_id", F.lit(True).alias("_hit"))
    out = claims.join(hit, "task_id", "left").withColumn("_hit", F.coalesce(F.col("_hit") & F.col("state").isin("pending", "retrieving", "judging"), F.lit(False)))
    out = out.withColumn("label", F.when(~F.col("_hit"), F.col("label"))).withColumn("state", F.when(F.col("_hit"), "failed").otherwise(F.col("state"))).drop("_hit")
    return tasks.withColumn("status", F.when(active, "interrupted").otherwise(F.col("status"))), out.select(claims.columns)


def imported_stream(files: DataFrame, splitter) -> DataFrame:
    """Chunks of a stream of documents (document_id, pages): *splitter* turns a DataFrame of documents into chunks; a
    document delivered again within the watermark of *arrived* is left out."""
    once = files.withWatermark("arrived", "1 day").dropDuplicatesWithinWatermark(["document_id"])
    return splitter(once)
