"""Keyed state over event tables: rate limits, caches with a time to live, cooldowns, jobs.

A null key is a key as any other. Rows that tie in time go by event_id.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import running
from .evaluation import percentile_by_index  # noqa: F401  (its place was here)


def _in_turn(events: DataFrame, keys: list[str], more: list[str], name: str, start: Callable[[], Callable[..., bool]]) -> DataFrame:
    """Adds a boolean that depends on all earlier rows of the key: start() gives a function that takes each row's time and `more` columns in turn.

    Sequential for a key, but never gathered: a task streams its keys' rows in order and holds one key's state.
    """
    dealt = events.withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp"))).repartition(*keys).sortWithinPartitions(*keys, "_at", "event_id")
    schema = dealt.drop("_at").withColumn(name, F.lit(True)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = None, start()
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()  # noqa: B023, E731
            out = []
            for key, at, *rest in zip(zip(*map(column, keys)), column("_at"), *map(column, more)):
                if key != now:
                    now, step = key, start()
                out.append(step(at, *rest))
            own = batch.drop_columns(["_at"])
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(out, pa.bool_())], names=[*own.schema.names, name])

    return dealt.mapInArrow(run, schema)


def requests_in_window(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """Adds n_window: the key's events in the seconds up to and with each one."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.withColumn("n_window", F.count(F.lit(1)).over(Window.partitionBy(key).orderBy(at).rangeBetween(-seconds * 1_000_000 + 1, 0)))


def rate_limit(events: DataFrame, key: str, limit: int, seconds: int) -> DataFrame:
    """Adds `admitted`: exact sliding admission, in which refused requests do not count; a key's state is `limit` times."""

    def start():
        held: deque[int] = deque()

        def step(at: int) -> bool:
            while held and at - held[0] >= seconds * 1_000_000:
                held.popleft()
            if len(held) < limit:
                held.append(at)
                return True
            return False

        return step

    return _in_turn(events, [key], [], "admitted", start)


def cache_hits(requests: DataFrame, keys: list[str], ttl: int) -> DataFrame:
    """Adds `hit`: what the last miss has stored is less than ttl seconds old; a hit stores nothing."""

    def start():
        stored: list[int] = []

        def step(at: int) -> bool:
            if stored and at - stored[0] < ttl * 1_000_000:
                return True
            stored[:] = [at]
            return False

        return step

    return _in_turn(requests, keys, [], "hit", start)


def admit_jobs(events: DataFrame, key: str, most: int) -> DataFrame:
    """Adds `active`: whether the event's job runs after it. events: event_id, ts, job and `created` (else it ends); a job that finds `most` running is refused.

    `key` is the service whose jobs count together; a key's state is its running jobs, `most` at most.
    """

    def start():
        running_: set = set()

        def step(at: int, job, created: bool) -> bool:
            if not created:
                running_.discard(job)
            elif len(running_) < most:
                running_.add(job)
            return job in running_

        return step

    return _in_turn(events, [key], ["job", "created"], "active", start)


def concurrency(jobs: DataFrame, started: str, ended: str) -> DataFrame:
    """(at, n): after each start and end of a job, how many run; at one time ends come first. Counted by range, in one go over all time."""
    moves = jobs.select(F.col(started).alias("at"), F.lit(1).cast("long").alias("d")).union(jobs.select(F.col(ended), F.lit(-1).cast("long")).filter(F.col(ended).isNotNull()))
    return running(moves, [], ["at", "d"], F.col("d"), "n").select("at", "n")


def in_cooldown(requests: DataFrame, key: str, seconds: int) -> DataFrame:
    """Adds `cooling`: a failure of the same key within the seconds before."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    failed = F.max(F.when(F.col("failed"), at)).over(Window.partitionBy(key).orderBy(at, "event_id").rowsBetween(Window.unboundedPreceding, -1))
    return requests.withColumn("cooling", F.coalesce(at - failed < seconds * 1_000_000, F.lit(False)))


def latest(rows: DataFrame, key: str, state: str) -> DataFrame:
    """(key, state): the last one by ts, then event_id."""
    return rows.groupBy(key).agg(F.max_by(state, F.struct("ts", "event_id")).alias(state))


def recover(jobs: DataFrame) -> DataFrame:
    """Jobs found running after a restart have failed."""
    stale = F.col("status") == "running"
    return jobs.withColumn("reason", F.when(stale, "server restarted").otherwise(F.col("reason"))).withColumn("status", F.when(stale, "failed").otherwise(F.col("status")))


def page(rows: DataFrame, key: str, order: list[str], offset: int, limit: int) -> DataFrame:
    """Rows offset to offset + limit - 1 of each key's list (limit 100 at most), with the list's total."""
    w = Window.partitionBy(key)
    held = rows.withColumn("pos", F.row_number().over(w.orderBy(*order)) - 1).withColumn("total", F.count(F.lit(1)).over(w))
    return held.filter((F.col("pos") >= offset) & (F.col("pos") < offset + min(limit, 100)))
