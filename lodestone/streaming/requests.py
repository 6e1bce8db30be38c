"""Streams of requests: rates in windows, and exact admission in keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def request_rate(events: DataFrame, window: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """(start, event_type, n) in tumbling windows; rows later than the watermark are left out."""
    held = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return held.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def admit(events: DataFrame, key: str, limit: int, seconds: int) -> DataFrame:
    """(key, event_id, admitted): sliding admission; a key's state is its last `limit` admitted times."""
    held = events.select(key, "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))

    def run(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(pdfs)).sort_values(["at", "event_id"])
        out = []
        for at in pdf["at"]:
            times = [t for t in times if at - t < seconds * 1_000_000]
            out.append(len(times) < limit)
            if out[-1]:
                times.append(int(at))
        state.update((times,))
        yield pd.DataFrame({key: pdf[key], "event_id": pdf["event_id"], "admitted": out})

    kind = held.schema[key].dataType.simpleString()
    return held.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, event_id long, admitted boolean", "times array<long>", "append", GroupStateTimeout.NoTimeout)


def _keyed(held: DataFrame, key: str, schema: str, state: str, start: tuple, step) -> DataFrame:
    """Rows of each key in turn by time and event_id; step(values of the state, row) gives the new values and the row's own result."""

    def run(k: tuple, pdfs: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        values = tuple(kept.get) if kept.exists else start
        pdf = pd.concat(list(pdfs)).sort_values(["at", "event_id"])
        out = []
        for row in pdf.itertuples(index=False):
            values, result = step(values, row)
            out.append(result)
        kept.update(values)
        names = [c.split()[0] for c in schema.split(", ")]
        found = pd.DataFrame(out, columns=names[2:])
        found.insert(0, "event_id", pdf["event_id"].to_numpy())
        found.insert(0, key, k[0])
        yield found

    return held.groupBy(key).applyInPandasWithState(run, schema, state, "append", GroupStateTimeout.NoTimeout)


def _timed(events: DataFrame, key: str, *more: str) -> tuple[DataFrame, str]:
    held = events.select(key, "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), *more)
    return held, held.schema[key].dataType.simpleString()


def failure_runs(events: DataFrame, key: str, limit: int) -> DataFrame:
    """(key, event_id, run, left): failures in a row up to each event (column failed), and whether the key is left, as it is for good once `limit` failed in a row."""
    held, kind = _timed(events, key, "failed")

    def step(values: tuple, row) -> tuple[tuple, tuple]:
        run, left = values
        run = run if left else run + 1 if row.failed else 0
        left = left or run >= limit
        return (int(run), bool(left)), (int(run), bool(left))

    return _keyed(held, key, f"{key} {kind}, event_id long, run long, left boolean", "run long, left boolean", (0, False), step)


def cache_hits(events: DataFrame, key: str, ttl: int) -> DataFrame:
    """(key, event_id, hit): what the last miss of the key has stored is less than ttl seconds old; a key's state is that time."""
    held, kind = _timed(events, key)

    def step(values: tuple, row) -> tuple[tuple, tuple]:
        hit = values[0] >= 0 and row.at - values[0] < ttl * 1_000_000
        return (values[0] if hit else int(row.at),), (bool(hit),)

    return _keyed(held, key, f"{key} {kind}, event_id long, hit boolean", "stored long", (-1,), step)


def cooling(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """(key, event_id, cooling): a failure of the key lies less than the seconds back; a key's state is its last failure."""
    held, kind = _timed(events, key, "failed")

    def step(values: tuple, row) -> tuple[tuple, tuple]:
        cool = values[0] >= 0 and row.at - values[0] < seconds * 1_000_000
        return (int(row.at) if row.failed else values[0],), (bool(cool),)

    return _keyed(held, key, f"{key} {kind}, event_id long, cooling boolean", "failed_at long", (-1,), step)


def job_states(events: DataFrame, key: str = "job", state: str = "status") -> DataFrame:
    """(key, status, started_at, completed_at) of each job as of now, for update or complete mode: the last status, the first time, and the last time of one that ended."""
    held = events.withColumn("ts", F.col("ts").cast("timestamp"))
    ended = F.col(state).isin("completed", "failed", "cancelled")
    return held.groupBy(key).agg(F.max_by(state, F.struct("ts", "event_id")).alias("status"), F.min("ts").alias("started_at"), F.max(F.when(ended, F.col("ts"))).alias("completed_at"))
