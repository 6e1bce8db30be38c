"""The streams against their batch forms."""

from pyspark.sql import functions as F

from lodestone.operators import state
from lodestone.streaming import requests


def test_admission_and_rate(spark, tmp_path):
    rows = [(i, 1 + i % 2, f"2024-01-01 00:00:{s:02d}", "view") for i, s in enumerate((0, 1, 2, 3, 4, 5, 30, 31, 59))]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    want = sorted((r["event_id"], r["admitted"]) for r in state.rate_limit(events, "user_id", 2, 30).collect())
    assert dict(want)[4] is False and dict(want)[6] is True
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = requests.admit(stream, "user_id", 2, 30).writeStream.format("memory").queryName("admitted").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["event_id"], r["admitted"]) for r in spark.table("admitted").collect()) == want
    q = requests.request_rate(stream).writeStream.format("memory").queryName("rate").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["n"] for r in spark.table("rate").collect()] == [9]


def test_keyed_states(spark, tmp_path):
    """Runs of failures, caches, cooldowns and jobs over two files, read one after the other."""
    rows = [(i, i % 2, f"2024-01-01 00:{m:02d}:00", bool(f), ["running", "completed", "failed"][i % 3]) for i, (m, f) in enumerate([(0, 1), (1, 1), (2, 1), (3, 0), (4, 1), (5, 1), (6, 0), (12, 1), (20, 1), (21, 1), (30, 0), (59, 1)])]
    kind = "event_id long, job long, ts string, failed boolean, status string"
    events = spark.createDataFrame(rows, kind).withColumn("ts", F.col("ts").cast("timestamp"))
    for n, some in enumerate((events.filter("event_id < 7"), events.filter("event_id >= 7"))):
        some.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    def result(df, name, mode="append"):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    got = {r["event_id"]: (r["run"], r["left"]) for r in result(requests.failure_runs(stream(), "job", 3), "runs")}
    want = {}
    for job in (0, 1):
        run, left = 0, False
        for i, j, _, f, _ in rows:
            if j == job:
                run = run if left else run + 1 if f else 0
                left = left or run >= 3
                want[i] = (run, left)
    assert got == want and (3, True) in want.values()
    keyed = events.withColumn("user_id", F.col("job"))
    batch = {r["event_id"]: r["hit"] for r in state.cache_hits(keyed, ["job"], 600).collect()}
    assert {r["event_id"]: r["hit"] for r in result(requests.cache_hits(stream(), "job", 600), "hits")} == batch and True in batch.values()
    batch = {r["event_id"]: r["cooling"] for r in state.in_cooldown(keyed, "job", 300).collect()}
    assert {r["event_id"]: r["cooling"] for r in result(requests.cooling(stream(), "job", 300), "cool")} == batch
    jobs = {r["job"]: r["status"] for r in result(requests.job_states(stream()), "jobs", "complete")}
    assert jobs == {0: ["running", "completed", "failed"][10 % 3], 1: ["running", "completed", "failed"][11 % 3]}
