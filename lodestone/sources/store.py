"""Keyed tables with a time to live, lists that are appended to, and job states: what a key-value service held, as Parquet tables.

A missing table is an empty one, so that a lookup misses and nothing fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import as_text


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def put(rows: DataFrame, path: str) -> None:
    """Append rows (key, value columns, stored_at)."""
    rows.write.mode("append").parquet(path)


def held(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def fresh(rows: DataFrame, ttl: int, as_of: Column) -> DataFrame:
    """Rows stored less than ttl seconds before as_of, and not after it."""
    age = as_of.cast("timestamp").cast("double") - F.col("stored_at").cast("timestamp").cast("double")
    return rows.filter((age >= 0) & (age < ttl))


def lookup(requests: DataFrame, rows: DataFrame, key: str, ttl: int, as_of: Column) -> DataFrame:
    """The requests with `hit` and the columns of their key's latest fresh row; a null value that was stored is a hit too."""
    values = [c for c in rows.columns if c not in (key, "stored_at")]
    last = fresh(rows, ttl, as_of).groupBy(key).agg(F.max_by(F.struct(*values), "stored_at").alias("_value"), F.lit(True).alias("_hit"))
    out = requests.join(last, key, "left").withColumn("hit", F.coalesce("_hit", F.lit(False)))
    return out.select(*requests.columns, "hit", *[F.col("_value")[v].alias(v) for v in values])


def with_status(jobs: DataFrame, status: str) -> DataFrame:
    """Jobs in a status."""
    return jobs.filter(F.col("status") == status)


def robots_table(captures: DataFrame) -> DataFrame:
    """(domain, robots_txt) from captures (domain, status, body): what came with status 200 alone, the first text of a domain."""
    return captures.filter("status = 200").groupBy("domain").agg(F.min("body").alias("robots_txt"))


def first_answer(attempts: DataFrame, key: str) -> DataFrame:
    """(key, attempt, body): of attempts (key, attempt, status, body) the first with a status below 400 and an answer in JSON; none where all failed."""
    good = (F.col("status") < 400) & as_text(F.col("body")).rlike(r"^[\[{]")
    return attempts.filter(good).groupBy(key).agg(F.min("attempt").alias("attempt"), F.min_by("body", "attempt").alias("body"))
