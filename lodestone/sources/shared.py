"""Tables in the folder that driver and executors share: to cut lineage in loops, and to number rows."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; unset, a folder of our own, which only a session on one machine may use."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = Path(tempfile.mkdtemp(prefix="lodestone-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session ended first; the folder's owner clears what is left
        pass


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write and read again; the table goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def running(df: DataFrame, groups: list[str], order: list[str], value, name: str) -> DataFrame:
    """Adds the sum of `value` over the rows of the group up to and with each one, in the order given.

    Rows are dealt by range over (groups, order), so that a group with a third of all rows spreads over many tasks;
    windows run within a task, and only sums for each task meet. Groups may be empty; nulls in them are a group.
    """
    keys = [F.col(c).asc_nulls_first() for c in (*groups, *order)]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_value", value).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    held = scratch(dealt.withColumn("_task", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "running")
    sums = held.groupBy(*groups, "_task").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*groups).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_task").alias("_of"), "_before")
    within = Window.partitionBy("_task", *groups).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("_within", F.sum("_value").over(within))
    same = held["_task"] == sums["_of"]
    for i, g in enumerate(groups):
        same &= held[g].eqNullSafe(sums[f"_g{i}"])
    out = held.join(F.broadcast(sums) if not groups else sums, same).withColumn(name, F.col("_within") + F.col("_before"))
    return out.select(*[c for c in df.columns if c != name], name)


def numbered(df: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """Adds the row's number in its group, from 0, in the order given, without a gap."""
    return running(df, groups, order, F.lit(1).cast("long"), name).withColumn(name, F.col(name) - 1)
