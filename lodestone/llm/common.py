"""What the operators share: shared scratch tables, gapless numbering, code shipping, Arrow mapping."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; read by Spark, so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session ended first; the folder's owner clears what is left
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/lodestone-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def scratch(df: DataFrame, name: str, spent: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again, so that a lost executor costs no recomputing.

    spent: gets the path, for drop_scratch() once later tables no longer need it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    if spent is not None:
        spent.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, spent: list[str], keep: int = 0) -> None:
    """Remove all but the last `keep` of the paths."""
    while len(spent) > keep:
        _remove(spark, spent.pop(0))


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for an application, as their Python may not have it on its path."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root, held = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    fd, name = tempfile.mkstemp(prefix="lodestone-", suffix=".zip")
    with os.fdopen(fd, "wb") as f:
        f.write(held.getvalue())
    spark.sparkContext.addPyFile(name)
    _SHIPPED.add(app)


def numbered(df: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """Number the rows of each group from 0 without a gap, in the order given.

    Rows are dealt by range over (groups, order), so that a group holding a third of all rows spreads over many
    tasks; only counts per task are gathered. The groups' columns must not be null and the order should tell
    rows apart (rows equal in all of it get some order).
    """
    keys = [*groups, *order]
    dealt = df.repartitionByRange(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    held = scratch(dealt.withColumn("_task", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    runs = held.groupBy(*groups, "_task").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return held.join(runs, [*groups, "_task"]).withColumn(name, F.col("_at") - F.col("_first") + F.col("_before")).drop("_task", "_at", "_first", "_before")


#: Rows of a numbered group that meet its plan's row in one task, and rows of a plan that are broadcast (some 64 bytes each).
BLOCK_ROWS, BROADCAST_ROWS = 100_000, 200_000


def join_plan(rows: DataFrame, plan: DataFrame, keys: list[str], first: str, end: str, n_plan: int) -> DataFrame:
    """Rows (numbered in their group, in `_rank`) with the plan's row of their group that holds their number, from `first` to before `end`.

    A plan of a proven size is broadcast. A larger one meets the rows by group and block of numbers, so that a group
    with a third of all rows spreads over many tasks.
    """
    within = (F.col("_rank") >= F.col(first)) & (F.col("_rank") < F.col(end))
    if n_plan <= BROADCAST_ROWS:
        return rows.join(F.broadcast(plan), keys).filter(within)
    block = lambda c: F.floor(c / BLOCK_ROWS)
    dealt = plan.withColumn("_block", F.explode(F.sequence(block(F.col(first)), block(F.col(end) - 1))))
    return rows.withColumn("_block", block(F.col("_rank"))).join(dealt, [*keys, "_block"]).filter(within).drop("_block")


def join_copies(rows: DataFrame, groups: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Rows with their group's columns; `n` is the group's number of rows. Groups with a thousandth of all rows, at most a thousand, are broadcast."""
    often = F.col(n) >= max(1000, total // 1000)
    hot = groups.filter(often).drop(n).withColumn("_hot", F.lit(True))
    met = rows.join(F.broadcast(hot), key, "left")
    rest = met.filter("_hot IS NULL").select(*rows.columns)
    return met.filter("_hot").drop("_hot").unionByName(rest.join(groups.filter(~often).drop(n), key))


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def size_class(size: Column) -> Column:
    """The size itself up to 4096, and above that rounded up to 12 significant bits: at most some 90,000 classes."""
    step = F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double"))) - 12))
    return (F.ceil(size / step) * step).cast("long")


def _give_back() -> None:
    """What was freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # another C library than glibc has no such call
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function for mapInArrow(); its worker, which waits beside others for later tasks, keeps none of the task's memory."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _give_back()

    return task


def with_struct(df: DataFrame, name: str, fields: list[T.StructField], factory: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]]) -> DataFrame:
    """Add a struct column made in Arrow batches; a column of that name is replaced, all others pass through untouched.

    factory runs once in each task and gives the function from a batch to the struct's fields.
    """
    ship(df.sparkSession)
    own = [c for c in df.columns if c.lower() != name.lower()]
    # mapInArrow() can't take names with dots or backquotes
    kept = df.select(*[F.col("`" + c.replace("`", "``") + "`").alias(f"_lodestone_{i}" if set(".`") & set(c) else c) for i, c in enumerate(own)])
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.StructType(fields))])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = factory()
        for batch in batches:
            struct = pa.StructArray.from_arrays(make(batch), names=names)
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], names=[*batch.schema.names, name])

    return kept.mapInArrow(trimmed(run), schema).toDF(*own, name)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """A text column with null as empty, with 64-bit offsets."""
    return pc.fill_null(column(batch, name).cast(pa.large_string()), "")


def slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets from 0): runs of whole texts of up to `most` bytes, or one longer text."""
    n, buffers = len(texts), texts.buffers()
    if not n:
        return
    offsets = np.frombuffer(buffers[1], np.int64, n + 1 + texts.offset)[texts.offset :]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
