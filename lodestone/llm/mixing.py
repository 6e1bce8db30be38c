"""Mixing sources to target weights by entropy balancing.

The rates nearest to 1 in relative entropy that meet token constraints are exponentials of sums of multipliers, one
for each constraint. The multipliers minimise a convex dual; Newton's method needs its gradient and Hessian, sums
over the data that Spark makes in each step from cells (rows alike in all constraints). The Hessian holds the pairs of
constraints that some cell is in, and no others; each step solves it by conjugate gradients. The rates then become whole
copies: size classes of a source, largest first, take the copies that bring the words taken so far nearest to the
words due so far, so that a source ends within a few words of its target.

Nulls and edge cases: a null text has no words, a null source is a source of its own (the last). Rows that repeat in
doc_id, source and text get the same copies. Documents of one source and size class go in the order of their ids'
hashes. A very long text counts whole. A document without words gets copies at its source's rate. Constraints that
contradict each other raise an error. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, join_plan, numbered, scratch, ship, size_class, text_key

#: Sources that one mix may have; the driver holds some 50 bytes and the name of each.
MAX_SOURCES = 2_000_000


def capped_targets(sizes: np.ndarray, weights: np.ndarray, cap: float) -> np.ndarray:
    """Share the total of all sizes by weight; what exceeds cap times a size is shared anew among the others, until none does."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    target, free, left = np.zeros(len(sizes)), np.ones(len(sizes), bool), float(np.sum(sizes))
    while free.any() and left > 0:
        share = left * weights / weights[free].sum()
        over = free & (share > cap * sizes)
        if not over.any():
            target[free] = share[free]
            break
        target[over] = cap * sizes[over]
        left -= target[over].sum()
        free &= ~over
    return target


def _solved(i: np.ndarray, j: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x of H x = b by conjugate gradients with the diagonal as preconditioner; H has w at (i, j) and is symmetric."""
    n = len(b)
    diagonal = np.maximum(np.bincount(i[i == j], w[i == j], n), 1e-300)
    x, r = np.zeros(n), b.copy()
    z = r / diagonal
    p, rz = z.copy(), float(r @ z)
    first = rz
    for _ in range(10 * n + 20):
        if rz <= 1e-28 * first or rz <= 0:
            break
        hp = np.bincount(i, w * p[j], n)
        along = float(p @ hp)
        if along <= 0:
            break
        x += rz / along * p
        r -= rz / along * hp
        z = r / diagonal
        new = float(r @ z)
        p, rz = z + new / rz * p, new
    return x


def balance(cells: DataFrame, target: np.ndarray, steps: int = 60, tolerance: float = 1e-12, accepted: float = 1e-6) -> np.ndarray:
    """Multipliers of the constraints. cells: `ks` (the constraints a cell is in) and `tokens`; a target of 0 must be left out.

    Raises ValueError where the constraints are not met to `accepted`, as those that contradict each other are not.
    """
    spark, n = cells.sparkSession, len(target)
    ship(spark)
    lam, target = np.zeros(n), np.asarray(target, float)
    for _ in range(steps):
        held = spark.sparkContext.broadcast(lam)

        def pairs(batches, held=held):
            for batch in batches:
                ks = column(batch, "ks")
                flat, size = ks.flatten().to_numpy(zero_copy_only=False).astype(np.int64), ks.value_lengths().to_numpy(zero_copy_only=False)
                of = np.repeat(np.arange(len(size)), size)
                w = column(batch, "tokens").to_numpy(zero_copy_only=False) * np.exp(np.bincount(of, held.value[flat], len(size)))
                begins = np.cumsum(size) - size
                i = np.repeat(np.arange(len(flat)), size[of])
                j = np.repeat(begins[of], size[of]) + np.arange(len(i)) - np.repeat(np.cumsum(size[of]) - size[of], size[of])
                yield pa.RecordBatch.from_arrays([pa.array(flat[i], pa.int64()), pa.array(flat[j], pa.int64()), pa.array(w[of[i]])], names=["i", "j", "w"])

        got = cells.select("ks", "tokens").mapInArrow(pairs, "i long, j long, w double").groupBy("i", "j").agg(F.sum("w").alias("w")).orderBy("i", "j").toArrow()
        i, j, w = (got[c].to_numpy() for c in "ijw")
        gradient = np.bincount(i[i == j], w[i == j], n) - target
        error = np.max(np.abs(gradient) / np.maximum(target, 1.0))
        if error < tolerance:
            return lam
        step = _solved(i, j, w, gradient)
        lam = lam - step * min(1.0, 2.0 / max(1e-300, np.max(np.abs(step))))
        if error < accepted and np.max(np.abs(step)) < 1e-13:
            return lam
    if error > accepted:
        raise ValueError(f"the constraints are not met: off by {error:.3g} of a target")
    return lam


def _rounded(table: pa.Table) -> pa.Table:
    """Copies of one source's size classes: `base` for each row and one more for the first `extra`."""
    table = table.sort_by([("_class", "descending")])
    due, taken, base, extra = 0.0, 0.0, [], []
    for n, words, rate, cap in zip(*(table[c].to_pylist() for c in ("n", "words", "rate", "cap"))):
        due += rate * words
        mean = words / n
        copies = int(np.clip(np.floor((due - taken) / mean + 0.5) if mean else np.floor(rate * n + 0.5), 0, int(cap) * n))
        taken += copies * mean
        base.append(copies // n)
        extra.append(copies % n)
    return table.select(["_src", "_class", "n", "source_size", "target"]).append_column("base", pa.array(base, pa.int64())).append_column("extra", pa.array(extra, pa.int64()))


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, _key and n_rows of each distinct (doc_id, source, text).

    Sources in code-point order, null last, take the weights in turn; no target exceeds cap times its source's words
    and no document gets more than cap copies.
    """
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    units = docs.select("doc_id", "source", words.alias("size"), text_key(F.col("text")).alias("_key"))
    units = units.groupBy("doc_id", "source", "_key").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("n_rows"))
    units = units.withColumn("_src", F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source"))))
    units = units.withColumn("_words", F.col("size") * F.col("n_rows")).withColumn("_class", size_class(F.col("_words")))
    units = scratch(units.withColumn("_order", F.xxhash64("doc_id", "_key")), "units")
    sources = units.groupBy("_src").agg(F.sum("_words").alias("words"))
    found = sorted(zip(*(sources.limit(MAX_SOURCES + 1).toArrow().to_pydict().values())), key=lambda x: x[0])
    if len(found) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources; group them first")
    sizes = np.array([w for _, w in found], float)
    target = capped_targets(sizes, np.array([weights[i % len(weights)] for i in range(len(found))]), cap)
    live = np.flatnonzero(target > 0)
    rate = np.where(sizes > 0, 0.0, 1.0)
    if len(live):
        index = spark.createDataFrame(pa.table({"_src": [found[i][0] for i in live], "ks": pa.array([[k] for k in range(len(live))], pa.list_(pa.int32()))}))
        cells = scratch(sources.join(index, "_src").select("ks", F.col("words").cast("double").alias("tokens")), "cells")
        rate[live] = np.minimum(cap, np.exp(balance(cells, target[live])))
    names = pa.array([s for s, _ in found], pa.string())
    rates = spark.createDataFrame(pa.table({"_src": names, "source_size": pa.array([w for _, w in found], pa.int64()), "target": target, "rate": rate, "cap": pa.array([int(cap)] * len(found), pa.int32())}))
    histogram = units.groupBy("_src", "_class").agg(F.count(F.lit(1)).alias("n"), F.sum("_words").alias("words"))
    plan = histogram.join(rates, "_src").groupBy("_src").applyInArrow(_rounded, "_src string, _class long, n long, source_size long, target double, base long, extra long")
    plan = scratch(plan.withColumn("_from", F.lit(0).cast("long")), "copies")
    ranked = join_plan(numbered(units, ["_src", "_class"], ["_order", "doc_id", "_key"], "_rank"), plan, ["_src", "_class"], "_from", "n", plan.count())
    copies = F.col("base") + (F.col("_rank") < F.col("extra")).cast("long")
    return ranked.select("doc_id", "source", "_key", "size", "n_rows", "source_size", "target", copies.alias("copies"))


def repeated(spark: SparkSession, docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: the documents' own columns, each row as often as its copies say."""
    held = mix(spark, docs, **settings).filter("copies > 0").select(F.col("doc_id").alias("_lodestone_doc"), F.col("source").alias("_lodestone_source"), F.col("_key").alias("_lodestone_held"), F.col("copies").alias("_lodestone_copies"))
    keyed = docs.withColumn("_lodestone_key", text_key(F.col("text")))
    same = keyed["_lodestone_key"].eqNullSafe(held["_lodestone_held"]) & keyed["doc_id"].eqNullSafe(held["_lodestone_doc"]) & keyed["source"].eqNullSafe(held["_lodestone_source"])
    out = keyed.join(held, same).withColumn("_lodestone_copy", F.explode(F.sequence(F.lit(1), F.col("_lodestone_copies").cast("int"))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
