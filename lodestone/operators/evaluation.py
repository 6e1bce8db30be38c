"""Evaluation of searches: rates by group and overall, hits among the best, latencies, and comparison with a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..sources.shared import numbered


def rate(rows: DataFrame, group: str, hit: Column) -> DataFrame:
    """(group, n, hits, rate in percent) for each group and, group null, overall."""
    n, hits = F.count(F.lit(1)), F.count_if(hit)
    return rows.rollup(group).agg(n.alias("n"), hits.alias("hits"), F.round(100.0 * hits / n, 4).alias("rate"))


def relevance_hits(ranked: DataFrame, relevant: DataFrame, best: int = 5) -> DataFrame:
    """(query_id, hit) for each query in `relevant` (query_id, domains): whether one of its best hosts is one of the domains or below one.

    A domain that starts with a dot is below none, as a dot is put before it.
    """
    top = ranked.filter(F.col("place") <= best).select("query_id", urls.domain(F.col("url")).alias("_host"))
    met = relevant.join(top, "query_id", "left")
    below = F.exists("domains", lambda d: (F.col("_host") == d) | F.col("_host").endswith(F.concat(F.lit("."), d)))
    return met.groupBy("query_id").agg(F.max(F.coalesce(below, F.lit(False)).cast("int")).alias("hit"))


def percentile_by_index(rows: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """(key, n, value): the value at place int((n - 1) * share) of the key's sorted list; nulls are left out.

    Rows are numbered by range, so that a key with a third of all rows spreads over many tasks.
    """
    held = rows.filter(F.col(value).isNotNull()).select(key, value)
    sizes = held.groupBy(key).agg(F.count(F.lit(1)).alias("n")).select(F.col(key).alias("_key"), "n", F.floor((F.col("n") - 1) * share).alias("_at"))
    ranked = numbered(held, [key], [value], "_place")
    return ranked.join(sizes, ranked[key].eqNullSafe(sizes["_key"]) & (ranked["_place"] == sizes["_at"])).select(key, "n", value)


def compare(old: DataFrame, new: DataFrame, metric: str, value: str) -> DataFrame:
    """(metric, old, new, delta, is_new) of two tables of metrics."""
    a, b = old.select(metric, F.col(value).alias("old")), new.select(metric, F.col(value).alias("new"))
    return a.join(b, metric, "full").withColumn("delta", F.col("new") - F.col("old")).withColumn("is_new", F.col("old").isNull())


def write_report(report: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    report.write.mode("overwrite").json(path)
